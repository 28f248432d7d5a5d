"""Operator 9: WARC archives that are indexed as they are written, and reads of selected records in coalesced ranges."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

INDEX = "file string, offset long, length long, url string, digest string, record_type string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _base32_sha1(data: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page: str | None) -> str:
    """The record's id: of a page id every byte but letters, digits and _.-~ is escaped, so line ends come back; a null has a form of its own."""
    from urllib.parse import quote

    return "urn:nopage" if page is None else f"urn:page:{quote(page, safe='')}"


def _page(urn: str) -> str | None:
    from urllib.parse import unquote

    inner = urn.removeprefix("<").removesuffix(">")
    return None if inner == "urn:nopage" else unquote(inner.removeprefix("urn:page:"))


def _record(page: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str) -> tuple[bytes, str]:
    """A record, with two line ends behind it, and its payload digest; a revisit holds the HTTP head alone."""
    digest = _base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_urn(page)}>", f"WARC-Date: {date}"]
    if url is not None:
        safe = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
        lines.append(f"WARC-Target-URI: {safe}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_urn(refers_to)}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def revisits(pages: DataFrame, *, id_col: str = "page_id", text_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(page, key, refers_to) of the rows whose payload a row of larger id has too; key digests the payload.

    Only ids and digests are shuffled; the largest id of a payload is pre-aggregated and joined back, whatever share of
    the rows the payload has. Payloads below least_bytes are not compared. Null ids revisit nothing and are not visited.
    """
    payload = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    narrow = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("page"), F.sha2(payload, 256).alias("key"), F.octet_length(payload).alias("size")).where(F.col("size") >= least_bytes)
    heads = narrow.groupBy("key").agg(F.max("page").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    return narrow.select("page", "key").join(heads.select("key", "refers_to"), "key").where("page < refers_to").distinct()


def write_archives(pages: DataFrame, to: str, *, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 5) -> None:
    """Writes a record for every row of pages to archives in `to` and their index to `to`/index, as Parquet.

    Each record is a gzip member of its own. The payload is the text in UTF-8 (null: empty). Of equal payloads of at
    least least_bytes bytes the row with the largest id is a response, the others are revisits that refer to it. A row
    of the index has the file, offset and length of the record, its URL, payload digest and type. A task writes a file
    under a name of its own; only files of tasks that ended well are in the index, so lost executors leave nothing to
    be read. `to` must be a place that pyarrow's file systems open (file, hdfs, s3, gs).
    """
    payload = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    known = revisits(pages, id_col=id_col, text_col=text_col, least_bytes=least_bytes)
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("page"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("key"))
    # the narrow side becomes each task's table, so that payloads stream past it and are neither sorted nor held
    rows = rows.join(known.hint("shuffle_hash"), ["page", "key"], "left").select("id", "url", "payload", F.col("refers_to").cast("string").alias("refers_to"))

    def run(batches: Iterator) -> Iterator:
        import gzip
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(to)
        name, out, offset = f"part-{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                index = []
                for page, url, body, refers in zip(*batch.columns, strict=True):
                    if out is None:
                        store.create_dir(folder, recursive=True)
                        out = store.open_output_stream(f"{folder}/{name}", compression=None)
                        info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{name}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
                        first = gzip.compress(info.encode(), level, mtime=0)
                        out.write(first)
                        offset = len(first)
                    data, digest = _record(page.as_py(), url.as_py(), body.as_py(), refers.as_py(), date)
                    member = gzip.compress(data, level, mtime=0)
                    out.write(member)
                    index.append((name, offset, len(member), url.as_py(), digest, "response" if refers.as_py() is None else "revisit"))
                    offset += len(member)
                if index:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["file", "offset", "length", "url", "digest", "record_type"])
        finally:
            if out is not None:
                out.close()

    rows.mapInArrow(run, INDEX).write.parquet(f"{to}/index")


def read_index(spark: SparkSession, at: str) -> DataFrame:
    """(file, offset, length, url, digest, record_type) of all records in `at`."""
    return spark.read.schema(INDEX).parquet(f"{at}/index")


def read_records(selected: DataFrame, at: str, *, gap: int = 1 << 16, most: int = 8 << 20, range_bytes: int = 8 << 20, with_payload: bool = False) -> DataFrame:
    """(page, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of the selected rows of an index.

    Rows are dealt into ranges of file and offset, one for each `range_bytes` to be read. Neighbours at most `gap` bytes apart are read at once, `most` bytes
    at most or one record. The digest of each response is checked against its payload; a mismatch fails the job.
    payload_bytes is that of the full payload for revisits too; their payload is null.
    """
    names = ["page", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else [])]
    schema = "page string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * with_payload

    form = to_arrow_schema(T.StructType.fromDDL(schema))

    def parse(member: bytes) -> tuple:
        import gzip

        head, _, block = gzip.decompress(member).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        block = block[: int(fields["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
        digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
        if kind == "response" and (len(payload) != size or _base32_sha1(payload) != digest):
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not what its digest says")
        page, refers = _page(fields["WARC-Record-ID"]), _page(fields["WARC-Refers-To"]) if kind == "revisit" else None
        return (page, fields.get("WARC-Target-URI"), size, digest, kind, refers, *([payload if kind == "response" else None] if with_payload else []))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(at)
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            i = 0
            while i < len(rows):
                name, start, size = rows[i]
                end, j = start + size, i + 1
                while j < len(rows) and rows[j][0] == name and 0 <= rows[j][1] - end <= gap and rows[j][1] + rows[j][2] - start <= most:
                    end, j = rows[j][1] + rows[j][2], j + 1
                with store.open_input_file(f"{folder}/{name}") as source:
                    data = source.read_at(end - start, start)
                found = [parse(data[o - start : o - start + n]) for _, o, n in rows[i:j]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), form, strict=True)], names=names)
                i = j

    # a range for each range_bytes to be read, so that tasks follow the bytes of the records, not of their index
    total = selected.agg(F.sum("length")).first()[0] or 0
    ordered = selected.select("file", "offset", "length").repartitionByRange(max(1, -(-total // range_bytes)), "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, schema)
