"""Operator 4: token ids in Parquet list columns, in document order, and what can be read back without the rest."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import with_fields
from .pieces import PieceCache, WordCache, pieces

_loaded: dict = {}


def tokenizer(path: str, word_level: bool) -> PieceCache | WordCache:
    """The cache of this Python worker of the ids of pieces, as little-endian 32-bit numbers."""
    if (path, word_level) not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        by_pieces = PieceCache(lambda some: [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(some, add_special_tokens=False)])
        _loaded[path, word_level] = WordCache(tok) if word_level else by_pieces
    return _loaded[path, word_level]


def write_tokens(docs: DataFrame, to: str, *, path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", row_group_mb: int = 16, page_rows: int = 512, word_level: bool = False) -> None:
    """Writes (doc, n_tokens, ids) for every row of docs in ascending order of the id, one file for each range of ids.

    The ids of whole texts (null: empty) as the tokenizers library gives them without added special tokens, then
    end_id. Lists are dictionary-encoded while the dictionary pays, delta-encoded beyond; row groups are of
    row_group_mb MB and pages of page_rows rows at most, with page indexes, so a reader of some documents reads their
    pages and a reader of counts does not touch the ids. word_level: the tokenizer works as WordCache
    says, so that each distinct word is encoded once, whatever stands beside it. Null ids come first; rows that share an id lie together.
    """
    base = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = with_fields(base.drop("text"), "n_tokens int, ids array<int>")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        cache = tokenizer(path, word_level)
        last = b"" if end_id is None else end_id.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                if word_level:
                    ids = [cache.ids(t) + last for t in texts]
                else:
                    cuts = [pieces(t) for t in texts]
                    cache.fill(cuts)
                    ids = [cache.joined(c) + last for c in cuts]
                sizes = np.array([len(x) // 4 for x in ids], "int32")
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype("int32"), np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), lists], names=[f.name for f in schema.fields])

    ordered = base.repartitionByRange("doc").sortWithinPartitions("doc")
    (
        ordered.mapInArrow(run, schema).write.option("parquet.block.size", row_group_mb << 20).option("parquet.page.row.count.limit", page_rows)
        .option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "true").option("compression", "zstd").parquet(to)
    )


def read_tokens(spark: SparkSession, at: str, id_type: str = "bigint") -> DataFrame:
    """(doc, n_tokens, ids, file, row) of a folder that write_tokens wrote."""
    return spark.read.schema(f"doc {id_type}, n_tokens int, ids array<int>").parquet(at).select(
        "doc", "n_tokens", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")
    )


def starts(tokens: DataFrame) -> DataFrame:
    """(file, row, start): the ids before each row in file order, from counts alone; ids stay unread.

    Files hold ascending ranges; each is summed, the few sums are added up, and rows are counted within their file.
    """
    # by the number in the name: from 100,000 files on, names are not in the order of their numbers
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    files = tokens.groupBy("file").agg(F.sum("n_tokens").cast("long").alias("in_file"))
    before = F.coalesce(F.sum("in_file").over(W.orderBy(number, "file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum(F.col("n_tokens").cast("long")).over(W.partitionBy("file").orderBy("row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return tokens.select("file", "row", within.alias("within")).join(files.select("file", before.alias("before")), "file").select("file", "row", (F.col("before") + F.col("within")).alias("start"))


def digests(tokens: DataFrame) -> DataFrame:
    """(doc, n_tokens, file, row, ids_crc32): the CRC-32 of each row's ids as little-endian 32-bit numbers."""
    schema = with_fields(tokens.select("doc", "file", "row"), "n_tokens long, ids_crc32 long")

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(3)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], names=[f.name for f in schema.fields])

    return tokens.select("doc", "file", "row", "ids").mapInArrow(run, schema)
