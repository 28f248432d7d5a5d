"""A data source for extracts: gzip CSV files by table, one reader a file, failures named by table, path and byte offset."""

from __future__ import annotations

import csv
import gzip
import io
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "quorumlake_extract"
ROW = "_row"
#: The longest cell, in characters, and the rows of a batch.
LONGEST_CELL, BATCH = 10_000_000, 4096


class ExtractError(ValueError):
    """An extract that cannot be read as expected; the message ends with (reason=tag)."""

    def __init__(self, what: str, reason: str):
        super().__init__(f"{what} (reason={reason})")
        self.what, self.reason = what, reason

    def __reduce__(self):
        return ExtractError, (self.what, self.reason)


@contextmanager
def typed_failures():
    """Turns what a reader raised within a Spark job into the ExtractError that it was."""
    try:
        yield
    except ExtractError:
        raise
    except Exception as e:
        found = re.search(r"ExtractError: (.*?) \(reason=([a-z-]+)\)", str(e), re.DOTALL)
        if not found:
            raise
        raise ExtractError(found[1], found[2]) from e


def opened(path: str):
    """A file as a stream of bytes, by a path that pyarrow's file systems know."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(inner)


def cells_of(path: str, table: str, raw: bool) -> Iterator[list[str]]:
    """The rows of a gzip CSV file, header first; quoted commas, quotes and line ends stay as they are.

    Raises ExtractError with the table, the path and the byte of the compressed file that was reached: undecodable-table
    for bytes that are not UTF-8, truncated-table for a file that is cut short or no gzip, malformed-table for a cell
    that is too long.
    """
    csv.field_size_limit(LONGEST_CELL)
    stream = None

    def failed(e: Exception, reason: str) -> ExtractError:
        at = f" at byte {stream.tell()}" if stream is not None else ""
        return ExtractError(f"{table} at {path}{at}: {type(e).__name__}: {e}", reason)

    try:
        stream = opened(path)
        with gzip.GzipFile(fileobj=stream) as plain:
            yield from csv.reader(io.TextIOWrapper(io.BufferedReader(plain, 1 << 20), encoding="utf-8" if raw else "utf-8-sig", newline=""))
    except UnicodeDecodeError as e:
        raise failed(e, "undecodable-table") from e
    except csv.Error as e:
        raise failed(e, "malformed-table") from e
    except (EOFError, OSError, zlib.error) as e:
        raise failed(e, "truncated-table") from e


def raw_header(path: str, table: str, raw: bool = False) -> list[str]:
    """The header cells of a file as they stand, also where one holds a line end."""
    rows = cells_of(path, table, raw)
    try:
        return next(rows)
    except StopIteration:
        raise ExtractError(f"{table} at {path} has no header row", "missing-column") from None
    finally:
        rows.close()


def lower_header(header: list[str], table: str) -> list[str]:
    names = [h.strip().lower() for h in header]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ExtractError(f"{table} has columns that differ in case alone: {twice}", "duplicate-header")
    return names


class ExtractSource(DataSource):
    """Options: path; table; raw: header as it stands, rows neither padded nor skipped, what a row lacks NULL; limit: rows;
    numbered: a last column `_row`, the row's place in the file from 0."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        raw = self.options.get("raw", "false") == "true"
        header = raw_header(self.options["path"], self.options["table"], raw)
        cells = [T.StructField(n, T.StringType()) for n in (header if raw else lower_header(header, self.options["table"]))]
        return T.StructType(cells + [T.StructField(ROW, T.LongType())] * (self.options.get("numbered", "false") == "true"))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ExtractReader(self.options["path"], self.options["table"], self.options.get("raw", "false") == "true", int(self.options.get("limit", -1)), self.options.get("numbered", "false") == "true", schema.names)


class ExtractReader(DataSourceReader):
    def __init__(self, path: str, table: str, raw: bool, limit: int, numbered: bool, names: list[str]):
        self.path, self.table, self.raw, self.limit, self.numbered, self.names = path, table, raw, limit, numbered, names
        self.width = len(names) - numbered

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]  # a gzip file cannot be cut

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa

        def batch(rows: list[list], end: int):
            own = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays(own + [pa.array(range(end - len(rows), end), pa.int64())] * self.numbered, names=self.names)

        rows, n, held, fill = cells_of(self.path, self.table, self.raw), 0, [], None if self.raw else ""
        next(rows, None)  # the header
        for row in rows:
            if n == self.limit:
                break
            if not self.raw and (not row or (len(row) == 1 and not row[0].strip())):
                continue
            held.append((row + [fill] * (self.width - len(row)))[: self.width])
            n += 1
            if len(held) == BATCH:
                yield batch(held, n)
                held = []
        if held:
            yield batch(held, n)


def registered(spark: SparkSession) -> str:
    """The format's name, after it is made known to the session."""
    spark.dataSource.register(ExtractSource)
    return NAME
