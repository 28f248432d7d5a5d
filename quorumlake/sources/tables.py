"""Reading extracts: gzip CSV tables by name, with typed failures, and other tables by the name of their columns."""

from __future__ import annotations

import csv
import gzip
import hashlib
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumlake import constants as C

from .extract import ROW, ExtractError, lower_header, raw_header, registered, typed_failures


def listing(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a folder, sorted by name; of a folder that Spark can list."""
    rows = spark.read.format("binaryFile").load(folder).select("path", "length").collect()
    return sorted(((r["path"], r["length"]) for r in rows), key=lambda t: t[0].rsplit("/", 1)[-1])


def table_path(spark: SparkSession, folder: str, table: str) -> str:
    """The path of <table>.csv.gz, whatever its case; the first by name where there are several."""
    for path, _ in listing(spark, folder):
        if path.rsplit("/", 1)[-1].lower() == f"{table.lower()}.csv.gz":
            return path
    raise ExtractError(f"table {table} is not in {folder}", "missing-table")


def header_case(header: list[str]) -> str:
    """How an extract spells its columns: lower (no capitals), camel (capitals, letters and digits alone) or mixed."""
    names = [h.strip() for h in header if h.strip()]
    if not any(c.isupper() for h in names for c in h):
        return "lower"
    return "camel" if all(h.isalnum() for h in names) else "mixed"


def require_columns(columns: list[str], table: str, needed: tuple[str, ...]) -> None:
    gone = [c for c in needed if c.lower() not in columns]
    if gone:
        raise ExtractError(f"{table} lacks {gone}; it has {columns}", "missing-column")


def read_table(spark: SparkSession, folder: str, table: str, *, required: tuple[str, ...] | None = None, limit: int | None = None, raw: bool = False, numbered: bool = False) -> DataFrame:
    """All cells of a table as text, missing ones as '', under lower-case names, by the extract data source.

    Byte-order marks, quoted line ends (in the header as well), doubled quotes, short rows and blank rows are read; extra
    cells are dropped. numbered: a last column `_row` holds each row's place in its file. raw: the header stays as it is, blank rows stay, and what a row lacks is NULL. A gzip file is read
    by one task, so the rows are dealt out again before anything else is done with them. Failures within a job are
    ExtractErrors where the job runs under typed_failures().
    """
    path = table_path(spark, folder, table)
    options = {"path": path, "table": table, "raw": str(raw).lower(), "numbered": str(numbered).lower()} | ({} if limit is None else {"limit": str(limit)})
    header = raw_header(path, table, raw)
    names = header if raw else lower_header(header, table)
    require_columns([n.lower() for n in names], table, C.REQUIRED_COLUMNS.get(table, ()) if required is None else required)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(ROW, T.LongType())] * numbered)
    return spark.read.format(registered(spark)).schema(schema).options(**options).load().repartition(spark.sparkContext.defaultParallelism)


def check_readable(df: DataFrame, table: str) -> int:
    """The rows of a table; raises ExtractError where its bytes are cut short, are not UTF-8 or hold a cell that is too long."""
    with typed_failures():
        return df.count()


def folder_digest(spark: SparkSession, folder: str) -> str:
    """SHA-256 over the sorted names and sizes of a folder's files."""
    lines = "\n".join(f"{p.rsplit('/', 1)[-1]}:{n}" for p, n in listing(spark, folder))
    return hashlib.sha256(lines.encode()).hexdigest()


def read_labeled(spark: SparkSession, path: str, *, label: str = "label", site: str = "site", prefix: str = "x") -> DataFrame:
    """(site_raw, label_raw, x) of a CSV file; features are the columns whose names start with the prefix, in order."""
    df = spark.read.csv(path, header=True)
    features = [c for c in df.columns if c.startswith(prefix)]
    x = F.array(*[F.col(c).try_cast("double") for c in features]).alias("x")
    have = [F.col(site).alias("site_raw"), *([F.col(label).alias("label_raw")] if label in df.columns else [])]
    return df.select(*have, x)


def read_recorded(spark: SparkSession, path: str, schema: str, **equal) -> DataFrame:
    """Rows of a table that write_csv wrote, cells read as the schema says, of which all given columns have the given values.

    A cell that does not fit its type is NULL, and so never equal to anything; the columns must be in the file.
    """
    df = spark.read.schema(schema).option("enforceSchema", False).csv(path, header=True)
    for name, value in equal.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def read_any(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """A table that Spark's own readers know."""
    return spark.read.format(kind).options(**options).load(path)


def gzip_csv(rows: list[list[str]], header: list[str], *, mark: bool = False) -> bytes:
    """A small table as the bytes of a gzip CSV file that are the same on every run; for fixtures."""
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows([header, *rows])
    return gzip.compress(("﻿" * mark + text.getvalue()).encode(), mtime=0)
