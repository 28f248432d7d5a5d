"""The extract data source: odd files, and failures named by table, path and byte."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from quorumlake.plans import etl
from quorumlake.sources import extract, sinks, tables


def put(folder, data: bytes, name: str = "t") -> str:
    (folder / f"{name}.csv.gz").write_bytes(data)
    return f"file://{folder}"


def test_headers_and_cells_with_line_ends(spark, tmp_path):
    text = '﻿"Stay\r\nId", B ,c\r\n1,"x, ""y""\r\nz",\r\n\r\n   \r\n2\r\n3,b,c,d\r\n,,\r\n'
    folder = put(tmp_path, gzip.compress(text.encode()))
    got = tables.read_table(spark, folder, "T", required=("stay\r\nid",))
    assert got.columns == ["stay\r\nid", "b", "c"]
    assert sorted(map(tuple, got.collect())) == [("", "", ""), ("1", 'x, "y"\r\nz', ""), ("2", "", ""), ("3", "b", "c")]
    assert tables.read_table(spark, folder, "t", required=(), limit=2).count() == 2
    put(tmp_path, gzip.compress(text[1:].encode()), "plain")
    raw = tables.read_table(spark, folder, "plain", required=(), raw=True)
    assert raw.columns == ["Stay\r\nId", " B ", "c"]
    assert sorted(map(tuple, raw.collect()), key=str) == sorted([("1", 'x, "y"\r\nz', ""), (None, None, None), ("   ", None, None), ("2", None, None), ("3", "b", "c"), ("", "", "")], key=str)


def test_many_rows_and_a_read_by_name(spark, tmp_path):
    rows = [[str(i), "y" * (i % 50)] for i in range(10_000)]
    folder = put(tmp_path, tables.gzip_csv(rows, ["a", "b"]))
    df = spark.read.format(extract.registered(spark)).options(path=f"{folder}/t.csv.gz", table="t").load()
    placed = tables.read_table(spark, folder, "t", required=(), numbered=True)
    assert placed.where("cast(a as long) = _row").count() == 10_000 and placed.columns == ["a", "b", "_row"]
    assert df.agg(F.count("*"), F.sum(F.col("a").cast("long")), F.sum(F.length("b"))).first() == (10_000, sum(range(10_000)), sum(i % 50 for i in range(10_000)))


def test_failures_name_table_path_and_byte(spark, tmp_path):
    whole = tables.gzip_csv([[str(i), f"{i * 7919 % 10_007:x}" * 9] for i in range(30_000)], ["a", "b"])
    cases = {
        "truncated-table": whole[: len(whole) // 2], "undecodable-table": gzip.compress(b"a,b\n" + b"1,fine\n" * 40_000 + b"2,\xff\xfe\n"),
        "malformed-table": gzip.compress(b"a,b\n1," + b"x" * (extract.LONGEST_CELL + 1) + b"\n"),
    }
    for reason, data in cases.items():
        folder = put(tmp_path, data, reason)
        with pytest.raises(extract.ExtractError, match=rf"{reason} at .*{reason}\.csv\.gz at byte [1-9][0-9]*") as e:
            tables.check_readable(tables.read_table(spark, folder, reason, required=()), reason)
        assert e.value.reason == reason
    for reason, data in {"truncated-table": b"no gzip at all", "undecodable-table": gzip.compress(b"\xff\xfe,b\n"), "missing-column": gzip.compress(b"")}.items():
        folder = put(tmp_path, data, "head")
        with pytest.raises(extract.ExtractError, match=reason):
            tables.read_table(spark, folder, "head", required=())


def test_the_build_raises_what_its_reader_found(spark, tmp_path):
    for name in etl.C.TABLES:
        header = list(etl.C.REQUIRED_COLUMNS[name])
        data = tables.gzip_csv([["1"] * len(header)], header)
        put(tmp_path, data if name != "apachePredVar" else gzip.compress(gzip.decompress(data) + b"\xff\n"), name)
    with pytest.raises(extract.ExtractError, match="apachePredVar at .* at byte") as e:
        etl.build(spark, f"file://{tmp_path}")
    assert e.value.reason == "undecodable-table"


def test_recorded_rows_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.05, True, 0.7), (2, 0.1, True, None), (3, 0.1, False, 0.9)], "draw int, alpha double, certified boolean, tau double")
    sinks.write_csv(rows, f"file://{tmp_path}/o", rows.columns)
    schema = "draw int, alpha double, certified boolean, tau double"
    assert [tuple(r) for r in tables.read_recorded(spark, f"file://{tmp_path}/o", schema, alpha=0.1, certified=True).collect()] == [(2, 0.1, True, None)]
    assert tables.read_recorded(spark, f"file://{tmp_path}/o", schema, alpha=0.2).count() == 0
