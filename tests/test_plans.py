"""The cleaning path over planted extracts, sinks, streaming, and honest certification runs."""

from __future__ import annotations

import json

import populations
import pytest
from pyspark.sql import functions as F

from quorumlake import constants as C
from quorumlake.functions import heads
from quorumlake.operators import sites, splits
from quorumlake.plans import certify as plan
from quorumlake.plans import etl, preflight
from quorumlake.sources import sinks, tables
from quorumlake.streaming import scorer


class Planted:
    """A small extract of five tables, to be bent by tests."""

    def __init__(self, n: int = 40):
        self.n = n
        self.patient = [self.stay(i) for i in range(1, n + 1)]
        self.aps = [[str(i), str(i), *["1"] * 7, *["5"] * (len(C.APS_NUMERIC) - 8), "0.5"] for i in range(1, n + 1)]
        for row in self.aps:
            row[2 + C.APS_NUMERIC.index("temperature")] = "37.0"
        self.apv = [[str(i), str(i), *["0"] * len(C.APV_NUMERIC)] for i in range(1, n + 1)]
        self.result = [[str(i), str(i), "IVa", "0.2"] for i in range(1, n + 1)]

    @staticmethod
    def stay(i: int, **over: str) -> dict[str, str]:
        base = dict(zip(C.REQUIRED_COLUMNS["patient"], (str(i), str(1000 + i), "Female", "60", "Caucasian", str(i % 5), "170", "-14", "Floor", "Expired" if i % 4 == 0 else "Alive", "2015", "MICU", "Floor", "1", "admit", "70", "Alive", f"p{i}"), strict=True))
        return base | over

    def write(self, folder) -> str:
        cols = C.REQUIRED_COLUMNS
        data = {"patient": [[r[c] for c in cols["patient"]] for r in self.patient], "hospital": [[str(i), "100 - 249", "t", "South"] for i in range(5)], "apacheApsVar": self.aps, "apachePredVar": self.apv, "apachePatientResult": self.result}
        for t, rows in data.items():
            (folder / f"{t.lower()}.csv.gz").write_bytes(tables.gzip_csv(rows, [c.upper() if t == "hospital" else c for c in cols[t]], mark=t == "patient"))
        return f"file://{folder}"


def reason(spark, folder) -> str:
    with pytest.raises(tables.ExtractError) as e:
        etl.build(spark, folder)
    return e.value.reason


def test_feature_names():
    names = etl.feature_names()
    assert len(names) == len(set(names)) == C.N_FEATURES and "unittype=EMPTY" in names
    etl.assert_no_leaks(names)
    for bad in ("hospitalid", "aps_diedinhospital", "wardid__missing", "unitdischargestatus=Expired"):
        with pytest.raises(tables.ExtractError, match="leak-column"):
            etl.assert_no_leaks([*names, bad])


def test_a_planted_extract(spark, tmp_path):
    p = Planted()
    p.patient += [p.stay(101, age="> 89"), p.stay(102, age=""), p.stay(103, age="17"), p.stay(104, hospitaldischargestatus=""), p.stay(105, hospitalid="x"),
                  p.stay(106, patienthealthsystemstayid="1001", unitvisitnumber="2"), p.stay(107, patienthealthsystemstayid=""), p.stay(108, patienthealthsystemstayid="", ethnicity='With "quotes",\nlines')]
    p.aps[1][2 + C.APS_NUMERIC.index("heartrate")] = "-1"
    p.aps[2][2 + C.APS_NUMERIC.index("heartrate")] = ""
    p.aps[3][2 + C.APS_NUMERIC.index("fio2")] = "21"
    p.aps.append(["99", "1", *["1"] * 7, *["200"] * (len(C.APS_NUMERIC) - 7)])
    p.result += [["500", "2", "IV", "0.9"], ["1", "3", "IVa", "0.7"], ["501", "107", "IVa", "-1"], ["502", "107", "IV", "0.4"]]
    got = etl.build(spark, p.write(tmp_path))
    assert {r["name"]: (r["n"], r["matches"]) for r in etl.release_check(got).collect()}["sites"][1] is False
    rows = {r["stay"]: r for r in got.features.collect()}
    assert sorted(rows) == [*range(1, 41), 101, 107, 108]
    assert rows[101]["age"] == 90.0 and rows[101]["age_masked"] == 1.0 and rows[1]["age_masked"] == 0.0
    assert rows[1]["aps_heartrate"] == 5.0 and rows[2]["aps_heartrate"] is None and rows[2]["aps_heartrate__missing"] == 1.0 and rows[3]["aps_heartrate"] is None
    assert rows[4]["aps_fio2"] == 0.21 and rows[107]["aps_present"] == 0.0 and rows[107]["aps_ph__missing"] == 1.0
    assert rows[2]["comparator"] == 0.2 and rows[3]["comparator"] == 0.7 and rows[107]["comparator"] is None
    assert rows[108]["ethnicity=OTHER"] == 1.0 and rows[1]["pre_icu_hours"] == pytest.approx(14 / 60)
    ledger = {r["step"]: (r["n_rows"], r["n_sites"]) for r in got.ledger.collect()}
    assert ledger["raw-unit-stays"][0] == 48 and ledger["site-parseable"] == (47, 5) and ledger["adult"][0] == 44 and ledger["first-stay"] == (43, 5)
    assert ledger["apache-aps-linked"][0] == 40 and set(ledger) == set(C.ATTRITION_STEPS)
    assert etl.build(spark, f"file://{tmp_path}", arm="apache-complete").features.count() == 40


@pytest.mark.parametrize("bend, want", [
    (lambda p: p.patient.append(p.stay(1)), "duplicate-stay-id"),
    (lambda p: p.patient.append(p.stay(200, hospitaldischargestatus="Transferred")), "unknown-outcome-level"),
    (lambda p: p.patient.extend(p.stay(200 + i, gender="weird") for i in range(9)), "categorical-level-drift"),
    (lambda p: p.aps.__setitem__(slice(None), [[r[0], r[1] + ".0", *r[2:]] for r in p.aps]), "unparseable-join-key"),
    (lambda p: p.aps.__setitem__(slice(None), [[*r[:12], "-9", *r[13:]] for r in p.aps]), "unexpected-negative-sentinel"),
    (lambda p: p.aps.__setitem__(slice(None), [[*r[:12], "\\N", *r[13:]] for r in p.aps]), "unrecognised-null-token"),
])
def test_gates(spark, tmp_path, bend, want):
    p = Planted()
    bend(p)
    assert reason(spark, p.write(tmp_path)) == want


def test_coverage_and_outcome_gates(spark, tmp_path):
    p = Planted(240)
    p.aps = p.aps[:20]
    (tmp_path / "a").mkdir()
    assert reason(spark, p.write(tmp_path / "a")) == "apache-coverage-collapse"
    p = Planted(240)
    gone = {i for i in range(1, 201) if i % 4 == 0} | set(range(1, 90))  # some who died stay: the ratio needs a base
    p.aps = [r for r in p.aps if int(r[1]) not in gone]
    (tmp_path / "b").mkdir()
    assert reason(spark, p.write(tmp_path / "b")) == "outcome-informative-missingness"


def test_reading_failures(spark, tmp_path):
    folder = f"file://{tmp_path}"
    with pytest.raises(tables.ExtractError, match="missing-table"):
        tables.read_table(spark, folder, "patient")
    (tmp_path / "t.csv.gz").write_bytes(tables.gzip_csv([["1", "2"]], ["A", " a "]))
    with pytest.raises(tables.ExtractError, match="duplicate-header"):
        tables.read_table(spark, folder, "t", required=())
    (tmp_path / "t.csv.gz").write_bytes(tables.gzip_csv([["1", ""], [], ["3"], ["5", "x\ny", "extra"]], ["A", "b"], mark=True))
    with pytest.raises(tables.ExtractError, match="missing-column"):
        tables.read_table(spark, folder, "T", required=("c",))
    got = tables.read_table(spark, folder, "T", required=("a",))
    assert sorted(map(tuple, got.collect())) == [("1", ""), ("3", ""), ("5", "x\ny")] and tables.check_readable(got, "t") == 3
    data = tables.gzip_csv([[str(i), "y" * 50] for i in range(20_000)], ["a", "b"])
    (tmp_path / "t.csv.gz").write_bytes(data[: len(data) // 2])
    with pytest.raises(tables.ExtractError, match="truncated-table"):
        tables.check_readable(tables.read_table(spark, folder, "t", required=()), "t")
    assert [tables.header_case(h) for h in (["a", "b_c"], ["aB", "age"], ["aB", "c_d"])] == ["lower", "camel", "mixed"]


def test_sinks_refuse_records(spark, tmp_path):
    ok = spark.createDataFrame([("a", 1.5), ("b", float("nan"))], "k string, v double")
    sinks.write_csv(ok, f"file://{tmp_path}/o", ["k", "v"])
    assert sorted(map(tuple, spark.read.csv(f"file://{tmp_path}/o", header=True).collect())) == [("a", "1.5"), ("b", None)]
    for bad in (ok.withColumnRenamed("k", "site_id"), spark.range(600), ok.withColumn("a", F.sequence(F.lit(1), F.lit(600))), ok.withColumn("s", F.struct(F.lit(1).alias("x")))):
        with pytest.raises(sinks.ComplianceError):
            sinks.assert_aggregate_only(bad, "out")
    assert json.loads(sinks.report_json({0.05: {"v": float("nan"), "s": {2, 1}}})) == {"0.05": {"v": None, "s": [1, 2]}}
    with pytest.raises(sinks.ComplianceError):
        sinks.report_json({"a": {"stay_id": 1}})
    assert sinks.content_digest(ok) == sinks.content_digest(ok.repartition(3)) != sinks.content_digest(ok.limit(1))


def test_certify_is_honest(spark):
    cohort, target = populations.draw_cohort(spark, 208, 1001).persist(), populations.draw_cohort(spark, 24, 500_001, prefix="t-").persist()
    got = plan.certify(splits.with_split(cohort, splits.split_sites(cohort.select("site_label").distinct(), 1)), target, modes=("baseline", "bbse"))
    rung = got.report["certified"][0.10]
    pool = plan.score(target, got.head).withColumn("site_id", F.col("site_label"))
    risk = sites.pool_risk(sites.threshold_counts(pool)).where(F.col("tau_idx") == rung["tau_idx"]).first()
    assert risk["risk"] <= 0.10 and risk["coverage"] > 0.8
    told = plan.render(got.report)
    assert "[certified] risk at most 0.10: threshold" in told and "[estimated]" in told and "[partition] answered" in told
    own = plan.stripped(got, [f"f{j}" for j in range(8)], top=3)
    assert own["n_answered"] == got.report["partition"]["answered"] and [a["feature"][0] for a in own["abstention"]] == ["f"] * 3 and sinks.report_json(own)
    assert all(":" in r for r in got.report["reasons"].values()) and not set(got.report["reasons"]) & set(got.report["certified"])
    assert got.report["estimated"]["ci"][0] <= got.report["estimated"]["risk"] <= got.report["estimated"]["ci"][1]


def test_the_gate_looks_at_every_depth(spark):
    most = sinks.C.MAX_SEQUENCE
    long = f"sequence(1, {most + 1})"
    for leak in (f"struct({long} AS v)", "map('Stay_ID', 1)", f"array(array(1), {long})", f"map('a', {long})", "array(map('x', 1))", "struct(map('k', struct(1 AS patient_id)) AS m)",
                 f"map_from_arrays(transform({long}, i -> cast(i AS string)), {long})", "map('ok', map('site_raw', 2))"):
        with pytest.raises(sinks.ComplianceError):
            sinks.assert_aggregate_only(spark.sql(f"SELECT {leak} AS c"), "out")
    fine = "SELECT struct(sequence(1, 5) AS v) AS a, map('k', array(1)) AS b, array(map('j', 1), NULL) AS c, CAST(NULL AS map<string,int>) AS d, 1 AS e"
    sinks.assert_aggregate_only(spark.sql(fine), "out")


def test_certify_declines_and_refuses(spark):
    cohort = populations.draw_cohort(spark, 60, 5, populations.Population(most=60))
    split = splits.split_sites(cohort.select("site_label").distinct(), 1)
    target = populations.draw_cohort(spark, 12, 6, populations.Population(most=40), prefix="t-")
    both = splits.with_split(cohort, split).persist()
    got = plan.certify(both, target)
    assert got.report["reason"] == "insufficient-clusters" and sum(got.report["partition"].values()) == target.count()
    assert "status: declined" in plan.render(got.report) and "[gate] insufficient-clusters" in plan.render(got.report) and sinks.report_json(got.report)
    assert "n_answered" not in plan.stripped(got, ["f"] * 8)
    with pytest.raises(ValueError, match="bad-oracle"):
        plan.certify(both, target, oracle="nothing")
    with pytest.raises(ValueError, match="bad-oracle"):
        plan.certify(both, target.withColumn("y", F.lit(None).cast("boolean")), oracle="y")
    with pytest.raises(ValueError, match="record-overlap"):
        plan.certify(both.withColumn("record_id", F.lit(1)), target.withColumn("record_id", F.lit(1)))
    for kw, text in (({"alphas": (0.2,)}, "bad-alpha"), ({"modes": ("x",)}, "bad-mode")):
        with pytest.raises(ValueError, match=text):
            plan.certify(both, target, **kw)
    with pytest.raises(ValueError, match="target-in-fit"):
        plan.certify(both, both.where("split = 'train'").select("site_label", "x"))
    with pytest.raises(ValueError, match="nonfinite"):
        plan.certify(both.withColumn("x", F.transform("x", lambda v: F.lit(float("nan")))), target)
    with pytest.raises(ValueError, match="two-shifts"):
        populations.draw_cohort(spark, 2, 1, label_base_rate=0.2, concept_intercept=1.0)


def test_streaming_scores(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 00:{m:02d}:00", [float(m - 5)]) for m in range(30)], "at string, x array<double>").withColumn("at", F.col("at").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in")
    head = heads.Head((1.0,), 0.0, (0.0,), (1.0,))
    stream = scorer.gate(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), head, 0.9)
    q = scorer.windowed_partition(stream, "at").writeStream.outputMode("complete").format("memory").queryName("parts").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select sum(answered) a, sum(below_threshold) b, count(*) n from parts").first()
    assert got["a"] + got["b"] == 30 and got["n"] == 3 and got["b"] == 5


def test_preflight(spark, tmp_path):
    p = Planted()
    heart = 2 + C.APS_NUMERIC.index("heartrate")
    for row in p.aps[:20]:
        row[heart] = "" if int(row[1]) % 4 == 0 or int(row[1]) < 4 else row[heart]
    p.aps = [r for r in p.aps if r[1] != "40"]
    folder = p.write(tmp_path)
    with pytest.raises(tables.ExtractError) as e:
        preflight.preflight(spark, folder)
    assert e.value.reason == "reference-mismatch"
    got = preflight.preflight(spark, folder, expect_reference=False, least=5)
    assert {r["name"]: (r["n"], r["matches"]) for r in got.identities.collect()}["apacheApsVar"] == (39, False)
    per = {r["site_id"]: r for r in got.per_site.collect()}
    assert len(per) == 5 and all(r["found"] and r["region"] == "South" and r["n"] == 8 for r in per.values())
    one = per[f"{C.SITE_PREFIX}0"]
    assert one["place"] == 1 and one["n_aps"] == 7 and one["n_apv"] == 8 and one["share_aps"] == 7 / 8
    row = {r["name"]: r for r in got.missing.collect()}["aps_heartrate"]
    # stays 1 to 3 and five of those that died lack the cell; four of the other 31 died
    assert (row["n_absent"], row["n_present"]) == (8, 31) and row["prev_absent"] == 5 / 8 and row["prev_present"] == 4 / 31
    known = {r["name"]: (r["n"], r["expected"]) for r in got.identities.collect()}
    assert known["sites"] == (5, 208) and known["patients"] == (40, 139367) and known["unit-stays"] == (40, 200859)
    heart = {r["name"]: r for r in got.cells.where("table = 'apacheApsVar'").collect()}["heartrate"]
    gone = sum(not row[2 + C.APS_NUMERIC.index("heartrate")] for row in p.aps)
    assert (heart["n"], heart["n_empty"], heart["n_value"], heart["p50"], heart["n_unparseable"]) == (39, gone, 39 - gone, 5.0, 0)
    assert got.cells.count() == len(C.APS_NUMERIC) + len(C.APV_NUMERIC) and got.tokens.count() == 0
    spread = {r["name"]: r for r in got.dispersion.where("table = 'apacheApsVar'").collect()}["heartrate"]
    assert spread["sites"] == 5 and spread["mean_minus_one"] == 0.0 and spread["sd_missing"] > 0
    windows = {(r["name"], r["window"]): r["n"] for r in got.windows.collect()}
    assert windows["temperature", "celsius"] == 39 and windows["fio2", "fraction"] == 39 and windows["fio2", "percent"] == 0
    assert {(r["table"], r["rows"]): r["keys"] for r in got.rows_per_stay.collect()}["apacheApsVar", "1"] == 39
    assert {r["name"]: r["n"] for r in got.ordinals.groupBy("name").agg(F.sum("n").alias("n")).collect()} == {"eyes": 39, "motor": 39, "verbal": 39}
    assert {r["name"]: (r["n"], r["n_hours"], r["median_hours"]) for r in got.stay_hours.collect()}["aps-present"] == (39, 0, None)
    assert not got.projection["sites_ok"] and any(a.startswith("too-few-sites") for a in got.aborts)
    assert [r["name"] for r in got.worst.collect()] == ["aps_heartrate"] and any("aps_heartrate" in w for w in got.warnings)


def test_summaries_keep_and_mark_earlier_blocks(spark, tmp_path):
    to, names = f"file://{tmp_path}/summary", ("one", "two", "three")
    sinks.write_summary(spark, to, "Run", names, {"one": {"v": 1}, "two": {"v": float("nan")}}, {"mode": "full"})
    text = sinks.write_summary(spark, to, "Run", names, {"one": {"v": 2}, "three": {"v": 3}}, {"mode": "quick"})
    held = sinks.read_summary(spark, to)
    assert list(held) == ["one", "two", "three"] and f"## two{sinks.PRESERVED}" in text and f"## one{sinks.PRESERVED}" not in text
    read = {k: json.loads(v.removeprefix("```json").removesuffix("```")) for k, v in held.items()}
    assert read == {"one": {"_run": {"mode": "quick"}, "v": 2}, "two": {"_run": {"mode": "full"}, "v": None}, "three": {"_run": {"mode": "quick"}, "v": 3}}
    again = sinks.write_summary(spark, to, "Run", names, {}, {"mode": "late"})
    assert again.count(sinks.PRESERVED) == 3 and sinks.read_summary(spark, f"{to}-none") == {}
    with pytest.raises(sinks.ComplianceError):
        sinks.write_summary(spark, to, "Run", names, {"one": {"patient_id": 1}}, {})
    with pytest.raises(ValueError, match="unknown-section"):
        sinks.write_summary(spark, to, "Run", names, {"four": {}}, {})


def test_weights_must_be_finite(spark):
    counts = spark.createDataFrame([(0, 10, 0, 0.6, 5, 5, 1, 1, float("inf"))], "site_id int, n long, tau_idx int, tau double, ans_pos long, ans_neg long, err_pos long, err_neg long, rho double")
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="bad-weight"):
            sites.atoms(counts, 0.1, rho=bad)
    with pytest.raises(Exception, match="bad-weight"):
        sites.atoms(counts, 0.1, rho=F.col("rho")).collect()
