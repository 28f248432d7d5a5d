"""Site statistics, walks, intervals, identifiers and heads against closed forms and plain loops."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlake import constants as C
from quorumlake.functions import cells, heads, identifiers, intervals
from quorumlake.operators import betting, explain, order_statistics, profile, ranks, relational, shift, sites, splits

RECORDS = "site_id int, y boolean, err boolean, score double"


def records(spark, *groups):
    """groups: (site, n, n_err, score)."""
    return spark.createDataFrame([(s, i % 2 == 0, i < k, sc) for s, n, k, sc in groups for i in range(n)], RECORDS)


def test_grid_is_the_evenly_spaced_doubles():
    assert C.TAU_GRID == np.linspace(0.55, 0.99, 23).tolist() and C.TAU_GRID[2] != 0.59 or len(C.TAU_GRID) == 23


def test_pool_risk_closed_form(spark):
    counts = sites.threshold_counts(records(spark, (0, 50, 10, 0.9), (1, 400, 8, 0.9)), [0.5, 0.95])
    rows = {r["tau_idx"]: r for r in sites.pool_risk(counts).collect()}
    assert rows[0]["risk"] == pytest.approx(0.08) and rows[1]["risk"] is None and rows[0]["coverage"] == 1.0
    assert {r["tau_idx"]: r["exceed_share"] for r in sites.exceedance(counts, 0.1).collect()}[0] == 0.5


def test_atoms_ties_empty_sites_and_caps(spark):
    dim = spark.createDataFrame([(0,), (1,)], "site_id int")
    counts = sites.threshold_counts(records(spark, (0, 1, 1, 0.6)), [0.6], dim)
    z = {r["site_id"]: r["z"] for r in sites.atoms(counts, 0.05).collect()}
    assert z[0] == pytest.approx(0.0095 + 0.05) and z[1] == 0.05
    big = sites.threshold_counts(records(spark, *[(i, 20, 0, 0.9) for i in range(140)], *[(1000 + i, 2000, 400, 0.9) for i in range(3)]), [0.55])
    assert sites.atoms(big, 0.05).agg(F.max("z"), F.min("z")).first()[0] <= 1.0


def test_atoms_against_a_loop(spark):
    r = random.Random(1)
    rows = [(r.randint(0, 5), r.random() < 0.4, r.random() < 0.3, r.choice([0.55, 0.6, 0.71, r.random()])) for _ in range(400)]
    taus = [0.55, 0.6, 0.8]
    got = {(x["site_id"], x["tau_idx"]): x["z"] for x in sites.atoms(sites.threshold_counts(spark.createDataFrame(rows, RECORDS), taus), 0.1, cap=50, rho=2.5).collect()}
    for s in range(6):
        own = [x for x in rows if x[0] == s]
        for t, tau in enumerate(taus):
            total = sum((2.5 if y else 1.0) / 2.5 * (e - 0.1) for _, y, e, sc in own if sc >= tau)
            assert got[s, t] == pytest.approx(min(len(own), 50) / (50 * len(own)) * total + 0.1)


def loop_wealth(z, alpha, delta):
    goal, top, log, mu, s2, c = math.log(1 / delta), 0.0, 0.0, 0.5, 0.25, 1.0
    for v in z:
        stake = min(math.sqrt(2 * goal / (max(s2, 1e-8) * len(z))), 0.9 / (1 - alpha))
        log += math.log(max(1 + stake * (alpha - v), 1e-300))
        top, c = max(top, log), c + 1
        mu += (v - mu) / c
        s2 += ((v - mu) ** 2 - s2) / c
    return top


def test_wealth_against_a_loop_and_its_level(spark):
    rng = np.random.default_rng(3)
    seqs = [(rng.random(80) < 0.05).astype(float).tolist() for _ in range(300)] + [np.clip(rng.normal(0.002, 0.002, 80), 0, 1).tolist() for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(seqs)), "i int, z array<double>")
    got = {r["i"]: r["w"] for r in df.select("i", betting.wealth(F.col("z"), 0.05, 0.05).alias("w")).collect()}
    assert all(got[i] == pytest.approx(loop_wealth(z, 0.05, 0.05), abs=1e-9) for i, z in enumerate(seqs))
    goal = math.log(20)
    assert sum(got[i] >= goal for i in range(300)) / 300 <= 0.08 and sum(got[i] >= goal for i in range(300, 350)) >= 45, sorted(got.values())


def test_walk_stops_at_the_first_failure(spark):
    order = spark.createDataFrame([(1, 0, 0.9), (2, 1, 0.8), (3, 2, 0.7), (4, 3, 0.6)], "step int, tau_idx int, tau double")
    tests = spark.createDataFrame([(0, True), (1, True), (2, False), (3, True)], "tau_idx int, rejected boolean")
    got = {r["tau_idx"]: (r["in_prefix"], r["deployed"]) for r in betting.walk(order, tests).collect()}
    assert got == {0: (True, False), 1: (True, True), 2: (False, False), 3: (False, False)}


def test_intervals():
    assert intervals.clopper_pearson(0, 20, 0.05) == pytest.approx((0.0, 1 - 0.025 ** (1 / 20)))
    low, high = intervals.clopper_pearson(7, 20, 0.05)
    assert intervals.incomplete_beta(low, 7, 14) == pytest.approx(0.025) and intervals.incomplete_beta(high, 8, 13) == pytest.approx(0.975)
    for n, a in ((1, 0.1), (17, 0.05), (40, 0.1)):
        k = math.floor(a * n + 1e-9)
        want = 1 - sum(math.comb(n, i) * a**i * (1 - a) ** (n - i) for i in range(k + 1))
        assert intervals.binomial_exceedance(n, a) == pytest.approx(want)
    assert intervals.odds_ratio(0.1875, 0.05, 0.60, 0.10) == pytest.approx(3.0)
    assert intervals.odds_ratio_box((0.1, 0.2), (0.05, 0.06), (0.5, 0.6), (0.1, 0.11))[0] <= intervals.odds_ratio(0.15, 0.055, 0.55, 0.105) <= intervals.odds_ratio_box((0.1, 0.2), (0.05, 0.06), (0.5, 0.6), (0.1, 0.11))[1]


def test_wilson(spark):
    got = spark.createDataFrame([(3, 20), (60, 200), (0, 0)], "k int, n int").select(intervals.wilson_lower(F.col("k"), F.col("n"))).collect()
    assert got[0][0] < 0.1 < got[1][0] and got[2][0] == 0.0


def test_cells(spark):
    raw = ["1.5", " -1 ", "", None, "\\N", "-3", "0.21", "21", "98.6", "1e400", "12d", "NaN", "> 89", "141258.0", "٣"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(raw)], "i int, c string")
    c = F.col("c")
    got = {r["i"]: r for r in df.select("i", cells.maybe_float(c).alias("f"), cells.maybe_int(c).alias("n"), cells.age_years(c).alias("a"), cells.sentinel_cell(c, "fio2").alias("o"), cells.sentinel_cell(c, "temperature").alias("t"), cells.sentinel_cell(c).alias("s")).collect()}
    assert [got[i]["f"] for i in (0, 2, 3, 4, 9, 10, 11, 14)] == [1.5] + [None] * 7
    assert got[13]["n"] is None and got[1]["n"] == -1 and got[12]["a"] == 90.0 and got[0]["a"] is None
    assert got[6]["o"]["value"] == got[7]["o"]["value"] == 0.21 and got[0]["o"]["status"] == "out_of_window"
    assert got[8]["t"]["value"] == pytest.approx(37.0)
    assert [got[i]["s"]["status"] for i in (0, 1, 2, 3, 4, 5)] == ["ok", "minus_one", "empty", "empty", "unparseable", "other_negative"]


def test_site_identifiers(spark):
    make = lambda values: spark.createDataFrame([(v,) for v in values], "s string")
    merged = identifiers.dense_sites(make(["H1", "H1 ", "H​1", "H2"]), "s")
    assert {(r["s"], r["site_id"]) for r in merged.collect()} == {("H1", 0), ("H1 ", 0), ("H​1", 0), ("H2", 1)}
    for bad in (["h1", "H1"], ["1", "1.0"], ["007", "7"], ["a", None], ["straße", "STRASSE"]):
        with pytest.raises(identifiers.SiteCollision):
            identifiers.dense_sites(make(bad), "s")
    far = ["123456789012345678", "123456789012345679"]
    assert identifiers.dense_sites(make(far), "s").select("site_id").distinct().count() == 2
    nums = spark.createDataFrame([(1.0,), (1.5,), (float(2**53),)], "v double").select(identifiers.canonical_number_site(F.col("v"))).collect()
    assert [r[0] for r in nums] == ["1", None, None]


def test_labels(spark):
    df = spark.createDataFrame([("a",), ("b",)], "l string")
    assert [r["y"] for r in identifiers.binary_label(df, "l", "b").orderBy("l").collect()] == [False, True]
    for rows, positive in (([("a",), ("b",), ("c",)], "a"), ([("a",), (None,)], "a"), ([("a",)], "b")):
        with pytest.raises(identifiers.LabelError):
            identifiers.binary_label(spark.createDataFrame(rows, "l string"), "l", positive)
    assert not identifiers.binary_label(spark.createDataFrame([("a",)], "l string"), "l", "b", allow_absent_positive=True).first()["y"]


def test_head_fit_and_explanations(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 3)) * [1, 5, 0] + [0, 2, 7]
    y = rng.random(800) < 1 / (1 + np.exp(-(x[:, 0] - 0.2 * x[:, 1])))
    df = spark.createDataFrame([(i, a.tolist(), bool(b)) for i, (a, b) in enumerate(zip(x, y))], "i int, x array<double>, y boolean")
    head = heads.fit_head(df)
    assert head.sd[2] == 1.0 and head.coef[0] > 0 > head.coef[1]
    z = (x - np.array(head.mu)) / np.array(head.sd)
    w, b = np.zeros(3), 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(z @ w + b)))
        g = np.append(z.T @ (p - y) + w, (p - y).sum())
        zz = np.column_stack([z, np.ones(800)])
        h = (zz * (p * (1 - p))[:, None]).T @ zz + np.diag([1, 1, 1, 0])
        step = np.linalg.solve(h, g)
        w, b = w - step[:3], b - step[3]
    assert np.allclose(head.coef, w, atol=1e-4) and head.intercept == pytest.approx(b, abs=1e-4)
    rows = df.select("i", "x", head.attribution(F.col("x")).alias("phi"), head.logit(F.col("x")).alias("logit"))
    rows = rows.withColumns(heads.counterfactual(head, F.col("x"), F.col("logit"), 0.9)).withColumns(heads.abstention(F.col("logit"), F.col("phi"), 0.9)).collect()
    for r in rows[:200]:
        assert sum(r["phi"]) + head.intercept == pytest.approx(r["logit"]) and r["cf_answered"]
        if r["declined"]:
            assert np.linalg.norm(r["cf_move"]) <= min(abs(v) for v in r["cf_single"] if v is not None) + 1e-9


def test_auc_with_ties(spark):
    r = random.Random(2)
    rows = [(r.choice([0.1, 0.2, 0.5, None]), r.random() < 0.4) for _ in range(300)]
    got = ranks.rank_auc(spark.createDataFrame(rows, "v double, y boolean"), "v", "y").first()["auc"]
    pos, neg = [v for v, y in rows if y and v is not None], [v for v, y in rows if not y and v is not None]
    assert got == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    assert ranks.rank_auc(spark.createDataFrame([(1.0, True)], "v double, y boolean"), "v", "y").first()["auc"] is None


def test_first_stay_and_versions(spark):
    rows = [(1, 10, 1.0, -14.0), (1, 11, 1.0, -22.0), (None, 12, None, None), (None, 13, 1.0, 0.0), (2, 14, None, 5.0), (2, 15, 3.0, -5.0)]
    df = spark.createDataFrame(rows, "adm int, stay int, visit double, off double")
    assert sorted(r["stay"] for r in relational.first_stay(df, admission="adm", stay="stay", visit="visit", offset="off").collect()) == [10, 12, 13, 15]
    res = spark.createDataFrame([(1, "IV", 0.11), (1, "IVa", None), (2, "IV", 0.33), (3, "X", 0.1)], "k int, v string, p double")
    assert {(r["k"], r["p"]) for r in relational.prefer_version(res, "k", "v", "p", ("IVa", "IV")).collect()} == {(1, None), (2, 0.33)}


def test_splits(spark):
    all_ = spark.createDataFrame([(f"s{i:03d}",) for i in range(208)], "site_label string")
    a = {r["site_label"]: r["split"] for r in splits.split_sites(all_, 1).collect()}
    b = {r["site_label"]: r["split"] for r in splits.split_sites(all_.repartition(5), 1).collect()}
    assert a == b and sorted(map(list(a.values()).count, ("train", "aux", "cal"))) == [42, 83, 83]
    held = [r["split"] for r in splits.hold_out_sites(all_, 0).collect()]
    assert [held.count(s) for s in ("target", "train", "aux", "cal")] == [24, 73, 36, 75]
    with pytest.raises(ValueError, match="too-few-sites"):
        splits.hold_out_sites(all_.limit(100), 0)
    with pytest.raises(ValueError, match="site-overlap"):
        splits.assert_disjoint(spark.createDataFrame([("A", "train"), ("a", "cal")], "site_label string, split string"))


def test_shift_declines_in_order(spark):
    rates = spark.createDataFrame([(i, 100, 20, 16, 4) for i in range(30)], "site_id int, n long, pos long, pred_pos long, pred_neg long")
    pool = lambda rows: spark.createDataFrame(rows, "site_id string, pred boolean")
    assert shift.fit_shift(rates, pool([])).reason == "bbse-empty-target"
    assert shift.fit_shift(rates, pool([("a", True), ("b", False)])).reason == "bbse-target-clustering"
    assert shift.fit_shift(rates.withColumn("pos", F.lit(0)), pool([("a", True)] * 5)).reason == "bbse-degenerate-bootstrap"
    assert shift.fit_shift(rates.withColumn("pred_pos", F.lit(2)), pool([("a", True)] * 5)).reason == "bbse-ill-conditioned"
    assert shift.fit_shift(rates, pool([("a", True)] * 500)).reason == "bbse-misspecified"
    good = shift.fit_shift(rates, pool([("a", i % 5 == 0) for i in range(5000)]))
    assert not good.declined and good.rho_lo < good.rho_point < good.rho_hi and set(good.diagnostics) == set(shift.DIAGNOSTICS)


def test_bins_keep_empty_ones(spark):
    df = spark.createDataFrame([(0.0,), (0.2,), (0.5,)], "v double")
    got = [(r["bin"], r["n"], r["m"]) for r in explain.binned(df, F.col("v"), [0.0, 0.2, 0.4, 1.0], {"m": F.avg("v")}, right_closed=True).orderBy("bin").collect()]
    assert got == [(0, 2, 0.1), (1, 0, None), (2, 1, 0.5)]
    assert [r["n"] for r in explain.binned(df, F.col("v"), [0.0, 0.2, 0.4, 1.0], {}).orderBy("bin").collect()] == [1, 1, 1]


def test_strata_take_the_last_row_and_show_misses(spark):
    per = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "site_id int, n int")
    dim = spark.createDataFrame([(1, 1, "a"), (1, 2, " b "), (2, 1, "c"), (2, 3, "  "), (None, 9, "x")], "site int, k int, region string")
    got = {r["site_id"]: (r["region"], r["found"]) for r in sites.with_strata(per, dim, "site", "k", ["region"]).collect()}
    assert got == {1: ("b", True), 2: (None, True), 3: (None, False)}
    assert sites.with_strata(per.limit(0), dim, "site", "k", ["region"]).isEmpty()


def test_label_order_and_dense_sites(spark):
    labels = spark.createDataFrame([("h_10",), ("h_9",), ("x",), ("a",), ("g_9",)], "label string")
    assert [r["label"] for r in sites.in_label_order(labels, "label").orderBy("place").collect()] == ["g_9", "h_9", "h_10", "a", "x"]
    rows = spark.createDataFrame([(i,) for i in (4, 7, 7, 9, 2)], "site_id int")
    got = sites.subset_sites(rows, F.col("site_id") > 3).collect()
    assert sorted((r["site_id"], r["dense_id"]) for r in got) == [(4, 0), (7, 1), (7, 1), (9, 2)]


def test_outcome_missing_takes_first_rows_as_they_stand(spark):
    # stay 1: its first row lacks the cell, the later value does not count
    rows = spark.createDataFrame([(1, 1, None, True), (1, 2, 5.0, True), (2, 1, 3.0, False), (3, 4, None, False), (4, 1, 1.0, True)], "stay int, k int, v double, y boolean")
    r = profile.outcome_missing(rows, "stay", "k", ["v"], F.col("y")).first()
    assert (r["n_present"], r["n_absent"], r["prev_present"], r["prev_absent"], r["ratio"]) == (2, 2, 0.5, 0.5, 1.0)
    assert profile.worst_missing(profile.outcome_missing(rows, "stay", "k", ["v"], F.col("y")), 3).isEmpty()


def test_leak_alarm(spark):
    rows = spark.createDataFrame([(i > 4, float(i), float(i % 2)) for i in range(10)], "y boolean, s double, a double")
    r = ranks.leak_alarm(rows, "s", "a", "y").first()
    assert r["auc"] == 1.0 and r["auc_alarm"] and r["ablation_alarm"] and abs(r["ablation_drop"] - (1 - r["auc_ablated"])) < 1e-12
    r = ranks.leak_alarm(rows.where("y"), "s", "a", "y").first()
    assert r["auc"] is None and not r["auc_alarm"] and not r["ablation_alarm"]


def test_browsing_and_leading_features(spark):
    rows = spark.createDataFrame([(11, 1, 0.6, [1.0, -3.0, 3.0]), (21, 1, 0.7, [0.0, 0.0, 1.0]), (30, 2, 0.6, [])], "record_id int, site_id int, score double, phi array<double>")
    assert [r["record_id"] for r in explain.browse(rows, contains="1", site=1, score=(0.6, 0.7)).collect()] == [11]
    got = explain.leading_features(rows, "record_id", "phi", 2).collect()
    assert sorted((r["record_id"], r["feature"], r["n_shown"], r["n_total"]) for r in got) == [(11, 1, 2, 3), (11, 2, 2, 3), (21, 0, 2, 3), (21, 2, 2, 3)]


def test_first_rows_are_found_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 7 as k", "id as s")
    plan = relational.keep_least_surrogate(df, ["k"], "s")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


# ---- exact order statistics -------------------------------------------------


def test_quantiles_of_many_groups_narrow_in_on_ranks(spark):
    r = np.random.default_rng(3)
    groups = {
        "wide": np.concatenate([10.0 ** r.uniform(-300, 300, 300), -(10.0 ** r.uniform(-300, 300, 300))]), "same": np.full(500, 2.5), "ties": r.integers(0, 3, 900).astype(float),
        "zero": np.array([0.0, -0.0, 5e-324, -5e-324, 1.0]), "ends": np.array([float("inf"), 1.0, float("-inf"), 2.0, 3.0]), "one": np.array([7.0]), None: r.normal(0, 1, 400), "close": 1e9 + r.random(700) * 1e-4,
    }
    rows = [(g, float(v)) for g, own in groups.items() for v in own] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {x["g"]: x for x in order_statistics.exact_quantiles(df, "v", {"a": 0.0, "b": 0.01, "c": 0.37, "d": 0.5, "e": 1.0}, ["g"], few=8).collect()}
    assert set(got) == set(groups)
    for g, own in groups.items():
        assert got[g]["n"] == len(own)
        for name, p in (("a", 0.0), ("b", 0.01), ("c", 0.37), ("d", 0.5), ("e", 1.0)):
            at = p * (len(own) - 1)
            low, high = np.sort(own)[[math.floor(at), math.ceil(at)]]
            assert got[g][name] == pytest.approx(low if low == high or at == math.floor(at) else (1 - at % 1) * low + at % 1 * high, rel=1e-12)
    whole = order_statistics.exact_quantiles(df.where("g = 'ties'"), "v", {"m": 0.5}).first()
    assert (whole["n"], whole["m"]) == (900, float(np.median(groups["ties"])))
    empty = order_statistics.exact_quantiles(df.limit(0), "v", {"m": 0.5}).first()
    assert (empty["n"], empty["m"]) == (0, None)


def test_rows_before_are_counted_over_ranges(spark):
    r = random.Random(2)
    rows = sorted({(g, r.randrange(1000)) for g in ("a", "b", None) for _ in range(500)}, key=str)
    df = spark.createDataFrame([(g, v, r.randint(1, 4)) for g, v in rows], "g string, v int, n long")
    plain, got = df.collect(), order_statistics.with_rows_before(df, "v", by=["g"]).collect()
    assert len(got) == len(plain)
    for x in got:
        assert x["before"] == sum(p["n"] for p in plain if p["g"] == x["g"] and p["v"] < x["v"])
    assert order_statistics.with_rows_before(df.limit(0), "v", by=["g"]).count() == 0


def test_splits_cover_all_sites(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "site_label string")
    splits.assert_covering(df, spark.createDataFrame([("a", "cal"), ("b", "aux")], "site_label string, split string"))
    for rows in ([("a", "cal")], [("a", "cal"), ("b", "aux"), ("c", "aux")]):
        with pytest.raises(ValueError, match="split-coverage"):
            splits.assert_covering(df, spark.createDataFrame(rows, "site_label string, split string"))


def test_dense_sites_keep_every_record(spark):
    rows = [("H1", 1), ("H1 ", 2), ("H2", 3), ("H2", 4), ("H1", 5)]
    got = identifiers.dense_sites(spark.createDataFrame(rows, "raw string, n int"), "raw").collect()
    assert sorted((r["n"], r["site_label"], r["site_id"]) for r in got) == [(1, "H1", 0), (2, "H1", 0), (3, "H2", 1), (4, "H2", 1), (5, "H1", 0)]
    again = identifiers.dense_sites(spark.createDataFrame(rows, "site_label string, n int"), "site_label")
    assert again.columns.count("site_label") == 1 and {r["site_label"] for r in again.collect()} == {"H1", "H2"}
    with pytest.raises(identifiers.SiteCollision):
        identifiers.dense_sites(spark.createDataFrame([("a", 1), (None, 2)], "raw string, n int"), "raw")


def test_attrition_of_orders_sorts_no_lines(spark, tmp_path):
    import duckdb

    from quorumlake import queries as core

    # lines by the hundred, orders that come twice, orders and lines without their match
    lines = [(o, i, 17.0 + (o * 7 + i) % 4) for o in range(1, 60) for i in range(o % 5 + (100 if o == 7 else 1))] + [(1000, 1, 20.0)]
    orders = [(o, o * 10, "OPF"[o % 3], 150000.0 + 1000 * (o % 90)) for o in range(1, 80)] + [(7, 70, "PFO"[0], 157000.0), (9, 90, "O", 159000.0), (13, 130, "P", 300000.0)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber bigint, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = core.QUERIES["cohort_predicates_attrition"](spark, str(tmp_path))
    assert "l_linenumber" not in got._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(core.ORACLES["cohort_predicates_attrition"]).fetchall())
