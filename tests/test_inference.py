"""Resampling as relations, step-wise orders, batched heads, replicated runs and criteria, against plain loops and closed forms."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlake import constants as C
from quorumlake.functions import heads, intervals
from quorumlake.operators import betting, explain, shift, sites
from quorumlake.operators.resampling import bootstrap, resampled
from quorumlake.operators.shift import stream_of
from quorumlake.operators.splits import replicate_splits, step_ranks
from quorumlake.plans import criteria, replicated
from quorumlake.plans.certify import certify

RATES = "site_id int, n long, pos long, pred_pos long, pred_neg long"


def picks(n: int, draw: int, stream: str, *keys: str) -> list[int]:
    return [int(hashlib.md5(":".join([str(C.SEED), stream, *keys, str(draw), str(i)]).encode()).hexdigest()[:12], 16) % n for i in range(1, n + 1)]


def test_draws_are_sums_over_seeded_picks(spark):
    rows = [(g, s, s * s + 1, 3 * s + ord(g)) for g in ("a", "b") for s in range(5 if g == "a" else 3)]
    df = spark.createDataFrame(rows, "g string, site_id int, u long, v long")
    got = {(r["g"], r["draw"]): (r["u"], r["v"]) for r in resampled(df, ["u", "v"], draws=40, seed=C.SEED, stream="x", by=["g"]).collect()}
    assert len(got) == 80
    for (g, draw), sums in got.items():
        own = [r for r in rows if r[0] == g]
        took = [own[i] for i in picks(len(own), draw, "x", g)]
        assert sums == (sum(r[2] for r in took), sum(r[3] for r in took))


def test_bootstrap_tops_up_draws_that_are_not_valid(spark):
    df = spark.createDataFrame([(s, 10, 1 if s == 0 else 0) for s in range(4)], "site_id int, n long, pos long")
    draws = resampled(df, ["n", "pos"], draws=200, seed=C.SEED, stream="t")
    plain = [sum(1 for i in picks(4, d, "t") if i == 0) for d in range(1, 201)]
    good = [(d, p / 40) for d, p in enumerate(plain, 1) if p > 0]
    assert len(good) < 200
    share = {"s": F.col("pos") / F.col("n")}
    got = bootstrap(draws, F.col("pos") > 0, share, wanted=100, most=200, low=0.1, high=0.9).first()
    first = [v for _, v in good[:100]]
    assert (got["n_boot"], got["n_attempts"]) == (100, good[99][0]) and got["n_attempts"] > 100
    assert got["s_lo"] == pytest.approx(np.quantile(first, 0.1)) and got["s_hi"] == pytest.approx(np.quantile(first, 0.9))
    short = bootstrap(draws, F.col("pos") > 0, share, wanted=190, most=200, low=0.1, high=0.9).first()
    assert (short["n_boot"], short["n_attempts"], short["s_lo"]) == (len(good), 200, None)


def test_boxes_of_several_pools_in_one_plan(spark):
    aux = spark.createDataFrame([(s, 1000, 100, 60, 45) for s in range(60)], RATES)
    pools = [("alike", s, 1600, 300) for s in range(12)] + [("few", s, 100, 20) for s in range(5)] + [("one", 0, 1000, 188)] + [("far", s, 1000, 900) for s in range(12)] + [("empty", 0, 0, 0)]
    got = {r["pool"]: r for r in shift.fit_shifts(aux, spark.createDataFrame(pools, "pool string, site_id int, n long, k long"), pool=["pool"]).collect()}
    assert {p: r["reason"] for p, r in got.items()} == {"alike": None, "few": "bbse-target-clustering", "one": None, "far": "bbse-misspecified", "empty": "bbse-empty-target"}
    alike, one = got["alike"], got["one"]
    assert (alike["q_target"], alike["rho_lo"], alike["rho_hi"], alike["rho_point"]) == (pytest.approx(0.1875), *[pytest.approx(3.0)] * 3)
    level = C.BBSE_DELTA_CONF / C.BBSE_BONFERRONI
    assert (one["q_lo"], one["q_hi"]) == pytest.approx(intervals.clopper_pearson(188, 1000, level)) and one["rho_lo"] < one["rho_point"] < one["rho_hi"]
    worse = spark.createDataFrame([(s, 1000, 100, 6, 45) for s in range(60)], RATES)
    assert shift.fit_shifts(worse, spark.createDataFrame(pools[:12], "pool string, site_id int, n long, k long"), pool=["pool"]).first()["reason"] == "bbse-ill-conditioned"
    lone = spark.createDataFrame([(s, 10, 0, 0, 1) for s in range(60)], RATES)
    assert shift.fit_shifts(lone, spark.createDataFrame(pools[:12], "pool string, site_id int, n long, k long"), pool=["pool"]).first()["reason"] == "bbse-degenerate-bootstrap"


def test_estimates_by_group(spark):
    rows = [(g, s, 10 * s, 20, s, 5) for g in (1, 2) for s in range(1, 30)] + [(3, s, 0, 0, 0, 0) for s in range(5)]
    df = spark.createDataFrame(rows, "g int, site_id int, ans_pos long, ans_neg long, err_pos long, err_neg long")
    got = {r["g"]: r for r in shift.estimates(df, by=["g"], rho=2.0).collect()}
    wrong, answered = sum(2 * s + 5 for s in range(1, 30)), sum(20 * s + 20 for s in range(1, 30))
    assert got[1]["risk"] == got[2]["risk"] == pytest.approx(wrong / answered) and got[1]["ci_lo"] < got[1]["risk"] < got[1]["ci_hi"] and got[1]["ci_lo"] != got[2]["ci_lo"]
    assert (got[3]["risk"], got[3]["ci_lo"]) == (None, None) and got[1]["n_boot"] == C.ESTIMATE_BOOT


def wealth_of(z, alpha, delta):
    goal, top, log, mu, s2, count = math.log(1 / delta), 0.0, 0.0, C.WSR_MU0, C.WSR_S2_0, 1.0
    for v in z:
        stake = min(math.sqrt(2 * goal / (max(s2, C.WSR_VAR_FLOOR) * len(z))), C.WSR_LAMBDA_CAP / (1 - alpha))
        log += math.log(max(1 + stake * (alpha - v), 1e-300))
        count += 1
        mu += (v - mu) / count
        s2 += ((v - mu) ** 2 - s2) / count
        top = max(top, log)
    return top


def test_each_tested_step_has_a_permutation_of_its_own(spark):
    r = random.Random(7)
    n, taus = 60, C.TAU_GRID
    z = {(s, t): min(1.0, max(0.0, r.gauss(0.03 + 0.002 * t, 0.02))) for s in range(n) for t in range(23)}
    atoms = spark.createDataFrame([(s, t, taus[t], v) for (s, t), v in z.items()], "site_id int, tau_idx int, tau double, z double")
    labels = spark.createDataFrame([(s,) for s in range(n)], "site_id int")
    order = sites.walk_order(atoms)
    ranks = step_ranks(labels, [(0.05, C.MODE_BASELINE, "")], label="site_id")
    got = {x["tau_idx"]: x["top_log_wealth"] for x in betting.bets(atoms, ranks.select("step", "site_id", "rank"), 0.05, C.DELTA, order=order).collect()}
    rng = stream_of(0, C.MODE_BASELINE, "")
    for x in order.orderBy("step").collect():
        shuffled = rng.permutation([z[s, x["tau_idx"]] for s in range(n)])
        assert got[x["tau_idx"]] == pytest.approx(wealth_of(shuffled, 0.05, C.DELTA), abs=1e-9)


@pytest.fixture(scope="module")
def population(spark):
    """160 sites whose first feature tells much of the label."""
    rng, rows = np.random.default_rng(5), []
    for s in range(160):
        shift_ = rng.normal(0, 0.3)
        for _ in range(int(rng.integers(100, 130))):
            y = bool(rng.random() < 0.3)
            rows.append((s, f"s{s:03d}", y, [float(rng.normal(2.4 if y else -2.4, 1.0) + shift_), float(rng.normal()), 7.0]))
    return spark.createDataFrame(rows, "site_id int, site_label string, y boolean, x array<double>").repartition(3).persist()


def test_heads_of_many_groups_are_those_of_each(spark, population):
    splits = replicate_splits(population.select("site_id"), 4, least=140)
    train = splits.where("split = 'train'")
    fitted = heads.fit_heads(population, train)
    for g in (0, 3):
        one = heads.fit_head(population.join(train.where(F.col("replicate") == g), "site_id"))
        assert fitted[g].coef == pytest.approx(one.coef, abs=2e-5) and fitted[g].intercept == pytest.approx(one.intercept, abs=2e-5)
        assert fitted[g].mu == pytest.approx(one.mu) and fitted[g].sd == pytest.approx(one.sd)
    with pytest.raises(ValueError, match="single-class"):
        heads.fit_heads(population.withColumn("y", F.lit(True)), train)


def test_the_number_of_jobs_does_not_grow_with_the_replicates(spark, population):
    counts = []
    for n in (2, 5):
        group = f"replicates-{n}"
        splits = replicate_splits(population.select("site_id"), n, least=140).persist()
        splits.count()
        spark.sparkContext.setJobGroup(group, group)
        heads.fit_heads(population, splits.where("split = 'train'"), tolerance=1e-6)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    assert counts[0] > 5 and counts[1] <= counts[0] + 6  # a round more at most


def test_a_replicate_is_a_certified_split(spark, population):
    splits = replicate_splits(population.select("site_id"), 2, least=140).persist()
    got = replicated.run(population, splits)
    outcomes = got.outcomes.collect()
    assert len(outcomes) == 2 * 25 * 2
    for g in range(2):
        own = population.join(splits.where(F.col("replicate") == g), "site_id")
        one = certify(own.where("split <> 'target'").select("site_label", "split", "y", "x"), own.where("split = 'target'").select("site_label", "x"))
        modes = {(r["alpha"], r["mode"]): r for r in got.results.where((F.col("replicate") == g) & (F.col("pool") == replicated.POOLED)).collect()}
        for alpha in C.ALPHA_LADDER:
            plain = one.modes[alpha, "baseline"]
            assert modes[alpha, "baseline"]["tau_idx"] == plain["tau_idx"]
            assert (modes[alpha, "bbse"]["tau"] is None) == (one.modes[alpha, "bbse"]["tau"] is None)
        fit = got.fits.where((F.col("replicate") == g) & (F.col("pool") == replicated.POOLED)).first()
        assert fit["q_target"] == pytest.approx(one.report["shift"]["q_target"]) and fit["c1"] == pytest.approx(one.report["shift"]["c1"])
        if not one.report["shift_reason"]:
            assert fit["rho_point"] == pytest.approx(one.report["shift"]["rho_point"]) and fit["rho_hi"] == pytest.approx(one.report["shift"]["rho_hi"], rel=0.1)
        pooled = next(r for r in outcomes if r["replicate"] == g and r["pool"] == replicated.POOLED and r["alpha"] == 0.1)
        assert pooled["certified"] == (0.1 in one.report["certified"])
        if pooled["certified"] and pooled["mode"] == "baseline" == one.report["certified"][0.1]["mode"]:
            assert pooled["n_answered"] == one.answered.where(F.col("score") >= F.lit(pooled["tau"])).count()
    assert any(r["certified"] for r in outcomes)
    single = [r for r in outcomes if r["pool"] != replicated.POOLED]
    assert all(r["n_target"] >= 100 for r in single) and {r["exceed_share"] for r in single} <= {None, 0.0, 1.0}
    top = replicated.summary(got.outcomes).collect()
    assert {r["replicates"] for r in top} == {2}


def test_too_few_calibration_sites_decline_every_pool(spark, population):
    some = population.where("site_id < 60")
    splits = spark.createDataFrame([(0, s, ("train", "aux", "cal", "target")[s % 4]) for s in range(60)], "replicate int, site_id int, split string")
    got = replicated.run(some, splits, modes=("baseline",))
    assert {(r["reason"], r["tau"]) for r in got.results.collect()} == {("insufficient-clusters", None)}
    assert {(r["certified"], r["declined"], r["risk"]) for r in got.outcomes.collect()} == {(False, "baseline:insufficient-clusters", None)}


def test_leaks_are_probed_in_every_replicate(spark, population):
    splits = replicate_splits(population.select("site_id"), 2, least=140)
    rows = replicated.leak_probe(population, splits, [0]).collect()
    assert len(rows) == 2 and all(r["auc"] > 0.9 and r["auc_alarm"] and r["ablation_alarm"] and abs(r["auc_ablated"] - 0.5) < 0.1 for r in rows)
    calm = replicated.leak_probe(population, splits, [1]).collect()
    assert all(not r["ablation_alarm"] and abs(r["ablation_drop"]) < 0.02 for r in calm)


def test_criteria_fire_and_hold(spark):
    declared = criteria.declared(spark)
    good = [("run", "run", "n_certified", 3.0), ("run", "run", "exceed_rate", 0.0), ("run", "run", "mean_coverage", 0.5), ("run", "run", "n_sites", 208.0)]
    good += [("replicate", g, m, v) for g in ("0", "1") for m, v in (("auc", 0.8), ("ablation_drop", 0.01), ("strict_coverage", 0.95), ("strict_risk", 0.03))]
    form = "scope string, witness string, measure string, value double"
    calm = criteria.verdicts(declared, spark.createDataFrame(good, form)).collect()
    assert len(calm) == 7 and not any(r["fired"] or r["leg_fired"] or r["witnesses"] for r in calm)
    bad = {"validity": [("run", "run", "exceed_rate", 0.2)], "feasibility": [("run", "run", "n_certified", 0.0)], "scope": [("run", "run", "n_sites", 150.0)], "too-good": [("replicate", "1", "strict_risk", 0.001)]}
    for name, rows in bad.items():
        keys = {r[:3] for r in rows}
        seen = [r for r in good if r[:3] not in keys] + rows
        got = criteria.verdicts(declared, spark.createDataFrame(seen, form)).collect()
        assert {r["name"] for r in got if r["fired"]} == {name}
        assert [r["witnesses"] for r in got if r["leg_fired"]] == [rows[0][1]]
    none = criteria.verdicts(declared, spark.createDataFrame([], form)).collect()
    assert len(none) == 7 and not any(r["fired"] for r in none) and {r["n_seen"] for r in none} == {0}


def test_tails_over_columns(spark):
    rows = [(n, k, a) for n in (1, 7, 100, 5000) for k in (0, 1, n // 2, n) for a in (0.05, 0.1)]
    df = spark.createDataFrame([*rows, (None, 1, 0.1)], "n long, k long, a double")
    for r in df.select("n", "k", "a", intervals.clopper_pearson_ends(F.col("k"), F.col("n"), 0.05).alias("ci"), intervals.binomial_exceedances(F.col("n"), F.col("a")).alias("over")).collect():
        if r["n"] is None:
            assert r["ci"]["lo"] is None and r["over"] is None
            continue
        assert (r["ci"]["lo"], r["ci"]["hi"]) == pytest.approx(intervals.clopper_pearson(r["k"], r["n"], 0.05), abs=1e-9)
        assert r["over"] == pytest.approx(intervals.binomial_exceedance(r["n"], r["a"]), abs=1e-9)
        if r["n"] <= 100:
            least = math.floor(r["a"] * r["n"] + 1e-9) + 1
            assert r["over"] == pytest.approx(sum(math.comb(r["n"], j) * r["a"] ** j * (1 - r["a"]) ** (r["n"] - j) for j in range(least, r["n"] + 1)), abs=1e-12)


def test_exceedance_beside_its_reference(spark):
    df = spark.createDataFrame([(10, True), (10, False), (40, True), (0, False)], "n int, over boolean")
    got = explain.exceedance_bins(df, "n", "over", 0.1, [1.0, 30.0, 100.0, 300.0]).orderBy("bin").collect()
    assert [r["n"] for r in got] == [2, 1, 0] and got[0]["observed"] == 0.5 and got[2]["reference"] is None
    assert got[0]["reference"] == pytest.approx(intervals.binomial_exceedance(10, 0.1))


def test_long_sequences_are_bet_on_by_running_sums(spark):
    r = random.Random(9)
    z = {t: [0.1 if r.random() < 0.3 else float(r.random() < 0.02 * (t + 1)) for _ in range(700)] for t in range(4)}
    rows = [(t, 0.6 + t / 100, i * 7 - 900, v) for t, own in z.items() for i, v in enumerate(own)]
    df = spark.createDataFrame(rows, "tau_idx int, tau double, rank long, z double").repartition(5)
    got = {x["tau_idx"]: x for x in betting.long_bets(df, 0.1, C.DELTA).collect()}
    assert {x["n_sites"] for x in got.values()} == {700}
    for t, own in z.items():
        top = wealth_of(own, 0.1, C.DELTA)
        assert got[t]["top_log_wealth"] == pytest.approx(top, abs=1e-8) and got[t]["rejected"] == (top >= math.log(1 / C.DELTA))
    short = betting.bets(df.withColumn("site_id", F.col("rank")).drop("rank"), df.select(F.col("rank").alias("site_id"), "rank").distinct(), 0.1, C.DELTA)
    assert {x["tau_idx"]: x["top_log_wealth"] for x in short.collect()} == pytest.approx({t: x["top_log_wealth"] for t, x in got.items()}, abs=1e-8)


def test_unit_bets_are_long_bets_without_a_row_for_each_threshold(spark):
    r = random.Random(8)
    rows = [(i, r.choice([0.5, 0.55, 0.7, 0.8, 0.9, 0.99]), r.random() < 0.04) for i in range(700)]
    rows += [(700, None, True), (701, float("nan"), True)]
    df = spark.createDataFrame(rows, "rank long, score double, err boolean")
    want = {x["tau_idx"]: x for x in betting.long_bets(sites.unit_atoms(df, 0.1, keep=["rank"]), 0.1, C.DELTA).collect()}
    got = betting.unit_bets(df, 0.1, C.DELTA).collect()
    assert len(got) == len(want) == len(C.TAU_GRID) and any(x["rejected"] for x in got) and betting.unit_bets(df.limit(0), 0.1, C.DELTA).count() == 0
    for x in got:
        w = want[x["tau_idx"]]
        assert x["n_sites"] == w["n_sites"] == 702 and x["tau"] == w["tau"] and x["rejected"] == w["rejected"] and abs(x["top_log_wealth"] - w["top_log_wealth"]) < 1e-9


def test_heads_are_fitted_on_blocks_of_records(spark):
    rows = [([float(i), i / 7], i % 3 == 0, [0, 1] if i % 2 else [1]) for i in range(50)]
    got = heads.packed(spark.createDataFrame(rows, "x array<double>, y boolean, groups array<int>").coalesce(1)).collect()
    assert len(got) == 1
    x, y, sizes, groups = (np.frombuffer(v, k) for v, k in zip(got[0], ("f8", "f8", "i4", "i4"), strict=True))
    assert x.reshape(50, 2).tolist() == [r[0] for r in rows] and y.tolist() == [float(r[1]) for r in rows]
    assert sizes.tolist() == [len(r[2]) for r in rows] and groups.tolist() == [g for r in rows for g in r[2]]


def test_rivals_are_sent_their_rungs(spark):
    head = heads.Head((1.0,), 0.0, (0.0,), (1.0,))
    records = spark.createDataFrame([(s, s % 2 == 0, [float(s - 2)], 0.5) for s in range(5)], "site_id int, y boolean, x array<double>, comparator double")
    splits = spark.createDataFrame([(0, s, "target") for s in range(5)], "replicate int, site_id int, split string")
    outcomes = spark.createDataFrame([(0, 0.1, "pooled", True, 0.6)], "replicate int, alpha double, pool string, certified boolean, tau double")
    got = replicated.comparators(records.checkpoint(), splits.checkpoint(), replicated.Replicated({0: head}, None, None, None, outcomes.checkpoint(), None))
    assert got.first()["n"] == 4
    # no records meet by replicate: the joins with rungs and splits are broadcasts
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
