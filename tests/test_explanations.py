"""Ranked moves, crossings, level and state tables, their evaluation, stable drivers and exact samples against plain loops."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlake import constants as C
from quorumlake.functions import heads
from quorumlake.operators import explain
from quorumlake.operators.resampling import exact_sample

HEAD = heads.Head((0.8, -0.3, 0.0, -0.8, 1.5), -0.2, (1.0, 0.0, 2.0, 0.5, -1.0), (2.0, 0.5, 1.0, 1.0, 0.25))
TAU = 0.8


def logit_of(head, x):
    return sum(c * (v - m) / s for c, v, m, s in zip(head.coef, x, head.mu, head.sd, strict=True)) + head.intercept


def score_of(head, x):
    p = 1 / (1 + math.exp(-logit_of(head, x)))
    return max(p, 1 - p)


def number(stream, key):
    return int(hashlib.md5(f"{C.SEED}:{stream}:{key}".encode()).hexdigest()[:12], 16)


@pytest.fixture(scope="module")
def cases(spark):
    r = random.Random(6)
    rows = [(i, [r.gauss(m, s) for m, s in zip(HEAD.mu, HEAD.sd, strict=True)]) for i in range(300)]
    rows.append((300, [1.0 + 0.2 * 2.0 / 0.8, 0.0, 2.0, 0.5, -1.0]))  # a logit of about nothing
    df = spark.createDataFrame(rows, "record_id int, x array<double>")
    return rows, df.withColumn("logit", HEAD.logit(F.col("x"))).persist()


def test_moves_are_ranked_and_do_what_they_say(spark, cases):
    rows, df = cases
    got = {r["record_id"]: r for r in df.withColumns(heads.ranked_moves(HEAD, F.col("x"), F.col("logit"), TAU)).collect()}
    bar, norm = math.log(TAU / (1 - TAU)), math.sqrt(sum(c * c for c in HEAD.coef))
    for i, x in rows:
        z, r = logit_of(HEAD, x), got[i]
        margin = bar - abs(z)
        assert r["cf_declined"] == (margin > 0) and r["cf_opposite"] == pytest.approx((bar + abs(z)) / norm)
        assert r["cf_distance"] == pytest.approx(max(margin, 0.0) / norm, abs=1e-12)
        if margin <= 0:
            assert r["cf_moves"] == [] and r["cf_confidence"] is None
            continue
        assert [m["feature"] for m in r["cf_moves"]] == [4, 0, 3, 1]  # no move of the third; equal ones by place
        assert r["cf_flips"] and r["cf_class"] == (r["logit"] >= 0) and TAU <= r["cf_confidence"] < TAU + 1e-8
        for m in r["cf_moves"]:
            assert m["dx"] == pytest.approx(m["dz"] * HEAD.sd[m["feature"]])
            moved = [v + m["dx"] * (j == m["feature"]) for j, v in enumerate(x)]
            assert score_of(HEAD, moved) == pytest.approx(TAU, abs=1e-8) and (logit_of(HEAD, moved) >= 0) == (r["logit"] >= 0)


def test_a_head_without_weights_cannot_move(spark):
    blank = heads.Head((0.0, 0.0), 0.1, (0.0, 0.0), (1.0, 1.0))
    df = spark.createDataFrame([(1, [1.0, 2.0])], "record_id int, x array<double>").withColumn("logit", blank.logit(F.col("x")))
    r = df.withColumns(heads.ranked_moves(blank, F.col("x"), F.col("logit"), TAU)).first()
    assert r["cf_declined"] and r["cf_distance"] == r["cf_opposite"] == float("inf") and r["cf_moves"] == [] and not r["cf_flips"] and r["cf_class"] is None
    told = explain.evaluated_moves(df, blank, "record_id", TAU).first()
    assert (told["n_declined"], told["n_evaluated"], told["n_unflippable"], told["top_flip_rate"]) == (1, 0, 1, None)
    sure = heads.Head((0.0, 0.0), 5.0, (0.0, 0.0), (1.0, 1.0))
    r = df.withColumn("logit", sure.logit(F.col("x"))).withColumns(heads.ranked_moves(sure, F.col("x"), F.col("logit"), TAU)).first()
    assert not r["cf_declined"] and r["cf_distance"] == 0.0


def test_the_first_move_beside_a_random_one(spark, cases):
    rows, df = cases
    bar, declined, top, drawn = math.log(TAU / (1 - TAU)), 0, 0, 0
    for i, x in rows:
        z = logit_of(HEAD, x)
        if bar - abs(z) <= 0:
            continue
        declined += 1
        sign = 1.0 if z >= 0 else -1.0
        dz = (bar - abs(z) + C.LOGIT_HEADROOM) * sign / HEAD.coef[4]
        top += score_of(HEAD, [v + dz * HEAD.sd[4] * (j == 4) for j, v in enumerate(x)]) >= TAU
        j = number("counterfactual", i) % 5
        way = abs(dz) if sign * HEAD.coef[j] >= 0 else -abs(dz)
        drawn += score_of(HEAD, [v + way * HEAD.sd[j] * (k == j) for k, v in enumerate(x)]) >= TAU
    r = explain.evaluated_moves(df, HEAD, "record_id", TAU).first()
    assert (r["n_declined"], r["n_evaluated"], r["top_flips"], r["random_flips"]) == (declined, declined, top, drawn) and top == declined and 0 < drawn < declined


def test_crossings_hold_when_substituted(spark, cases):
    rows, df = cases
    for r in df.withColumn("c", heads.crossings(HEAD, F.col("x"), F.col("logit"), TAU)).collect():
        assert [c["feature"] for c in r["c"]] == list(range(5)) and r["c"][2]["z_no"] is None and r["c"][2]["x_yes"] is None
        for c in r["c"]:
            j = c["feature"]
            assert c["z_now"] == pytest.approx((r["x"][j] - HEAD.mu[j]) / HEAD.sd[j])
            for end, sign in (("no", -1), ("yes", 1)):
                if c[f"x_{end}"] is not None:
                    z = logit_of(HEAD, [c[f"x_{end}"] if k == j else v for k, v in enumerate(r["x"])])
                    assert z == pytest.approx(sign * math.log(TAU / (1 - TAU)), abs=1e-9)


def test_levels_move_all_members_and_states_one(spark):
    head = heads.Head((0.5, -0.9, 0.4, 0.7, -0.6), 0.1, (0.0, 0.2, 0.5, 0.3, 0.5), (1.0, 0.4, 0.5, 0.45, 0.5))
    rows = [(i, [i / 10, *[float(k == i % 3) for k in range(3)], float(i % 2)]) for i in range(12)]
    df = spark.createDataFrame(rows, "record_id int, x array<double>").withColumn("logit", head.logit(F.col("x")))
    got = df.select("x", heads.level_table(head, F.col("x"), F.col("logit"), 0.6, [1, 2, 3]).alias("l"), heads.state_table(head, F.col("x"), F.col("logit"), 0.6, [4]).alias("s"), heads.response(head, F.col("x"), F.col("logit"), 0, points=9).alias("r")).collect()
    for r in got:
        for t in r["l"]:
            moved = [r["x"][0], *[float(k == t["level"]) for k in (1, 2, 3)], r["x"][4]]
            p = 1 / (1 + math.exp(-logit_of(head, moved)))
            assert t["p"] == pytest.approx(p) and t["answered"] == (max(p, 1 - p) >= 0.6) and t["now"] == (moved == r["x"])
        for t in r["s"]:
            moved = [*r["x"][:4], float(t["state"])]
            assert t["p"] == pytest.approx(1 / (1 + math.exp(-logit_of(head, moved)))) and t["now"] == (moved == r["x"])
        assert [t["z"] for t in r["r"]] == pytest.approx(np.linspace(-4, 4, 9).tolist())
        for t in r["r"]:
            assert t["p"] == pytest.approx(1 / (1 + math.exp(-logit_of(head, [t["z"], *r["x"][1:]]))))


def test_stable_drivers(spark):
    r = random.Random(1)
    rows = [(g, f, r.gauss(f, 1.0), 0) for g in range(7) for f in range(3)]
    first = {g: max((x for x in rows if x[0] == g), key=lambda x: (abs(x[2]), -x[1]))[1] for g in range(7)}
    df = spark.createDataFrame([(g, f, v, 1 if first[g] == f else 2) for g, f, v, _ in rows], "replicate int, feature int, gap double, place int")
    got = {x["feature"]: x for x in explain.stable_drivers(df).collect()}
    for f in range(3):
        own = [v for _, g, v, _ in rows if g == f]
        assert got[f]["mean_gap"] == pytest.approx(np.mean(own)) and got[f]["ci95"] == pytest.approx(1.96 * np.std(own, ddof=1) / math.sqrt(7))
        n = sum(v == f for v in first.values())
        assert got[f]["n_top"] == n and got[f]["top_share"] == pytest.approx(n / 7) and got[f]["stable"] == (got[f]["is_mode"] and n >= 4)
    assert sum(x["is_mode"] for x in got.values()) == 1
    alone = explain.stable_drivers(df.where("replicate = 0")).collect()
    assert all(x["ci95"] is None for x in alone)


def test_samples_have_exactly_k_rows_and_do_not_hang_on_partitions(spark):
    keys = [i % 900 for i in range(1000)]
    df = spark.createDataFrame([(k, f"v{k}") for k in keys], "key int, v string")
    for k in (1, 40, 555, 999):
        want = sorted(sorted(keys, key=lambda i: (number("sample", i), i))[:k])
        for parts in (1, 7):
            got = exact_sample(df.repartition(parts), k, seed=C.SEED, key="key")
            assert got.columns == ["key", "v"] and sorted(r["key"] for r in got.collect()) == want
    assert exact_sample(df, 5000, seed=C.SEED, key="key").count() == 1000 and exact_sample(df, 0, seed=C.SEED, key="key").count() == 0
    hot = spark.createDataFrame([(7,)] * 500 + [(i,) for i in range(20)], "key int")
    assert exact_sample(hot, 300, seed=C.SEED, key="key").count() == 300


def test_leading_features_are_searched_and_keep_the_modified(spark):
    df = spark.createDataFrame([(1, [0.1, -5.0, 3.0, 0.2, 0.0])], "id int, phi array<double>")
    names = ["age", "heart rate", "Heart index", "weight", "heart"]
    shown = lambda **how: [(r["feature"], r["n_shown"], r["n_total"]) for r in explain.leading_features(df, "id", "phi", 2, **how).collect()]
    assert shown() == [(1, 2, 5), (2, 2, 5)]
    assert shown(modified=(0, 1)) == [(1, 3, 5), (2, 3, 5), (0, 3, 5)]
    assert shown(names=names, search="HEART") == [(1, 2, 3), (2, 2, 3)]
    assert shown(names=names, search="heart", modified=(4, 0)) == [(1, 3, 3), (2, 3, 3), (4, 3, 3)] and shown(names=names, search="none") == []


def test_curves_follow_from_what_the_feature_leaves(spark):
    head = heads.Head((0.8, -0.3), -0.2, (1.0, 2.0), (2.0, 0.5))
    df = spark.createDataFrame([([0.5, 2.5],), ([3.0, 1.0],)], "x array<double>").withColumn("logit", head.logit(F.col("x")))
    base = F.col("logit") - F.get(head.attribution(F.col("x")), F.lit(0))
    for a, b in df.select(heads.response(head, F.col("x"), F.col("logit"), 0), heads.response_from(head, base, 0)).collect():
        assert a == b and len(a) == 161


def test_contrasts_bring_no_feature_to_one_task(spark):
    from quorumlake.operators import ranks

    df = spark.createDataFrame([(float(i % 97), float(i % 2), i % 3 == 0) for i in range(500)], "a double, b double, y boolean")
    plan = ranks.decile_contrast(df, ["a", "b"], "y")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
