"""Registered queries of ranked counterfactuals, their evaluation, response tables and samples over lineitem, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake import constants as C
from quorumlake.functions import heads
from quorumlake.operators import explain
from quorumlake.operators.resampling import exact_sample

from .queries import _HEADED, HEAD, _explained, query, rounded, table

_TAU = 0.8
_BAR = "ln(0.8::DOUBLE / (1 - 0.8::DOUBLE))"
_SIGN = "CASE WHEN logit >= 0 THEN 1 ELSE -1 END"
_GAPS = f"{_HEADED}, c AS (SELECT *, {_BAR} - abs(logit) AS margin, ({_BAR} - abs(logit) + 1e-9) * {_SIGN} AS gap FROM h)"


@query(f"""{_GAPS}, m AS (SELECT record_id, margin > 0 AS cf_declined, greatest(margin, 0) / sqrt(0.98::DOUBLE) AS d, ({_BAR} + abs(logit)) / sqrt(0.98::DOUBLE) AS o, gap,
  unnest(CASE WHEN margin > 0 THEN [1, 2, 3] ELSE [0] END) AS place FROM c)
SELECT record_id, cf_declined, round(d, 6) AS distance, round(o, 6) AS opposite, place::INT AS place, CASE place WHEN 1 THEN 0 WHEN 2 THEN 3 WHEN 3 THEN 1 END AS feature,
  round(CASE place WHEN 1 THEN gap / 0.8 WHEN 2 THEN gap / 0.5 WHEN 3 THEN gap / -0.3 END, 6) AS dz, round(CASE place WHEN 1 THEN gap / 0.8 * 14 WHEN 2 THEN gap / 0.5 * 2 WHEN 3 THEN gap / -0.3 * 0.03 END, 6) AS dx FROM m""")
def counterfactual_ranking(spark: SparkSession, d: str) -> DataFrame:
    rows = _explained(spark, d).withColumns(heads.ranked_moves(HEAD, F.col("x"), F.col("logit"), _TAU))
    long = rows.select("record_id", "cf_declined", F.round("cf_distance", 6).alias("distance"), F.round("cf_opposite", 6).alias("opposite"), F.posexplode_outer("cf_moves").alias("p", "m"))
    return long.select("record_id", "cf_declined", "distance", "opposite", F.coalesce(F.col("p") + 1, F.lit(0)).alias("place"), "m.feature", F.round("m.dz", 6).alias("dz"), F.round("m.dx", 6).alias("dx"))


_DRAWN = f"(('0x' || substr(md5(concat_ws(':', '{C.SEED}', 'counterfactual', record_id)), 1, 12))::BIGINT % 4)"


@query(f"""{_GAPS}, r AS (SELECT *, {_DRAWN} AS j FROM c WHERE margin > 0), w AS (SELECT *, [0.8, -0.3, 0.0, 0.5][j + 1]::DOUBLE AS weight FROM r),
n AS (SELECT *, logit + weight * abs(gap / 0.8) * CASE WHEN {_SIGN} * weight >= 0 THEN 1 ELSE -1 END AS moved FROM w),
q AS (SELECT greatest(1 / (1 + exp(-moved)), 1 / (1 + exp(moved))) >= 0.8 AS hit FROM n)
SELECT count(*) AS n_declined, count(*) AS n_evaluated, 0::BIGINT AS n_unflippable, count(*) AS top_flips, count(*) FILTER (hit) AS random_flips, 1.0::DOUBLE AS top_flip_rate, round(avg(hit::INT::DOUBLE), 9) AS random_flip_rate FROM q""")
def counterfactual_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(explain.evaluated_moves(_explained(spark, d), HEAD, "record_id", _TAU), 9, "random_flip_rate")


_PROFILES = f"""{_HEADED}, l AS (SELECT record_id // 10 % 9 AS replicate, score >= 0.65 AS a, unnest([0, 1, 2, 3]) AS feature, unnest([abs(f0), abs(f1), abs(f2), abs(f3)]) AS v FROM h),
m AS (SELECT replicate, feature, avg(v) FILTER (a) - avg(v) FILTER (NOT a) AS gap FROM l GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY replicate ORDER BY abs(gap) DESC, feature) AS place FROM m)"""


@query(f"""{_PROFILES}, s AS (SELECT feature, count(*) AS replicates, avg(gap) AS mean_gap, 1.96 * stddev_samp(gap) / sqrt(count(*)) AS ci95, count(*) FILTER (place = 1) AS n_top FROM p GROUP BY 1),
t AS (SELECT *, n_top / sum(n_top) OVER ()::DOUBLE AS top_share, row_number() OVER (ORDER BY n_top DESC, feature) = 1 AS is_mode FROM s)
SELECT feature, replicates, round(mean_gap, 9) AS mean_gap, round(ci95, 9) AS ci95, n_top, round(top_share, 9) AS top_share, is_mode, is_mode AND top_share >= 0.5 AS stable FROM t""")
def stable_drivers(spark: SparkSession, d: str) -> DataFrame:
    rows = _explained(spark, d).withColumn("replicate", F.floor(F.col("record_id") / 10) % 9)
    profiles = explain.abstention_profile(rows, "phi", heads.answered(heads.scored(F.col("logit"))["score"], 0.65), by=["replicate"])
    return rounded(explain.stable_drivers(profiles), 9, "mean_gap", "ci95", "top_share")


@query(f"""{_HEADED}, z AS (SELECT record_id, logit, unnest([0, 1, 2, 3]) AS feature, unnest([f0, f1, f2, f3]) AS phi, unnest([0.8, -0.3, NULL, 0.5]::DOUBLE[]) AS w, unnest([25, 0.05, 0.04, 4]::DOUBLE[]) AS mu, unnest([14, 0.03, 0.02, 2]::DOUBLE[]) AS sd FROM h),
e AS (SELECT *, (-{_BAR} - (logit - phi)) / w AS no, ({_BAR} - (logit - phi)) / w AS yes FROM z)
SELECT record_id, feature::INT AS feature, round(no, 6) AS z_no, round(yes, 6) AS z_yes, round(no * sd + mu, 5) AS x_no, round(yes * sd + mu, 5) AS x_yes FROM e""")
def threshold_crossings(spark: SparkSession, d: str) -> DataFrame:
    rows = _explained(spark, d)
    long = rows.select("record_id", F.explode(heads.crossings(HEAD, F.col("x"), F.col("logit"), _TAU)).alias("c"))
    return rounded(rounded(long.select("record_id", "c.feature", "c.z_no", "c.z_yes", "c.x_no", "c.x_yes"), 6, "z_no", "z_yes"), 5, "x_no", "x_yes")


_FLAGS = ("A", "N", "R")
#: Quantity, the three members of the return flag, and whether the line is open.
_HOT = heads.Head((0.6, -0.4, 0.9, 0.2, -0.7), 0.3, (25.0, 0.25, 0.5, 0.25, 0.5), (14.0, 0.45, 0.5, 0.45, 0.5))
_HOT_SQL = """WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS record_id, l_returnflag AS flag, (l_linestatus = 'O')::INT AS open, 0.6::DOUBLE * ((l_quantity - 25) / 14.0::DOUBLE) AS q FROM lineitem),
g(level, name, w, mu, sd) AS (VALUES (1, 'A', -0.4::DOUBLE, 0.25::DOUBLE, 0.45::DOUBLE), (2, 'N', 0.9, 0.5, 0.5), (3, 'R', 0.2, 0.25, 0.45)),
o AS (SELECT a.level, a.name, sum(b.w * ((a.name = b.name)::INT - b.mu) / b.sd) AS part FROM g a, g b GROUP BY 1, 2),
s(state, part) AS (VALUES (0, -0.7::DOUBLE * (0 - 0.5::DOUBLE) / 0.5), (1, -0.7::DOUBLE * (1 - 0.5::DOUBLE) / 0.5))"""


def _hot(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    x = F.array(F.col("l_quantity"), *[(F.col("l_returnflag") == v).cast("double") for v in _FLAGS], (F.col("l_linestatus") == "O").cast("double"))
    rows = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_id"), x.alias("x"))
    return rows.withColumn("logit", _HOT.logit(F.col("x")))


@query(f"""{_HOT_SQL}, r AS (SELECT record_id, o.level, flag = o.name AS now, 0.3::DOUBLE + q + o.part + s.part AS logit FROM x JOIN s ON s.state = x.open CROSS JOIN o)
SELECT record_id, level::INT AS level, now, round(1 / (1 + exp(-logit)), 7) AS p, greatest(1 / (1 + exp(-logit)), 1 / (1 + exp(logit))) >= 0.7 AS answered FROM r""")
def level_tables(spark: SparkSession, d: str) -> DataFrame:
    rows = _hot(spark, d)
    long = rows.select("record_id", F.explode(heads.level_table(_HOT, F.col("x"), F.col("logit"), 0.7, [1, 2, 3])).alias("l"))
    return rounded(long.select("record_id", "l.*"), 7, "p")


@query(f"""{_HOT_SQL}, r AS (SELECT record_id, s.state, open = s.state AS now, 0.3::DOUBLE + q + o.part + s.part AS logit FROM x JOIN o ON o.name = x.flag CROSS JOIN s)
SELECT record_id, 4 AS feature, state::INT AS state, now, round(1 / (1 + exp(-logit)), 7) AS p, greatest(1 / (1 + exp(-logit)), 1 / (1 + exp(logit))) >= 0.7 AS answered FROM r""")
def state_tables(spark: SparkSession, d: str) -> DataFrame:
    rows = _hot(spark, d)
    long = rows.select("record_id", F.explode(heads.state_table(_HOT, F.col("x"), F.col("logit"), 0.7, [4])).alias("s"))
    return rounded(long.select("record_id", "s.*"), 7, "p")


@query(f"""SELECT l_orderkey * 10 + l_linenumber AS record_id, l_extendedprice FROM lineitem
ORDER BY substr(md5(concat_ws(':', '{C.SEED}', 'sample', l_orderkey * 10 + l_linenumber)), 1, 12), l_orderkey * 10 + l_linenumber LIMIT 2000""")
def record_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_id"), "l_extendedprice")
    return exact_sample(rows, 2000, seed=C.SEED, key="record_id")
