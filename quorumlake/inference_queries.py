"""Registered queries of resampling, step-wise orders and replicated runs over lineitem, with DuckDB SQL for each."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake import constants as C
from quorumlake.functions import heads, intervals
from quorumlake.operators import betting, explain, shift, sites
from quorumlake.operators.resampling import bootstrap, resampled
from quorumlake.operators.splits import replicate_splits
from quorumlake.plans import criteria, replicated

from .queries import COHORT, SITES, TAUS, _atoms, _bins_sql, cohort, part_counts, query, rounded, table

LEVEL = C.BBSE_DELTA_CONF / C.BBSE_BONFERRONI
_RATES = "s AS (SELECT site_id, count(*) AS n, count(*) FILTER (y) AS pos, count(*) FILTER (y AND pred) AS pred_pos, count(*) FILTER (NOT y AND pred) AS pred_neg FROM cohort WHERE split = 'aux' GROUP BY 1)"


def _draws(source: str, name: str, sums: tuple[str, ...], draws: int, stream: str, by: tuple[str, ...] = ()) -> str:
    """SQL of resampled() as CTEs; its result is `name`."""
    keys = "".join(f"{b}, " for b in by)
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    on = " AND ".join(f"p.{b} IS NOT DISTINCT FROM k.{b}" for b in (*by, "place"))
    number = "concat_ws(':', " + ", ".join([f"'{C.SEED}'", f"'{stream}'", *[f"coalesce({b}::VARCHAR, '')" for b in by], "draw", "pick"]) + ")"
    return f"""{name}_p AS (SELECT {keys}row_number() OVER ({part} ORDER BY site_id NULLS FIRST) - 1 AS place, count(*) OVER ({part}) AS m, {', '.join(sums)} FROM {source}),
{name}_d AS (SELECT {keys}m, unnest(range(1, {draws + 1})) AS draw FROM {name}_p WHERE place = 0),
{name}_i AS (SELECT {keys}m, draw, unnest(range(1, m + 1)) AS pick FROM {name}_d),
{name}_k AS (SELECT {keys}draw, ('0x' || substr(md5({number}), 1, 12))::BIGINT % m AS place, count(*) AS times FROM {name}_i GROUP BY ALL),
{name} AS (SELECT {''.join(f'k.{b}, ' for b in by)}k.draw, {', '.join(f'sum(times * {c}) AS {c}' for c in sums)} FROM {name}_k k JOIN {name}_p p ON {on} GROUP BY ALL)"""


def _ends(measure: str, low: float, high: float, name: str) -> str:
    return f"quantile_cont({measure}, {low!r}) AS {name}_lo, quantile_cont({measure}, {high!r}) AS {name}_hi"


_BOOT = f"""{_draws('s', 'b', ('n', 'pos', 'pred_pos', 'pred_neg'), C.BBSE_BOOT_MAX_ATTEMPTS, 'aux')},
v AS (SELECT *, row_number() OVER (ORDER BY draw) AS place FROM b WHERE pos >= 1 AND n - pos >= 1),
box AS (SELECT count(*) AS n_boot, max(draw)::INT AS n_attempts, {_ends('pred_neg / (n - pos)::DOUBLE', LEVEL / 2, 1 - LEVEL / 2, 'c0')}, {_ends('pred_pos / pos::DOUBLE', LEVEL / 2, 1 - LEVEL / 2, 'c1')},
  {_ends('pos / n::DOUBLE', LEVEL / 2, 1 - LEVEL / 2, 'pi_s')} FROM v WHERE place <= {C.BBSE_BOOT})"""
_BOX = ("c0_lo", "c0_hi", "c1_lo", "c1_hi", "pi_s_lo", "pi_s_hi")


@query(f"{COHORT}, {_RATES}, {_BOOT} SELECT n_boot, n_attempts, {', '.join(f'round({c}, 9) AS {c}' for c in _BOX)} FROM box")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    rates = sites.class_rates(cohort(spark, d).where("split = 'aux'"))
    both = (F.col("pos") >= 1) & (F.col("n") - F.col("pos") >= 1)
    draws = resampled(rates, ["n", "pos", "pred_pos", "pred_neg"], draws=C.BBSE_BOOT_MAX_ATTEMPTS, seed=C.SEED, stream="aux")
    measures = {"c0": F.col("pred_neg") / (F.col("n") - F.col("pos")), "c1": F.col("pred_pos") / F.col("pos"), "pi_s": F.col("pos") / F.col("n")}
    got = bootstrap(draws, both, {k: F.when(both, m) for k, m in measures.items()}, wanted=C.BBSE_BOOT, most=C.BBSE_BOOT_MAX_ATTEMPTS, low=LEVEL / 2, high=1 - LEVEL / 2)
    return rounded(got, 9, *_BOX)


_CLIP = f"least(greatest({{}}, {C.PI_CLIP!r}), {1 - C.PI_CLIP!r})"


def _odds(q: str, c0: str, c1: str, pi_s: str) -> str:
    t, s = _CLIP.format(f"({q} - {c0}) / ({c1} - {c0})"), _CLIP.format(pi_s)
    return f"(({t}) / (1 - {t})) / (({s}) / (1 - {s}))"


_CORNERS = ", ".join(_odds(f"q_{a}", f"c0_{b}", f"c1_{c}", f"pi_s_{e}") for a in ("lo", "hi") for b in ("lo", "hi") for c in ("lo", "hi") for e in ("lo", "hi"))
_POOL_SITES = """t0 AS (SELECT CASE WHEN site_id % 40 = 0 THEN 'few' ELSE 'part ' || (site_id % 3) END AS pool, site_id, count(*) AS n, count(*) FILTER (pred) AS k FROM cohort WHERE split = 'cal' GROUP BY ALL)"""
_SHIFT_SQL = f"""{COHORT}, {_RATES}, {_BOOT}, {_POOL_SITES},
pt AS (SELECT sum(pred_neg) / sum(n - pos)::DOUBLE AS c0, sum(pred_pos) / sum(pos)::DOUBLE AS c1, sum(pos) / sum(n)::DOUBLE AS pi_s FROM s),
{_draws('t0', 'q', ('n', 'k'), C.BBSE_BOOT, 'target', ('pool',))},
qb AS (SELECT pool, {_ends('k / n::DOUBLE', LEVEL / 2, 1 - LEVEL / 2, 'q')} FROM q GROUP BY pool),
tp AS (SELECT pool, sum(n)::BIGINT AS n_target, count(*) AS n_target_sites, sum(k) / sum(n)::DOUBLE AS q_target FROM t0 GROUP BY pool),
a0 AS (SELECT *, c1_lo - c0_hi AS gap_lo FROM tp JOIN qb USING (pool), box, pt),
a1 AS (SELECT *, CASE WHEN n_target_sites BETWEEN 2 AND {C.BBSE_MIN_TARGET_SITES - 1} THEN 'bbse-target-clustering' WHEN n_boot < {C.BBSE_BOOT} THEN 'bbse-degenerate-bootstrap'
  WHEN gap_lo < {C.BBSE_GAP_FLOOR} THEN 'bbse-ill-conditioned' WHEN NOT (c0_lo <= q_lo AND q_hi <= c1_hi) THEN 'bbse-misspecified' END AS reason FROM a0),
fits AS (SELECT *, CASE WHEN reason IS NULL THEN least({_CORNERS}) END AS rho_lo, CASE WHEN reason IS NULL THEN greatest({_CORNERS}) END AS rho_hi,
  CASE WHEN reason IS NULL THEN {_odds('q_target', 'c0', 'c1', 'pi_s')} END AS rho_point FROM a1)"""


def _pools(spark: SparkSession, d: str) -> DataFrame:
    cal = cohort(spark, d).where("split = 'cal'")
    pool = F.when(F.col("site_id") % 40 == 0, "few").otherwise(F.concat(F.lit("part "), (F.col("site_id") % 3).cast("string")))
    return cal.groupBy(pool.alias("pool"), "site_id").agg(F.count("*").alias("n"), F.count_if("pred").alias("k"))


def _fits(spark: SparkSession, d: str) -> DataFrame:
    return shift.fit_shifts(sites.class_rates(cohort(spark, d).where("split = 'aux'")), _pools(spark, d), pool=["pool"])


@query(f"""{_SHIFT_SQL} SELECT pool, reason, n_target, n_target_sites, round(q_target, 9) AS q_target, round(q_lo, 9) AS q_lo, round(q_hi, 9) AS q_hi, round(gap_lo, 9) AS gap_lo,
  round(rho_lo, 6) AS rho_lo, round(rho_hi, 6) AS rho_hi, round(rho_point, 6) AS rho_point FROM fits""")
def shift_boxes(spark: SparkSession, d: str) -> DataFrame:
    got = rounded(rounded(_fits(spark, d), 9, "q_target", "q_lo", "q_hi", "gap_lo"), 6, "rho_lo", "rho_hi", "rho_point")
    return got.select("pool", "reason", "n_target", "n_target_sites", "q_target", "q_lo", "q_hi", "gap_lo", "rho_lo", "rho_hi", "rho_point")


_TAIL = "list_sum(list_transform(range({low}, {high}), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p}))))"


@query(f"""WITH RECURSIVE c AS (SELECT (l_orderkey % {SITES})::INT AS site_id, ((l_extendedprice - 47500.0::DOUBLE) / 6000.0::DOUBLE >= 0) <> (l_extendedprice * (1 - l_discount) > 45000) AS err FROM lineitem),
s AS (SELECT site_id, count(*) AS n, count(*) FILTER (err) AS k FROM c GROUP BY 1), u AS (SELECT DISTINCT n, k FROM s),
i(step, n, k, a, b, e, f) AS (SELECT 0, n, k, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE FROM u
  UNION ALL SELECT step + 1, n, k, CASE WHEN up < 0.025 THEN (a + b) / 2 ELSE a END, CASE WHEN up < 0.025 THEN b ELSE (a + b) / 2 END,
    CASE WHEN down > 0.025 THEN (e + f) / 2 ELSE e END, CASE WHEN down > 0.025 THEN f ELSE (e + f) / 2 END
  FROM (SELECT *, {_TAIL.format(low='k', high='n + 1', p='((a + b) / 2)')} AS up, {_TAIL.format(low='0', high='k + 1', p='((e + f) / 2)')} AS down FROM i WHERE step < 45))
SELECT site_id, k, n, round(CASE WHEN k > 0 THEN (a + b) / 2 ELSE 0 END, 8) AS low, round(CASE WHEN k < n THEN (e + f) / 2 ELSE 1 END, 8) AS high FROM s JOIN i USING (n, k) WHERE step = 45""")
def clopper_pearson(spark: SparkSession, d: str) -> DataFrame:
    per = cohort(spark, d).groupBy("site_id").agg(F.count_if("err").alias("k"), F.count("*").alias("n"))
    distinct = per.select("k", "n").distinct().withColumn("e", intervals.clopper_pearson_ends(F.col("k"), F.col("n"), 0.05))
    return per.join(distinct, ["k", "n"]).select("site_id", "k", "n", F.round("e.lo", 8).alias("low"), F.round("e.hi", 8).alias("high"))


_ANSWERED_EDGES = [1.0, 30.0, 60.0, 100.0, 300.0, 1000.0, 1e18]


@query(f"""{COHORT}, per AS (SELECT site_id, count(*) AS n, avg(err::INT::DOUBLE) > 0.1 AS over FROM cohort WHERE score >= 0.75 GROUP BY 1),
u AS (SELECT n, coalesce(list_sum(list_transform(range(floor(0.1::DOUBLE * n + 1e-9)::BIGINT + 1, n + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.1::DOUBLE) + (n - j) * ln(0.9::DOUBLE)))), 0) AS ref FROM (SELECT DISTINCT n FROM per)),
v AS (SELECT n::DOUBLE AS size, over, ref FROM per JOIN u USING (n)), {_bins_sql(_ANSWERED_EDGES, 'size', 'round(avg(over::INT::DOUBLE), 9) AS observed, round(avg(ref), 9) AS reference', 'v')}""")
def exceedance_by_size(spark: SparkSession, d: str) -> DataFrame:
    per = cohort(spark, d).where(F.col("score") >= 0.75).groupBy("site_id").agg(F.count("*").alias("n"), (F.avg(F.col("err").cast("double")) > 0.1).alias("over"))
    return rounded(explain.exceedance_bins(per, "n", "over", 0.1, _ANSWERED_EDGES), 9, "observed", "reference")


def _bets_by_step(alpha: float, delta: float, name: str, atoms: str, order: str) -> str:
    """SQL of bets with an order of sites for each tested step, as CTEs; atoms: (grp, site_id, tau_idx, tau, z); order: (grp, tau_idx, step)."""
    goal = repr(math.log(1 / delta))
    return f"""{name}_q AS (SELECT a.grp, a.tau_idx, a.tau, a.z, row_number() OVER w AS i, count(*) OVER (PARTITION BY a.grp, a.tau_idx)::DOUBLE AS n
  FROM {atoms} a JOIN {order} o USING (grp, tau_idx) WINDOW w AS (PARTITION BY a.grp, a.tau_idx ORDER BY (a.site_id * 101 + 7 + 13 * o.step) % 208, a.site_id)),
{name}_b(grp, tau_idx, tau, i, logw, mu, s2, cnt, top, n) AS (
  SELECT grp, tau_idx, tau, 0::BIGINT, 0.0::DOUBLE, 0.5::DOUBLE, 0.25::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, n FROM {name}_q WHERE i = 1
  UNION ALL
  SELECT grp, tau_idx, tau, i, logw, mu, s2 + ((z - mu) * (z - mu) - s2) / cnt, cnt, greatest(top, logw), n FROM (
    SELECT b.grp, b.tau_idx, b.tau, s.i, s.z, b.top, b.s2, b.n, b.cnt + 1 AS cnt, b.mu + (s.z - b.mu) / (b.cnt + 1) AS mu,
      b.logw + ln(greatest(1 + least(sqrt(2 * {goal} / (greatest(b.s2, 1e-8) * b.n)), 0.9 / (1 - {alpha}::DOUBLE)) * ({alpha}::DOUBLE - s.z), 1e-300)) AS logw
    FROM {name}_b b JOIN {name}_q s ON s.grp IS NOT DISTINCT FROM b.grp AND s.tau_idx = b.tau_idx AND s.i = b.i + 1)),
{name} AS (SELECT grp, tau_idx, tau, n::INT AS n_sites, top AS top_log_wealth, top >= {goal} AS rejected FROM {name}_b WHERE i = n)"""


def _walk_of(name: str, order: str, tests: str) -> str:
    return f"""{name} AS (SELECT *, coalesce(in_prefix AND tau = min(CASE WHEN in_prefix THEN tau END) OVER (PARTITION BY grp), false) AS deployed FROM (
  SELECT o.grp, o.step, o.tau_idx, o.tau, top_log_wealth, rejected, min(rejected::INT) OVER (PARTITION BY o.grp ORDER BY o.step) = 1 AS in_prefix FROM {order} o JOIN {tests} USING (grp, tau_idx)))"""


def step_orders(spark: SparkSession) -> DataFrame:
    """(step, site_id, rank): a plain order of the sites for each step."""
    steps = spark.range(1, len(C.TAU_GRID) + 1).select(F.col("id").cast("int").alias("step"), F.explode(F.sequence(F.lit(0), F.lit(SITES - 1))).alias("site_id"))
    return steps.withColumn("rank", ((F.col("site_id") * 101 + 7 + 13 * F.col("step")) % SITES) * SITES + F.col("site_id"))


def _order_sql(name: str, atoms: str) -> str:
    return f"{name} AS (SELECT grp, tau_idx, tau, row_number() OVER (PARTITION BY grp ORDER BY round(avg(z), 12), tau_idx) AS step FROM {atoms} GROUP BY grp, tau_idx, tau)"


_STEPWISE = f"""{COHORT}, {_atoms('aux', 0.05, 'x0')}, {_atoms('cal', 0.05, 'c0z')}, x1 AS (SELECT 0 AS grp, * FROM x0), c1z AS (SELECT 0 AS grp, * FROM c0z),
{_order_sql('o', 'x1')}, {_bets_by_step(0.05, C.DELTA, 't', 'c1z', 'o')}, {_walk_of('w', 'o', 't')}"""


@query(f"{_STEPWISE} SELECT step::INT AS step, tau_idx, round(top_log_wealth, 6) AS top_log_wealth, rejected, in_prefix, deployed FROM w")
def stepwise_walk(spark: SparkSession, d: str) -> DataFrame:
    order = sites.walk_order(sites.atoms(part_counts(spark, d, "aux"), 0.05))
    tests = betting.bets(sites.atoms(part_counts(spark, d, "cal"), 0.05), step_orders(spark), 0.05, C.DELTA, order=order)
    got = betting.walk(order, tests).join(tests.select("tau_idx", "top_log_wealth"), "tau_idx")
    return got.select("step", "tau_idx", F.round("top_log_wealth", 6).alias("top_log_wealth"), "rejected", "in_prefix", "deployed")




_UNIT_GOAL = repr(math.log(1 / C.DELTA))
_UNIT_RANK = "(record_id * 7919 + 13) % 1000003 * 100000000 + record_id"


@query(f"""{COHORT}, u AS (SELECT split, tau_idx, tau, ({_UNIT_RANK}, logit, err) AS rank, CASE WHEN score >= tau THEN err::INT::DOUBLE ELSE 0.1::DOUBLE END AS z FROM cohort CROSS JOIN taus),
o AS (SELECT tau_idx, tau, row_number() OVER (ORDER BY round(avg(z), 12), tau_idx) AS step FROM u WHERE split = 'aux' GROUP BY tau_idx, tau),
a AS (SELECT *, row_number() OVER w AS t, sum(z) OVER w AS s, count(*) OVER (PARTITION BY tau_idx)::DOUBLE AS n FROM u WHERE split = 'cal' WINDOW w AS (PARTITION BY tau_idx ORDER BY rank)),
b AS (SELECT *, (z - (0.5 + s) / (t + 1)) * (z - (0.5 + s) / (t + 1)) AS q FROM a),
c AS (SELECT *, (0.25 + coalesce(sum(q) OVER (PARTITION BY tau_idx ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / t AS s2 FROM b),
e AS (SELECT tau_idx, sum(ln(greatest(1 + least(sqrt(2 * {_UNIT_GOAL} / (greatest(s2, 1e-8) * n)), 0.9 / 0.9::DOUBLE) * (0.1::DOUBLE - z), 1e-300))) OVER (PARTITION BY tau_idx ORDER BY rank) AS l, n FROM c),
t AS (SELECT tau_idx, any_value(n)::INT AS n_units, greatest(0, max(l)) AS top FROM e GROUP BY 1),
k AS (SELECT o.step, o.tau_idx, o.tau, n_units, top, top >= {_UNIT_GOAL} AS rejected, min((top >= {_UNIT_GOAL})::INT) OVER (ORDER BY o.step) = 1 AS in_prefix FROM o JOIN t USING (tau_idx))
SELECT step::INT AS step, tau_idx, n_units, round(top, 6) AS top_log_wealth, rejected, in_prefix, coalesce(in_prefix AND tau = min(CASE WHEN in_prefix THEN tau END) OVER (), false) AS deployed FROM k""")
def record_unit_walk(spark: SparkSession, d: str) -> DataFrame:
    # ids repeat in places: what still ties has the same atoms
    records = cohort(spark, d).withColumn("rank", F.struct(F.expr(_UNIT_RANK).alias("number"), "logit", "err"))
    order = sites.walk_order(sites.unit_atoms(records.where("split = 'aux'"), 0.1))
    tests = betting.unit_bets(records.where("split = 'cal'"), 0.1, C.DELTA)
    got = betting.walk(order, tests).join(tests.select("tau_idx", F.col("n_sites").alias("n_units"), "top_log_wealth"), "tau_idx")
    return got.select("step", "tau_idx", "n_units", F.round("top_log_wealth", 6).alias("top_log_wealth"), "rejected", "in_prefix", "deployed")


@query(f"{_SHIFT_SQL} SELECT pool, round(rho_lo, 6) AS rho_lo, round(rho_hi, 6) AS rho_hi FROM (SELECT pool, least({_CORNERS}) AS rho_lo, greatest({_CORNERS}) AS rho_hi FROM a1)")
def rho_corners(spark: SparkSession, d: str) -> DataFrame:
    ends = intervals.odds_ratio_ends(*[(F.col(f"{k}_lo"), F.col(f"{k}_hi")) for k in ("q", "c0", "c1", "pi_s")])
    return _fits(spark, d).select("pool", F.round(ends[0], 6).alias("rho_lo"), F.round(ends[1], 6).alias("rho_hi"))


def _weighted(part: str, alpha: float, rho: str, grp: int) -> str:
    """SQL of atoms whose positive records weigh `rho`, a column of fits at the pool 'part 0'."""
    r = f"(SELECT {rho} FROM fits WHERE pool = 'part 0')" if rho != "1" else "1.0::DOUBLE"
    return f"""SELECT {grp} AS grp, site_id, tau_idx, tau, {alpha}::DOUBLE + CASE WHEN n > 0 THEN least(n, 100.0) / n ELSE 0 END / 100.0 * ((ep * r + en) / greatest(1.0, r) - {alpha}::DOUBLE * (ap * r + an) / greatest(1.0, r)) AS z
  FROM cc, (SELECT {r} AS r) WHERE split = '{part}'"""


def _both_modes(alpha: float, k: int) -> str:
    return f"""xa{k} AS MATERIALIZED ({_weighted('aux', alpha, '1', 0)}), xc{k} AS MATERIALIZED ({_weighted('cal', alpha, '1', 0)}), {_order_sql(f'xo{k}', f'xa{k}')}, {_bets_by_step(alpha, C.DELTA, f'xt{k}', f'xc{k}', f'xo{k}')}, {_walk_of(f'xw{k}', f'xo{k}', f'xt{k}')},
ya{k} AS MATERIALIZED ({_weighted('aux', alpha, 'rho_point', 0)}), yp{k} AS MATERIALIZED ({_order_sql(f'yp{k}', f'ya{k}')[len(f'yp{k} AS ('):-1]}), yo{k} AS MATERIALIZED (SELECT * FROM yp{k} UNION ALL SELECT 1, tau_idx, tau, step FROM yp{k}),
yc{k} AS MATERIALIZED ({_weighted('cal', alpha, 'rho_lo', 0)} UNION ALL {_weighted('cal', alpha, 'rho_hi', 1)}), {_bets_by_step(alpha, C.BBSE_DELTA_BET, f'ys{k}', f'yc{k}', f'yo{k}')},
yt{k} AS (SELECT 0 AS grp, tau_idx, min(top_log_wealth) AS top_log_wealth, bool_and(rejected) AS rejected FROM ys{k} GROUP BY tau_idx), {_walk_of(f'yw{k}', f'yp{k}', f'yt{k}')}"""


_MODES_SQL = f"""{_SHIFT_SQL}, cc AS MATERIALIZED (SELECT s.site_id, s.split, s.n, t.tau_idx, t.tau, count(c.site_id) FILTER (c.score >= t.tau AND y) AS ap, count(c.site_id) FILTER (c.score >= t.tau AND NOT y) AS an,
  count(c.site_id) FILTER (c.score >= t.tau AND y AND err) AS ep, count(c.site_id) FILTER (c.score >= t.tau AND NOT y AND err) AS en FROM sizes s CROSS JOIN taus t LEFT JOIN cohort c ON c.site_id = s.site_id GROUP BY ALL),
{', '.join(_both_modes(a, k) for k, a in enumerate(C.ALPHA_LADDER))},
m(alpha, mode_idx, mode, tau) AS ({' UNION ALL '.join(f"SELECT {a}::DOUBLE, {i}, '{mode}', max(tau) FILTER (deployed) FROM {w}{k}" for k, a in enumerate(C.ALPHA_LADDER) for i, mode, w in ((0, 'baseline', 'xw'), (1, 'bbse', 'yw')))})"""


def _two_modes(spark: SparkSession, d: str) -> DataFrame:
    """(alpha, mode_idx, mode, tau, reason): the walks of both modes for the pool 'part 0', on step-wise orders."""
    row = _fits(spark, d).where("pool = 'part 0'").first()
    fit = shift.ShiftFit(row["reason"] or "", row["rho_lo"], row["rho_hi"], row["rho_point"])
    aux, cal, orders = part_counts(spark, d, "aux"), part_counts(spark, d, "cal"), step_orders(spark)
    out = None
    for alpha in C.ALPHA_LADDER:
        order = sites.walk_order(sites.atoms(aux, alpha))
        plain = betting.walk(order, betting.bets(sites.atoms(cal, alpha), orders, alpha, C.DELTA, order=order))
        shifted = shift.certify_shifted(aux, cal, fit, alpha, {"lo": orders, "hi": orders})
        for i, mode, walk in ((0, "baseline", plain), (1, "bbse", shifted)):
            one = walk.agg(F.max(F.when(F.col("deployed"), F.col("tau"))).alias("tau")).select(F.lit(alpha).alias("alpha"), F.lit(i).alias("mode_idx"), F.lit(mode).alias("mode"), "tau", F.when(F.col("tau").isNull(), "failsafe").alias("reason"))
            out = one if out is None else out.unionByName(one)
    return out


@query(f"""{_MODES_SQL} SELECT alpha, round(max(tau), 9) AS tau, arg_max(mode, (tau, -mode_idx)) FILTER (tau IS NOT NULL) AS mode,
  coalesce(string_agg(mode, '|' ORDER BY mode) FILTER (tau IS NOT NULL), '') AS covering, coalesce(string_agg(mode || ':failsafe', '|' ORDER BY mode) FILTER (tau IS NULL), '') AS declined FROM m GROUP BY alpha""")
def combine_modes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(betting.combine_modes(_two_modes(spark, d)), 9, "tau")


@query(f"{_MODES_SQL} SELECT min(alpha) FILTER (tau IS NOT NULL) AS alpha, round((SELECT max(tau) FROM m b WHERE b.alpha = (SELECT min(alpha) FROM m WHERE tau IS NOT NULL)), 9) AS tau FROM m")
def operative_rung(spark: SparkSession, d: str) -> DataFrame:
    return rounded(betting.operative_rung(betting.combine_modes(_two_modes(spark, d))), 9, "tau")


# ---- replicated runs --------------------------------------------------------

REPLICATES = 3
_ROUNDS = 16


def _minor(rows: list[list[str]]) -> str:
    """The determinant of a small matrix of SQL expressions."""
    if len(rows) == 1:
        return rows[0][0]
    terms = [f"{'-' if j % 2 else '+'} ({rows[0][j]}) * ({_minor([r[:j] + r[j + 1 :] for r in rows[1:]])})" for j in range(len(rows))]
    return " ".join(terms)


def _newton(source: str, name: str, features: int) -> str:
    """SQL of heads fitted by Newton's steps from zero, as CTEs; source: (replicate, y, x1...); name: (replicate, w0..., mu1..., sd1...), w0 being the intercept."""
    f = range(1, features + 1)
    moments = f"{name}_m AS MATERIALIZED (SELECT replicate, {', '.join(f'avg(x{j}) AS mu{j}, stddev_pop(x{j}) AS sd{j}' for j in f)} FROM {source} GROUP BY 1)"
    z = f"{name}_z AS MATERIALIZED (SELECT replicate, y, 1.0::DOUBLE AS z0, {', '.join(f'(x{j} - mu{j}) / sd{j} AS z{j}' for j in f)} FROM {source} JOIN {name}_m USING (replicate))"
    parts = [moments, z, f"{name}_0 AS MATERIALIZED (SELECT replicate, {', '.join(f'0.0::DOUBLE AS w{j}' for j in range(features + 1))} FROM {name}_m)"]
    every = range(features + 1)
    for i in range(_ROUNDS):
        p = f"1 / (1 + exp(-({' + '.join(f'w{j} * z{j}' for j in every)})))"
        sums = [f"sum(z{j} * (p - y::INT)) {'+ any_value(w%d)' % j if j else ''} AS g{j}" for j in every] + [f"sum(p * (1 - p) * z{a} * z{b}) {'+ 1' if a == b and a else ''} AS h{a}{b}" for a in every for b in every if a <= b]
        parts.append(f"{name}_s{i} AS MATERIALIZED (SELECT replicate, {', '.join(f'any_value(w{j}) AS w{j}' for j in every)}, {', '.join(sums)} FROM (SELECT *, {p} AS p FROM {name}_z JOIN {name}_{i} USING (replicate)) GROUP BY 1)")
        gram = [[f"h{min(a, b)}{max(a, b)}" for b in every] for a in every]
        solved = [f"w{j} - ({_minor([[f'g{a}' if b == j else gram[a][b] for b in every] for a in every])}) / ({_minor(gram)}) AS w{j}" for j in every]
        parts.append(f"{name}_{i + 1} AS MATERIALIZED (SELECT replicate, {', '.join(solved)} FROM {name}_s{i})")
    parts.append(f"{name} AS MATERIALIZED (SELECT * FROM {name}_{_ROUNDS} JOIN {name}_m USING (replicate))")
    return ", ".join(parts)


_NUMBER_SQL = f"('0x' || substr(md5(concat_ws(':', '{C.SEED}', 'split', replicate, site_id)), 1, 12))::BIGINT"
_TRAIN, _AUX = int(0.4 * (SITES - C.N_TARGET_SITES)), int(0.2 * (SITES - C.N_TARGET_SITES))
_T = C.N_TARGET_SITES
_REPLICATED = f"""WITH RECURSIVE rec AS (SELECT (l_orderkey % {SITES})::INT AS site_id, l_extendedprice AS x1, l_quantity AS x2, l_extendedprice * (1 - l_discount) > 45000 AS y FROM lineitem),
sp AS MATERIALIZED (SELECT replicate, site_id, CASE WHEN r < {_T} THEN 'target' WHEN r < {_T + _TRAIN} THEN 'train' WHEN r < {_T + _TRAIN + _AUX} THEN 'aux' ELSE 'cal' END AS split
  FROM (SELECT replicate::INT AS replicate, site_id, row_number() OVER (PARTITION BY replicate ORDER BY {_NUMBER_SQL}, site_id) - 1 AS r FROM (SELECT DISTINCT site_id FROM rec), range({REPLICATES}) t(replicate))),
tr AS MATERIALIZED (SELECT replicate, y, x1, x2 FROM rec JOIN sp USING (site_id) WHERE split = 'train'), {_newton('tr', 'hd', 2)}"""
_SCORED = f"""{_REPLICATED}, taus(tau_idx, tau) AS (VALUES {TAUS}),
sc0 AS (SELECT replicate, site_id, split, y, w0 + w1 * (x1 - mu1) / sd1 + w2 * (x2 - mu2) / sd2 AS logit FROM rec JOIN sp USING (site_id) JOIN hd USING (replicate) WHERE split <> 'train'),
sc AS MATERIALIZED (SELECT replicate, site_id, split, y, 1 / (1 + exp(-logit)) >= 0.5 AS pred, greatest(1 / (1 + exp(-logit)), 1 / (1 + exp(logit))) AS score FROM sc0),
ct AS MATERIALIZED (SELECT replicate, site_id, split, tau_idx, tau, count(*) AS n, count(*) FILTER (score >= tau) AS ans, count(*) FILTER (score >= tau AND pred <> y) AS bad FROM sc CROSS JOIN taus GROUP BY ALL)"""


def _replicated_walks(alpha: float, k: int) -> str:
    z = f"SELECT replicate AS grp, site_id, tau_idx, tau, least(n, 100.0) / n / 100.0 * (bad - {alpha}::DOUBLE * ans) + {alpha}::DOUBLE AS z FROM ct WHERE split"
    return f"za{k} AS MATERIALIZED ({z} = 'aux'), zc{k} AS MATERIALIZED ({z} = 'cal'), {_order_sql(f'o{k}', f'za{k}')}, {_bets_by_step(alpha, C.DELTA, f't{k}', f'zc{k}', f'o{k}')}, {_walk_of(f'wk{k}', f'o{k}', f't{k}')}"


_WALKS = f"""{_SCORED}, {', '.join(_replicated_walks(a, k) for k, a in enumerate(C.ALPHA_LADDER))},
wk AS MATERIALIZED ({' UNION ALL '.join(f"SELECT {a}::DOUBLE AS alpha, * FROM wk{k}" for k, a in enumerate(C.ALPHA_LADDER))}),
rg AS MATERIALIZED (SELECT grp AS replicate, alpha, max(tau) FILTER (deployed) AS tau FROM wk GROUP BY ALL),
mem AS (SELECT replicate, site_id, unnest(['pooled', site_id::VARCHAR]) AS pool FROM sp WHERE split = 'target'),
nt AS (SELECT replicate, pool, sum(n)::BIGINT AS n_target FROM mem JOIN (SELECT DISTINCT replicate, site_id, n FROM ct) USING (replicate, site_id) GROUP BY ALL),
ev AS (SELECT replicate, pool, alpha, sum(ans)::BIGINT AS n_answered, sum(bad)::BIGINT AS n_wrong, sum(least(n, 100.0) / n * bad) / nullif(sum(least(n, 100.0) / n * ans), 0) AS risk,
  avg((bad / ans::DOUBLE > alpha)::INT::DOUBLE) FILTER (ans > 0) AS exceed_share FROM rg JOIN mem USING (replicate) JOIN ct USING (replicate, site_id, tau) GROUP BY ALL),
oc AS MATERIALIZED (SELECT replicate, pool, alpha, tau IS NOT NULL AS certified, tau, n_target, n_answered, n_answered / n_target::DOUBLE AS coverage, n_wrong / nullif(n_answered, 0)::DOUBLE AS error_rate, risk, risk > alpha AS risk_exceeds,
  exceed_share, n_wrong FROM rg JOIN nt USING (replicate) LEFT JOIN ev USING (replicate, pool, alpha))"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") % SITES).cast("int").alias("site_id"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) > 45000).alias("y"), F.array("l_extendedprice", "l_quantity").alias("x"))


def _replicated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, replicated.Replicated]:
    records = _records(spark, d)
    splits = replicate_splits(records.select("site_id"), REPLICATES)
    groups = F.explode(F.array(*[F.struct(F.lit(r).alias("replicate"), F.lit(a).alias("alpha")) for r in range(REPLICATES) for a in C.ALPHA_LADDER]))
    orders = step_orders(spark).withColumn("g", groups).select("g.*", F.lit(C.MODE_BASELINE).alias("mode_idx"), F.lit("").alias("stream"), "step", F.col("site_id").cast("int").alias("site_id"), "rank")
    return records, splits, replicated.run(records, splits, modes=("baseline",), orders=orders)


@query(f"{_REPLICATED} SELECT replicate, round(w0, 7) AS intercept, round(w1, 7) AS w1, round(w2, 7) AS w2, round(mu1, 6) AS mu1, round(sd2, 9) AS sd2 FROM hd")
def logistic_heads(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d)
    fitted = heads.fit_heads(records, replicate_splits(records.select("site_id"), REPLICATES).where("split = 'train'"))
    rows = [(g, h.intercept, h.coef[0], h.coef[1], h.mu[0], h.sd[1]) for g, h in fitted.items()]
    return rounded(rounded(rounded(spark.createDataFrame(rows, "replicate int, intercept double, w1 double, w2 double, mu1 double, sd2 double"), 7, "intercept", "w1", "w2"), 6, "mu1"), 9, "sd2")


@query(f"WITH c AS (SELECT DISTINCT (l_orderkey % {SITES})::INT AS site_id FROM lineitem), sp AS (SELECT replicate::INT AS replicate, site_id, row_number() OVER (PARTITION BY replicate ORDER BY {_NUMBER_SQL}, site_id) - 1 AS r FROM c, range(20) t(replicate)) SELECT replicate, site_id, CASE WHEN r < {_T} THEN 'target' WHEN r < {_T + _TRAIN} THEN 'train' WHEN r < {_T + _TRAIN + _AUX} THEN 'aux' ELSE 'cal' END AS split FROM sp")
def split_sites(spark: SparkSession, d: str) -> DataFrame:
    return replicate_splits(_records(spark, d).select("site_id"), 20)


@query(f"{_WALKS} SELECT grp AS replicate, alpha, step::INT AS step, tau_idx, rejected, in_prefix, deployed FROM wk")
def replicated_walks(spark: SparkSession, d: str) -> DataFrame:
    return _replicated(spark, d)[2].walks.select("replicate", "alpha", "step", "tau_idx", "rejected", "in_prefix", "deployed")


@query(f"""{_WALKS} SELECT replicate, pool, alpha, certified, round(tau, 9) AS tau, n_target, n_answered, round(coverage, 9) AS coverage, round(error_rate, 9) AS error_rate, round(risk, 9) AS risk, risk_exceeds,
  round(exceed_share, 9) AS exceed_share FROM oc""")
def replicated_outcomes(spark: SparkSession, d: str) -> DataFrame:
    got = _replicated(spark, d)[2].outcomes
    return rounded(got.select("replicate", "pool", "alpha", "certified", "tau", "n_target", "n_answered", "coverage", "error_rate", "risk", "risk_exceeds", "exceed_share"), 9, "tau", "coverage", "error_rate", "risk", "exceed_share")


@query(f"""{_WALKS} SELECT CASE WHEN pool = 'pooled' THEN 'pooled' ELSE 'single' END AS kind, alpha, count(*) AS rows, count(DISTINCT replicate) AS replicates, round(avg(certified::INT::DOUBLE), 9) AS certify_rate,
  round(avg(tau), 9) AS mean_tau, round(avg(coverage) FILTER (certified), 9) AS mean_coverage, round(avg(risk) FILTER (certified), 9) AS mean_risk, round(avg(risk_exceeds::INT::DOUBLE) FILTER (certified), 9) AS exceed_rate FROM oc GROUP BY ALL""")
def replicated_summary(spark: SparkSession, d: str) -> DataFrame:
    got = _replicated(spark, d)[2].outcomes
    both = replicated.summary(got).withColumn("kind", F.lit("pooled")).unionByName(replicated.summary(got, pooled=False).withColumn("kind", F.lit("single")))
    return rounded(both.drop("hard_rate"), 9, "certify_rate", "mean_tau", "mean_coverage", "mean_risk", "exceed_rate")


def _auc_sql(name: str, value: str) -> str:
    return f"""{name} AS (SELECT replicate, (sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y)::DOUBLE * count(*) FILTER (NOT y)) AS auc FROM (
  SELECT replicate, y, rank() OVER (PARTITION BY replicate ORDER BY {value}) + (count(*) OVER (PARTITION BY replicate, {value}) - 1) / 2.0 AS r FROM lk) GROUP BY 1)"""


_LEAKS = f"""tq AS MATERIALIZED (SELECT replicate, y, x2 AS x1 FROM tr), {_newton('tq', 'ha', 1)},
lk AS MATERIALIZED (SELECT replicate, y, hd.w1 / hd.sd1 * x1 + hd.w2 / hd.sd2 * rec.x2 AS full_logit, ha.w1 * rec.x2 AS without FROM rec JOIN sp USING (site_id) JOIN hd USING (replicate) JOIN ha USING (replicate) WHERE split = 'cal'),
{_auc_sql('ua', 'round(full_logit, 11)')}, {_auc_sql('ub', 'without')},
leaks AS (SELECT replicate, ua.auc, ub.auc AS auc_ablated, ua.auc - ub.auc AS ablation_drop FROM ua JOIN ub USING (replicate))"""


@query(f"{_REPLICATED}, {_LEAKS} SELECT replicate, round(auc, 7) AS auc, round(auc_ablated, 7) AS auc_ablated, round(ablation_drop, 7) AS ablation_drop, auc > 0.9 AS auc_alarm, ablation_drop > 0.05 AS ablation_alarm FROM leaks")
def replicated_leaks(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d)
    got = replicated.leak_probe(records, replicate_splits(records.select("site_id"), REPLICATES), [0])
    return rounded(got, 7, "auc", "auc_ablated", "ablation_drop")


@query(f"""{_WALKS}, rv AS (SELECT rg.replicate, rg.alpha, y, CASE WHEN l_linenumber <> 3 THEN 1 / (1 + exp(-(l_extendedprice - 46000.0::DOUBLE) / 9000.0::DOUBLE)) END AS rival, w0 + w1 * (l_extendedprice - mu1) / sd1 + w2 * (l_quantity - mu2) / sd2 AS logit, rg.tau
  FROM (SELECT *, (l_orderkey % {SITES})::INT AS site_id, l_extendedprice * (1 - l_discount) > 45000 AS y FROM lineitem) JOIN sp USING (site_id) JOIN hd USING (replicate) JOIN rg USING (replicate) WHERE split = 'target' AND rg.tau IS NOT NULL),
an AS MATERIALIZED (SELECT *, (logit >= 0) <> y AS err FROM rv WHERE greatest(1 / (1 + exp(-logit)), 1 / (1 + exp(logit))) >= tau),
rk AS (SELECT replicate, alpha, y, rank() OVER (PARTITION BY replicate, alpha ORDER BY rival) + (count(*) OVER (PARTITION BY replicate, alpha, rival) - 1) / 2.0 AS r FROM an WHERE rival IS NOT NULL),
au AS (SELECT replicate, alpha, (sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / nullif(count(*) FILTER (y)::DOUBLE * count(*) FILTER (NOT y), 0) AS auc FROM rk GROUP BY ALL)
SELECT replicate, alpha, count(*) AS n, count(rival) AS n_available, round(count(rival) / count(*)::DOUBLE, 9) AS available_share, round(avg((rival - y::INT) * (rival - y::INT)), 9) AS brier,
  round(avg(err::INT::DOUBLE) FILTER (rival IS NOT NULL), 9) AS subset_error, round(any_value(auc), 9) AS auc FROM an JOIN au USING (replicate, alpha) GROUP BY ALL""")
def replicated_comparators(spark: SparkSession, d: str) -> DataFrame:
    _, splits, got = _replicated(spark, d)
    rival = F.when(F.col("l_linenumber") != 3, 1 / (1 + F.exp(-(F.col("l_extendedprice") - 46000.0) / 9000.0)))
    li = table(spark, d, "lineitem")
    records = li.select((F.col("l_orderkey") % SITES).cast("int").alias("site_id"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) > 45000).alias("y"), F.array("l_extendedprice", "l_quantity").alias("x"), rival.alias("comparator"))
    return rounded(replicated.comparators(records, splits, got), 9, "available_share", "brier", "subset_error", "auc")


_CRITERIA_SQL = f"""{_WALKS}, {_LEAKS}, po AS (SELECT * FROM oc WHERE pool = 'pooled'),
op AS (SELECT replicate, arg_min(coverage, alpha) AS coverage, arg_min(risk_exceeds, alpha) AS over FROM po WHERE certified GROUP BY 1),
st AS (SELECT replicate, coverage, risk FROM po WHERE certified AND alpha = 0.05),
one AS (SELECT count(*) AS n, avg(over::INT::DOUBLE) AS rate, avg(coverage) AS cov FROM op),
legs(name, leg, n_hits, n_seen, lowest, highest, witnesses) AS (
  SELECT 'validity', 'exceedance', coalesce((rate > 0.05)::INT, 0), (rate IS NOT NULL)::INT, rate, rate, CASE WHEN rate > 0.05 THEN 'run' ELSE '' END FROM one
  UNION ALL SELECT 'feasibility', 'none-certifies', (n < 1)::INT, 1, n, n, CASE WHEN n < 1 THEN 'run' ELSE '' END FROM one
  UNION ALL SELECT 'feasibility', 'low-coverage', coalesce((cov < 0.2)::INT, 0), (cov IS NOT NULL)::INT, cov, cov, CASE WHEN cov < 0.2 THEN 'run' ELSE '' END FROM one
  UNION ALL SELECT 'too-good', 'discrimination', count(*) FILTER (auc > 0.9), count(*), min(auc), max(auc), coalesce(string_agg(replicate::VARCHAR, '|' ORDER BY replicate::VARCHAR) FILTER (auc > 0.9), '') FROM leaks
  UNION ALL SELECT 'too-good', 'missingness-ablation', count(*) FILTER (ablation_drop > 0.05), count(*), min(ablation_drop), max(ablation_drop), coalesce(string_agg(replicate::VARCHAR, '|' ORDER BY replicate::VARCHAR) FILTER (ablation_drop > 0.05), '') FROM leaks
  UNION ALL SELECT 'too-good', 'unfalsifiable-success', count(*) FILTER (coverage > 0.9 AND risk < 0.01), count(*), min(coverage), max(coverage), coalesce(string_agg(replicate::VARCHAR, '|' ORDER BY replicate::VARCHAR) FILTER (coverage > 0.9 AND risk < 0.01), '') FROM st
  UNION ALL SELECT 'scope', 'few-sites', (count(*) < 200)::INT, 1, count(*), count(*), CASE WHEN count(*) < 200 THEN 'run' ELSE '' END FROM (SELECT DISTINCT site_id FROM rec))
SELECT name, leg, sum(n_hits) OVER (PARTITION BY name) > 0 AS fired, n_hits > 0 AS leg_fired, n_hits::BIGINT AS n_hits, n_seen::BIGINT AS n_seen, round(lowest, 7) AS lowest, round(highest, 7) AS highest, witnesses FROM legs"""


@query(_CRITERIA_SQL)
def failure_criteria(spark: SparkSession, d: str) -> DataFrame:
    records, splits, got = _replicated(spark, d)
    leaks = replicated.leak_probe(records, splits, [0], fitted=got.heads)
    n_sites = records.agg(F.count_distinct("site_id").alias("n_sites"))
    return rounded(criteria.verdicts(criteria.declared(spark), criteria.observations(got.outcomes, leaks, n_sites)), 7, "lowest", "highest")
