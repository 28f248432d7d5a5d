"""Per-site statistics of scored records: one scan gives what every rung, cap, weight and endpoint needs.

Scored records have: site_id, y, err (boolean: the answer is wrong), score. A site's counts of answered and wrong
records at each threshold, by class, are the only thing that leaves the records; atoms at any alpha, cap M and class
weight rho follow from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quorumlake import constants as C


def site_sizes(records: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """(site_id, n): records of each site; with a table of sites, also those that have none."""
    sizes = records.groupBy("site_id").agg(F.count("*").alias("n"))
    if sites is None:
        return sizes
    return sites.select("site_id").distinct().join(sizes, "site_id", "left").select("site_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def check_scores(records: DataFrame) -> None:
    """Raises ValueError where a score is null, NaN or infinite."""
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    if not records.where(bad).isEmpty():
        raise ValueError("a score is not finite (reason=nonfinite-score)")


def score_bins(records: DataFrame, taus: list[float] = C.TAU_GRID, by: list[str] = ()) -> DataFrame:
    """(by..., site_id, k, n, pos, bad_pos, bad): records of a site by how many thresholds their score reaches; ties do."""
    reached = sum((F.col("score") >= F.lit(t)).cast("int") for t in taus)
    wrong, pos = F.col("err").cast("long"), F.col("y")
    return records.groupBy(*by, "site_id", reached.alias("k")).agg(
        F.count("*").alias("n"), F.count_if(pos).alias("pos"), F.sum(F.when(pos, wrong).otherwise(0)).alias("bad_pos"), F.sum(wrong).alias("bad"),
    )


def counts_of_bins(binned: DataFrame, taus: list[float] = C.TAU_GRID, sites: DataFrame | None = None, by: list[str] = ()) -> DataFrame:
    """What threshold_counts gives, from score_bins; sites: (by..., site_id) of those that count without records as well."""
    keys = [*by, "site_id"]
    entry = F.struct("k", "n", "pos", "bad_pos", "bad")
    per_site = binned.groupBy(*keys).agg(F.sum("n").alias("n"), F.collect_list(entry).alias("bins"))  # one entry for each threshold at most
    if sites is not None:
        per_site = sites.select(*keys).distinct().join(per_site, keys, "left")
    grid = F.array(*[F.struct(F.lit(i).alias("tau_idx"), F.lit(t).alias("tau")) for i, t in enumerate(taus)])
    total = lambda part: F.aggregate(F.coalesce(F.filter("bins", lambda b: b["k"] > F.col("g.tau_idx")), F.array()), F.lit(0).cast("long"), lambda s, b: s + part(b))
    return per_site.withColumn("g", F.explode(grid)).select(
        *keys, F.coalesce("n", F.lit(0).cast("long")).alias("n"), "g.tau_idx", "g.tau",
        total(lambda b: b["pos"]).alias("ans_pos"), total(lambda b: b["n"] - b["pos"]).alias("ans_neg"),
        total(lambda b: b["bad_pos"]).alias("err_pos"), total(lambda b: b["bad"] - b["bad_pos"]).alias("err_neg"),
    )


def threshold_counts(records: DataFrame, taus: list[float] = C.TAU_GRID, sites: DataFrame | None = None) -> DataFrame:
    """(site_id, n, tau_idx, tau, ans_pos, ans_neg, err_pos, err_neg): counts at every threshold, empty sites included.

    Records are counted by how many thresholds their score reaches, with partial sums where they lie, instead of being
    multiplied by the thresholds; a running sum over the few counts of a site gives each threshold's answered set.
    Ties are answered.
    """
    return counts_of_bins(score_bins(records, taus), taus, sites)


def influence(cap: Column | int = C.M_INFLUENCE) -> Column:
    """min(n, M) / n, a record's weight within its site; 0 for empty sites."""
    n = F.col("n").cast("double")
    return F.when(n > 0, F.least(n, F.lit(cap).cast("double") if isinstance(cap, int) else cap.cast("double")) / n).otherwise(0.0)


def number(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def atoms(counts: DataFrame, alpha: float | Column, *, cap: int = C.M_INFLUENCE, rho: float | Column = 1.0, by: list[str] = ()) -> DataFrame:
    """(by..., site_id, tau_idx, tau, z): influence atoms in [0, 1]; a site that answers nothing has exactly alpha.

    Positive records weigh rho, negative ones 1, both over max(1, rho). alpha and rho may be columns of counts. A rho that
    is NULL, negative or not finite raises: at once where it is a number, in the job where it is a column.
    """
    if not isinstance(rho, Column) and not 0.0 <= rho < float("inf"):
        raise ValueError(f"a weight of {rho} (reason=bad-weight)")
    a, r = number(alpha), number(rho)
    if isinstance(rho, Column):
        r = F.when((rho >= 0) & (rho < float("inf")), rho).otherwise(F.raise_error(F.lit("a weight is not finite (reason=bad-weight)")).cast("double"))
    top = F.greatest(F.lit(1.0), r)
    wrong = (F.col("err_pos") * r + F.col("err_neg")) / top
    answered = (F.col("ans_pos") * r + F.col("ans_neg")) / top
    z = influence(cap) / F.lit(float(cap)) * (wrong - a * answered) + a
    return counts.select(*by, "site_id", "tau_idx", "tau", z.alias("z"))


def unit_atoms(records: DataFrame, alpha: float, taus: list[float] = C.TAU_GRID, keep: list[str] = ()) -> DataFrame:
    """(keep..., tau_idx, tau, z): atoms of records that are sites of their own: alpha where it is not answered, else alpha more or less."""
    grid = F.array(*[F.struct(F.lit(i).alias("tau_idx"), F.lit(t).alias("tau")) for i, t in enumerate(taus)])
    z = F.when(F.col("score") >= F.col("g.tau"), F.col("err").cast("double") - F.lit(alpha) + F.lit(alpha)).otherwise(F.lit(alpha))
    return records.withColumn("g", F.explode(grid)).select(*keep, "g.tau_idx", "g.tau", z.alias("z"))


def walk_order(aux_atoms: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by..., tau_idx, tau, mean_z, step): thresholds by ascending mean atom over all sites, ties by index, from 1."""
    means = aux_atoms.groupBy(*by, "tau_idx", "tau").agg(F.avg("z").alias("mean_z"))
    return means.withColumn("step", F.row_number().over(W.partitionBy(*by).orderBy("mean_z", "tau_idx")))


def pool_risk(counts: DataFrame, *, cap: int = C.M_INFLUENCE) -> DataFrame:
    """(tau_idx, tau, risk, coverage, exceed_share): influence-weighted risk of the answered set of a pool.

    risk: NULL where nothing is answered; coverage: answered over all records; exceed_share: see exceedance.
    """
    g = influence(cap)
    wrong, answered = F.col("err_pos") + F.col("err_neg"), F.col("ans_pos") + F.col("ans_neg")
    return counts.groupBy("tau_idx", "tau").agg(
        F.try_divide(F.sum(g * wrong), F.sum(g * answered)).alias("risk"), F.try_divide(F.sum(answered).cast("double"), F.sum("n")).alias("coverage"),
    )


def exceedance(counts: DataFrame, alpha: float) -> DataFrame:
    """(tau_idx, tau, sites, exceed_share): of the sites that answer, the share whose own error is above alpha."""
    wrong, answered = F.col("err_pos") + F.col("err_neg"), F.col("ans_pos") + F.col("ans_neg")
    over = wrong.cast("double") / F.when(answered > 0, answered) > alpha
    return counts.groupBy("tau_idx", "tau").agg(F.count_if(answered > 0).alias("sites"), F.avg(F.when(answered > 0, over.cast("double"))).alias("exceed_share"))


def capped_share(sizes: DataFrame, cap: int = C.M_INFLUENCE) -> DataFrame:
    """(capped_share, sites_above, min_g_over_n, median_n): how much of the records the cap takes influence from."""
    n = F.col("n")
    return sizes.agg(
        F.try_divide(F.sum(F.greatest(n - cap, F.lit(0))).cast("double"), F.sum(n)).alias("capped_share"), F.count_if(n > cap).alias("sites_above"),
        F.min(F.when(n > 0, influence(cap))).alias("min_g_over_n"), F.median(n).alias("median_n"),
    )


def feasibility(counts: DataFrame, alpha: float, n_carrying: int, *, cap: int = C.M_INFLUENCE, delta: float = C.DELTA) -> DataFrame:
    """(margin, floor, ratio): the best coverage * (alpha - risk) * mean influence over thresholds, beside what a test needs.

    margin is NULL where nothing is answered at any threshold.
    """
    import math

    carried = F.avg(F.when(F.col("n") > 0, F.least(F.col("n"), F.lit(cap)) / F.lit(float(cap))))
    per = counts.groupBy("tau_idx").agg(carried.alias("carried"), F.sum(F.col("ans_pos") + F.col("ans_neg")).alias("ans"), F.sum(F.col("err_pos") + F.col("err_neg")).alias("err"), F.sum("n").alias("n"))
    gain = F.try_divide(F.col("ans").cast("double"), F.col("n")) * (F.lit(alpha) - F.try_divide(F.col("err").cast("double"), F.col("ans")))
    floor = math.log(1.0 / delta) * (1.0 - alpha) / max(n_carrying, 1)
    best = per.agg((F.max(gain) * F.max("carried")).alias("margin"))
    return best.select("margin", F.lit(floor).alias("floor"), (F.col("margin") / F.lit(floor)).alias("ratio"))


def class_rates(records: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """(site_id, n, pos, pred_pos, pred_neg): per-site sufficient statistics of the label-shift correction."""
    hit = F.col("y") != F.col("err")
    predicted = (F.col("y") & hit) | (~F.col("y") & F.col("err"))
    got = records.groupBy("site_id").agg(
        F.count("*").alias("n"), F.count_if("y").alias("pos"), F.count_if(predicted & F.col("y")).alias("pred_pos"), F.count_if(predicted & ~F.col("y")).alias("pred_neg")
    )
    if sites is None:
        return got
    return sites.select("site_id").distinct().join(got, "site_id", "left").na.fill(0)


def pooled_rates(stats: DataFrame) -> DataFrame:
    """(c0, c1, pi_s): false-positive rate, true-positive rate and prevalence; NULL where a class is empty."""
    pos, neg = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return stats.agg(
        F.try_divide(F.sum("pred_neg").cast("double"), neg).alias("c0"), F.try_divide(F.sum("pred_pos").cast("double"), pos).alias("c1"), F.try_divide(pos.cast("double"), F.sum("n")).alias("pi_s")
    )


def site_table(records: DataFrame, tau: float) -> DataFrame:
    """(site_id, n, n_answered, coverage, err_rate, pos_share): a row for each site, for a report."""
    a = F.col("score") >= F.lit(tau)
    return records.groupBy("site_id").agg(
        F.count("*").alias("n"), F.count_if(a).alias("n_answered"), F.avg(a.cast("double")).alias("coverage"),
        F.avg(F.when(a, F.col("err").cast("double"))).alias("err_rate"), F.avg(F.col("y").cast("double")).alias("pos_share"),
    )


def with_strata(per_site: DataFrame, dimension: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """per_site with the columns of its site in a dimension, and `found`; sites that it lacks get NULLs and false.

    Of several rows of a site the last in `order` counts. Values are stripped; blank ones are NULL.
    """
    last = dimension.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("site_id")).agg(F.max_by(F.struct(*[F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) for c in columns]), order).alias("last"))
    return per_site.join(last, "site_id", "left").select("*", *[F.col(f"last.{c}").alias(c) for c in columns], F.col("last").isNotNull().alias("found")).drop("last")


def linkage(records: DataFrame, positive: Column, flags: dict[str, Column]) -> DataFrame:
    """(site_id, n, n_pos, prevalence, then for each flag n_ and share_): how much of each site is linked to what."""
    got = records.groupBy("site_id").agg(F.count("*").alias("n"), F.count_if(positive).alias("n_pos"), *[F.count_if(c).alias(f"n_{k}") for k, c in flags.items()])
    shares = [F.try_divide(F.col(f"n_{k}").cast("double"), F.col("n")).alias(f"share_{k}") for k in flags]
    return got.select("*", F.try_divide(F.col("n_pos").cast("double"), F.col("n")).alias("prevalence"), *shares)


def in_label_order(sites: DataFrame, label: str) -> DataFrame:
    """sites with `place`: by the number at the end of the label, labels without one last, ties by label."""
    number = F.expr(f"try_cast(regexp_extract({label}, '([0-9]+)$', 1) AS bigint)")
    return sites.withColumn("place", F.row_number().over(W.orderBy(number.asc_nulls_last(), label)))  # a row for each site


def subset_sites(records: DataFrame, keep: Column) -> DataFrame:
    """The records of the sites to keep, with `dense_id`: those sites' numbers from 0 without gaps, in the order of site_id."""
    left = records.where(keep)
    names = left.select("site_id").distinct().withColumn("dense_id", F.row_number().over(W.orderBy("site_id")) - 1)  # a row for each site
    return left.join(names, "site_id")
