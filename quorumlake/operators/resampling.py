"""Resampling of whole sites as relations: draws, sums over what they picked, the first valid ones, percentiles over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def seeded(*parts: Column | str | int) -> Column:
    """A number below 2^48 that hangs on the parts alone, the same in any engine: the first twelve digits of an MD5."""
    texts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(t, F.lit("")) for t in texts])), 1, 12), 16, 10).cast("long")


def resampled(stats: DataFrame, sums: list[str], *, draws: int, seed: int, stream: str = "", site: str = "site_id", by: list[str] = ()) -> DataFrame:
    """(by..., draw, sums...): the sums over as many sites as a group has, picked with replacement, for each draw from 1.

    stats: one row for each site of a group. The sites of a group are numbered in their order; the i-th pick of a draw
    is a seeded number modulo their count. Picks become (draw, site, times) before they meet the sums, and groups,
    draws and picks are rows alike, so any number of groups is one job.
    """
    by = list(by)
    own = W.partitionBy(*by)
    placed = stats.select(*by, (F.row_number().over(own.orderBy(F.asc_nulls_first(site))) - 1).cast("long").alias("place"), F.count("*").over(own).alias("n_sites"), *sums)
    groups = placed.where("place = 0").select(*by, "n_sites", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).repartition(*by, "draw")
    picks = groups.select(*by, "n_sites", "draw", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_sites"))).alias("pick"))
    number = seeded(seed, stream, *[F.col(c) for c in by], F.col("draw"), F.col("pick"))
    times = picks.groupBy(*by, "draw", F.pmod(number, F.col("n_sites")).alias("place")).agg(F.count("*").alias("times"))
    return times.join(placed.drop("n_sites"), [*by, "place"]).groupBy(*by, "draw").agg(*[F.sum(F.col("times") * F.col(c)).alias(c) for c in sums])


def bootstrap(draws: DataFrame, valid: Column, measures: dict[str, Column], *, wanted: int, most: int, low: float, high: float, by: list[str] = ()) -> DataFrame:
    """(by..., n_boot, n_attempts, <measure>_lo, <measure>_hi): percentiles over the first `wanted` valid draws of `most`.

    Draws that are not valid are topped up from later ones, in the order of draws, by a running count; n_attempts is the
    draw at which that ended. A group with fewer valid draws than wanted has NULL ends, never those of fewer draws.
    Percentiles are exact, linear between ranks.
    """
    good = F.coalesce(valid, F.lit(False))
    order = W.partitionBy(*by).orderBy("draw").rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = draws.where(F.col("draw") <= most).withColumns({"_good": good, "_place": F.count_if(good).over(order)})
    used = marked.withColumn("_used", F.col("_good") & (F.col("_place") <= wanted))
    ends = F.array(F.lit(low), F.lit(high))
    got = used.groupBy(*by).agg(F.count_if("_used").alias("n_boot"), F.max(F.when(F.col("_used"), F.col("draw"))).alias("_last"), *[F.percentile(F.when(F.col("_used"), m), ends).alias(k) for k, m in measures.items()])
    whole = F.col("n_boot") >= wanted
    sides = [F.when(whole, F.get(k, F.lit(i))).alias(f"{k}_{e}") for k in measures for i, e in enumerate(("lo", "hi"))]
    return got.select(*by, "n_boot", F.when(whole, F.col("_last")).otherwise(most).cast("int").alias("n_attempts"), *sides)


def exact_sample(rows: DataFrame, k: int, *, seed: int, key: str, stream: str = "sample") -> DataFrame:
    """k rows, or all where there are fewer: those of the least seeded numbers of their keys, ties by key.

    The k-th number is found by histograms that narrow in on it (see order_statistics), so nothing is sorted and the
    sample is the same for any partitioning. Of rows that share the last key any are taken. Columns are those of rows.
    """
    from .order_statistics import values_at

    name = "_number"
    marked = rows.withColumn(name, seeded(seed, stream, F.col(key)))
    n = rows.count()
    if n <= k:
        return rows
    if k < 1:
        return rows.limit(0)
    one = marked.withColumn("_all", F.lit(0))
    place = rows.sparkSession.createDataFrame([(0, k - 1)], "_all int, place long")
    last = int(values_at(one, name, place, ["_all"]).first()["v"])  # below 2^48, so exact as a double
    below = marked.where(F.col(name) < last)
    tied = marked.where(F.col(name) == last)
    left = k - below.count()
    first = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(key))
    return below.drop(name).unionByName(tied.withColumn("_place", first).where(F.col("_place") <= left).drop("_place", name))
