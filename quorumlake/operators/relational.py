"""Selections, deduplications and joins of the cleaning path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def first_of_group(df: DataFrame, group: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order; Spark keeps one row a group before it shuffles, so hot groups do not meet in a task."""
    return df.withColumn("_place", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where("_place = 1").drop("_place")


def first_stay(df: DataFrame, *, admission: str, stay: str, visit: str, offset: str) -> DataFrame:
    """One stay for each admission: least visit, then largest offset, then least stay; missing ones last.

    A stay without an admission is an admission of its own.
    """
    own = F.coalesce(F.concat(F.lit("a:"), F.col(admission).cast("string")), F.concat(F.lit("s:"), F.col(stay).cast("string")))
    return first_of_group(df, [own], [F.asc_nulls_last(visit), F.desc_nulls_last(offset), F.asc(stay)])


def keep_least_surrogate(df: DataFrame, keys: list[str], surrogate: str) -> DataFrame:
    """One row for each key: that of the least surrogate id; rows without one come last."""
    return first_of_group(df, [F.col(k) for k in keys], [F.asc_nulls_last(surrogate)])


def with_presence(left: DataFrame, right: DataFrame, key: str, flag: str) -> DataFrame:
    """left with the columns of right, NULL where it has no row, and a flag of 1.0 or 0.0 that says so."""
    return left.join(right.withColumn(flag, F.lit(1.0)), key, "left").withColumn(flag, F.coalesce(flag, F.lit(0.0)))


def prefer_version(df: DataFrame, key: str, version: str, value: str, preference: tuple[str, ...]) -> DataFrame:
    """(key, version, value): the row of the first preferred version that a key has, even where its value is NULL."""
    rank = F.coalesce(*[F.when(F.col(version) == v, F.lit(i)) for i, v in enumerate(preference)])
    return first_of_group(df.where(F.col(version).isin(*preference)), [F.col(key)], [rank]).select(key, version, value)


def without_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def with_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_semi")


def shared_keys(named: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, tables): keys that more than one of the named tables has."""
    tables = [df.select(key).distinct().withColumn("t", F.lit(name)) for name, df in named.items()]
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t)
    return both.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list("t")), "|").alias("tables"), F.count("*").alias("_n")).where("_n > 1").drop("_n")


def keys_of_many(df: DataFrame, key: str, site: str) -> DataFrame:
    """(n_keys, n_multi, share): keys that appear at more than one site."""
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg((F.min(site) < F.max(site)).alias("multi"))
    return per.agg(F.count("*").alias("n_keys"), F.count_if("multi").alias("n_multi"), F.try_divide(F.count_if("multi").cast("double"), F.count("*")).alias("share"))


def attrition(df: DataFrame, steps: list[tuple[str, Column]], site: str, positive: Column, times: Column | None = None) -> DataFrame:
    """(step_no, step, n_rows, n_sites, n_positive, prevalence): what is left after each of the successive conditions.

    One pass: every row gets the number of conditions it meets in a row, the ledger counts rows by it. A row counts as
    many times as `times` says, once where that is not given.
    """
    passed = F.lit(0)
    for i in range(len(steps) - 1, -1, -1):
        passed = F.when(F.coalesce(steps[i][1], F.lit(False)), passed + 1).otherwise(F.lit(0))
    marked = df.select(F.col(site).alias("site"), positive.alias("pos"), passed.alias("passed"), (F.lit(1) if times is None else times).cast("bigint").alias("times"))
    compact = marked.groupBy("site", "passed").agg(F.sum("times").alias("n"), F.sum(F.when(F.col("pos"), F.col("times")).otherwise(0)).alias("p"))
    names = F.array(*[F.struct(F.lit(i + 1).alias("step_no"), F.lit(name).alias("step")) for i, (name, _) in enumerate(steps)])
    rows = compact.select("*", F.explode(names).alias("s")).where("passed >= s.step_no")
    got = rows.groupBy("s.step_no", "s.step").agg(F.sum("n").alias("n_rows"), F.count_distinct("site").alias("n_sites"), F.sum("p").alias("n_positive"))
    return got.withColumn("prevalence", F.try_divide(F.col("n_positive").cast("double"), F.col("n_rows")))


def round_robin(df: DataFrame, site: str, order: str, cap: int) -> DataFrame:
    """Up to cap rows, taken in turn from each site."""
    turn = F.row_number().over(W.partitionBy(site).orderBy(order))
    return df.withColumn("turn", turn).orderBy("turn", site).limit(cap)


def largest_remainder(weights: DataFrame, key: str, weight: str, total: int, least: int = 0) -> DataFrame:
    """(key, quota): whole shares of a total in proportion to weights, at least `least` each; ties of remainders by key.

    weights has a row for each share, of which there are few.
    """
    spare = total - F.count("*").over(W.partitionBy()) * least
    exact = F.col(weight) / F.sum(weight).over(W.partitionBy()) * spare
    base = weights.select(key, exact.alias("exact"), F.floor(exact).alias("base"), spare.alias("spare"))
    place = F.row_number().over(W.orderBy((F.col("base") - F.col("exact")), key))
    rest = F.col("spare") - F.sum("base").over(W.partitionBy())
    return base.select(key, (F.col("base") + least + (place <= rest).cast("long")).alias("quota"))


def replayed(recorded: DataFrame, again: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """(key, recorded, replayed, agrees) of the keys that both result sets have."""
    a, b = recorded.select(key, F.col(value).alias("recorded")), again.select(key, F.col(value).alias("replayed"))
    return a.join(b, key).withColumn("agrees", F.abs(F.col("recorded") - F.col("replayed")) <= tolerance)
