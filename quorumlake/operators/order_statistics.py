"""Exact order statistics of many groups at once without holding a group's values in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quorumlake.sources.staging import cut

#: Buckets that a range of values is cut into, and rows of a bucket from which its values are gathered.
BUCKETS, FEW = 1024, 16_384

#: Rows of a table up to which it is sent to all tasks, where a join by group would bring a group's values to one.
SMALL = 100_000


def beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on keys, of which NULLs meet as well."""
    renamed = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_of_{k}" for k in keys])


def with_rows_before(counts: DataFrame, value: str, n: str = "n", by: list[str] = ()) -> DataFrame:
    """counts with `before`: how many rows of the group have a smaller value.

    counts: (by..., value, n, ...), one row for each value of a group. Values are dealt out in ranges over (by, value);
    what a range holds of a group in all is summed first, and a running sum over these few sums is the offset with which
    each range then counts on by itself. So a group's values are spread over as many tasks as it has ranges.
    """
    by = list(by)
    spark = counts.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a checkpoint, so that both readings below see the same ranges
    dealt = cut(counts.repartitionByRange(ranges, *by, value).withColumn("_range", F.spark_partition_id()))
    held = dealt.groupBy(*by, "_range").agg(F.sum(n).alias("_held"))
    offsets = held.withColumn("_offset", F.coalesce(F.sum("_held").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("_held")
    within = W.partitionBy(*by, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    own = dealt.withColumn("_own", F.coalesce(F.sum(n).over(within), F.lit(0).cast("long")))
    return beside(own, offsets, [*by, "_range"]).withColumn("before", F.col("_own") + F.col("_offset")).drop("_range", "_own", "_offset")



def in_ranges(rows: DataFrame, order: str, by: list[str] = ()) -> DataFrame:
    """rows dealt out in ranges over (by, order), with the range of each in `_range`, for with_running; order has no ties within a group."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(ranges, *by, order).withColumn("_range", F.spark_partition_id()))


def with_running(dealt: DataFrame, name: str, value: Column, order: str, by: list[str] = ()) -> DataFrame:
    """dealt, from in_ranges, with `name`: the sum of value over the group's rows up to each row, itself included.

    Sums of whole ranges come first; each range then adds up by itself from its offset.
    """
    keys = [*by, "_range"]
    held = dealt.groupBy(*keys).agg(F.sum(value).alias("_held"))
    offsets = held.withColumn("_offset", F.coalesce(F.sum("_held").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_held")
    own = dealt.withColumn("_own", F.sum(value).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)))
    return beside(own, offsets, keys).withColumn(name, F.col("_own") + F.col("_offset")).drop("_own", "_offset")


def _coarse(v: Column) -> Column:
    """A whole number that does not fall as v grows: its sign and the power of two below it; NaN comes last."""
    size = F.floor(F.log2(F.abs(v))).cast("int") + 1200
    return F.when(F.isnan(v), 9999).when(v == 0, 0).when(F.abs(v) == float("inf"), F.when(v > 0, 9998).otherwise(-9998)).when(v > 0, size).otherwise(-size)


def coarse_counts(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., _b, _n, _lo, _hi): the histogram by powers of two of each group's values, some thousand rows a group at most."""
    base = rows.select(*by, F.col(value).cast("double").alias("_v"))
    counts = base.withColumn("_b", _coarse(F.col("_v"))).groupBy(*by, "_b").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    return cut(counts)


def values_at(rows: DataFrame, value: str, places: DataFrame, by: list[str], *, few: int = FEW, coarse: DataFrame | None = None) -> DataFrame:
    """(by..., place, v): for each wanted place, counted from 0, the value there when a group's values are in order.

    rows: (by..., value), values doubles that are not NULL; places: (by..., place), each below its group's row count;
    coarse: what coarse_counts gives of the rows, if it is there already.
    Histograms of all groups are made at once: first by powers of two, then every bucket that holds a wanted place is cut
    into 1,024 equal parts, and so on until a bucket has one value or at most `few` rows, which are then gathered. A pass
    is a scan with partial counts; nothing else is shuffled.
    """
    v = F.col("_v")
    base = rows.select(*by, F.col(value).cast("double").alias("_v"))
    upto = lambda part, order: F.sum("_n").over(W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))

    def located(counts: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
        """wanted: (keys..., place, _before): which bucket of counts (keys..., _b, _n, _lo, _hi) holds the place."""
        run = counts.withColumn("_upto", upto(keys, "_b"))
        both = beside(wanted, run, keys)
        inside = (F.col("place") >= F.col("_before") + F.col("_upto") - F.col("_n")) & (F.col("place") < F.col("_before") + F.col("_upto"))
        return cut(both.where(inside).select(*by, "place", (F.col("_before") + F.col("_upto") - F.col("_n")).alias("_before"), "_n", "_lo", "_hi"))

    counted = lambda df, *keys: df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    state = located(coarse_counts(rows, value, by) if coarse is None else coarse, places.select(*by, "place").distinct().withColumn("_before", F.lit(0).cast("long")), by)
    done, n_done = None, 0
    sent = lambda df, n: F.broadcast(df) if n <= SMALL else df  # noqa: E731; with more rows there are many groups to spread values by
    while True:
        ready = state.where((F.col("_lo") == F.col("_hi")) | (F.col("_n") <= few))
        done = ready if done is None else done.unionByName(ready)
        n_all = state.count()
        state = state.where(~((F.col("_lo") == F.col("_hi")) | (F.col("_n") <= few)))
        n_open = state.count()
        n_done += n_all - n_open
        if not n_open:
            break
        open_ = state.select(*by, "_lo", "_hi").distinct().withColumnsRenamed({"_lo": "_from", "_hi": "_to"})
        inside = beside(base, sent(open_, n_open), by).where((v >= F.col("_from")) & (v <= F.col("_to")))
        part = F.least(F.floor((v - F.col("_from")) / (F.col("_to") - F.col("_from")) * BUCKETS).cast("int"), F.lit(BUCKETS - 1))
        counts = counted(inside.withColumn("_b", part), *by, "_from", "_b")
        wanted = state.select(*by, "place", "_before", F.col("_lo").alias("_from"))
        state = located(counts, wanted, [*by, "_from"])
    single = done.where(F.col("_lo") == F.col("_hi")).select(*by, "place", F.col("_lo").alias("v"))
    open_ = done.where(F.col("_lo") < F.col("_hi"))
    ranges = open_.select(*by, F.col("_lo").alias("_from"), F.col("_hi").alias("_to"), F.col("_before").alias("_at")).distinct()
    held = beside(base, sent(ranges, n_done), by).where((v >= F.col("_from")) & (v <= F.col("_to")))  # at most `few` rows a range
    ranked = held.withColumn("place", F.col("_at") + F.row_number().over(W.partitionBy(*by, "_from").orderBy("_v")) - 1)
    return single.unionByName(beside(open_.select(*by, "place"), ranked.select(*by, "place", F.col("_v").alias("v")), [*by, "place"]))


def exact_quantiles(rows: DataFrame, value: str, probabilities: dict[str, float], by: list[str] = (), *, few: int = FEW) -> DataFrame:
    """(by..., n, one column for each probability): exact quantiles, linear between ranks; NULL values are left out.

    Groups without a value are absent, but without groups there is always one row.
    """
    by, given = list(by), bool(by)
    if not given:
        rows, by = rows.withColumn("_all", F.lit(0)), ["_all"]
    known = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_value"))
    coarse = coarse_counts(known, "_value", by)
    sizes = coarse.groupBy(*by).agg(F.sum("_n").alias("n"))
    wanted = F.array(*[F.struct(F.lit(k).alias("_name"), F.lit(float(p)).alias("p")) for k, p in probabilities.items()])
    at = sizes.select(*by, "n", F.explode(wanted).alias("w")).select(*by, "n", "w._name", (F.col("w.p") * (F.col("n") - 1)).alias("at"))
    at = at.withColumns({"low": F.floor("at").cast("long"), "high": F.ceil("at").cast("long")})
    ends = at.select(*by, "n", "_name", (F.col("at") - F.col("low")).alias("share"), F.explode(F.array(*[F.struct(F.lit(e).alias("end"), F.col(e).alias("place")) for e in ("low", "high")])).alias("e"))
    ends = ends.select(*by, "n", "_name", "share", "e.end", "e.place")
    found = beside(ends, values_at(known, "_value", ends.select(*by, "place").distinct(), by, few=few, coarse=coarse), [*by, "place"])
    low, high = (F.max(F.when(F.col("end") == e, F.col("v"))) for e in ("low", "high"))
    both = found.groupBy(*by, "_name").agg(F.first("n").alias("n"), F.first("share").alias("share"), low.alias("_low"), high.alias("_high"))
    both = both.withColumn("q", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise((1 - F.col("share")) * F.col("_low") + F.col("share") * F.col("_high")))
    got = both.groupBy(*by).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("_name") == k, F.col("q"))).alias(k) for k in probabilities])
    if given:
        return got
    one = rows.sparkSession.createDataFrame([(0,)], "_all int").join(got, "_all", "left").drop("_all")
    return one.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
