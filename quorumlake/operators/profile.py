"""Profiles of tables: distributions, counts of counts, bounded value counts, spread of rates across sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quorumlake import constants as C
from quorumlake.functions import cells
from quorumlake.sources.staging import staged

from .order_statistics import beside, exact_quantiles


def quantiles(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """(by..., n, min_positive, p01, p50, p99, max, mean, sd): exact, linear between ranks; NULLs are left out.

    Percentiles come from histograms that narrow in on them (see order_statistics), whatever the number of values.
    """
    by, v = list(by), F.col(value).cast("double")
    cuts = exact_quantiles(df, value, {"p01": 0.01, "p50": 0.5, "p99": 0.99}, by)
    got = df.where(v.isNotNull()).groupBy(*by).agg(F.min(F.when(v > 0, v)).alias("min_positive"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"))
    both = beside(got, cuts, by) if by else got.crossJoin(cuts)  # without groups both have one row
    return both.select(*by, "n", "min_positive", "p01", "p50", "p99", "max", "mean", "sd")


def size_distribution(sizes: DataFrame, n: str = "n", below: tuple[int, ...] = (20, 50, 100, 500)) -> DataFrame:
    """(min, q1, median, q3, max, mean, n_below_...): how large sites are."""
    got = sizes.agg(F.min(n).alias("min"), F.percentile(n, [0.25, 0.5, 0.75]).alias("q"), F.max(n).alias("max"), F.avg(n).alias("mean"), *[F.count_if(F.col(n) < b).alias(f"n_below_{b}") for b in below])
    return got.select("min", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("q1", "median", "q3"))], "max", "mean", *[f"n_below_{b}" for b in below])


def value_counts(df: DataFrame, value: str, top: int) -> DataFrame:
    """(value, n, place): the most frequent values, ties by value; all others together under '__overflow__'."""
    counts = df.groupBy(F.col(value).cast("string").alias("value")).agg(F.count("*").alias("n"))
    best = counts.orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(top)
    head = best.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), F.asc_nulls_last("value"))))
    rest = counts.join(best.select(F.col("value").alias("b")), F.col("value").eqNullSafe(F.col("b")), "left_anti").agg(F.sum("n").alias("n")).where("n is not null")
    return head.unionByName(rest.select(F.lit("__overflow__").alias("value"), "n", F.lit(top + 1).alias("place")))


def rows_per_key(df: DataFrame, key: str, last: int = 10) -> DataFrame:
    """(rows, keys): how many keys have how many rows; `last` and more together."""
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("c"))
    return per.groupBy(F.when(F.col("c") >= last, f"{last}+").otherwise(F.col("c").cast("string")).alias("rows")).agg(F.count("*").alias("keys"))


def rate_spread(df: DataFrame, site: str, conditions: dict[str, Column]) -> DataFrame:
    """(name, sites, mean, sd, p10, p50, p90): each condition's rate by site, and how the rates spread over sites."""
    flags = F.array(*[F.struct(F.lit(k).alias("name"), c.cast("double").alias("hit")) for k, c in conditions.items()])
    long = df.select(site, F.explode(flags).alias("f")).groupBy(site, "f.name").agg(F.avg("f.hit").alias("rate"))
    got = long.groupBy("name").agg(F.count("*").alias("sites"), F.avg("rate").alias("mean"), F.stddev_pop("rate").alias("sd"), F.percentile("rate", [0.1, 0.5, 0.9]).alias("q"))
    return got.select("name", "sites", "mean", "sd", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("p10", "p50", "p90"))])


def prevalence_contrast(df: DataFrame, flag: Column, positive: Column) -> DataFrame:
    """(n_present, n_absent, prev_present, prev_absent, ratio): prevalence where a flag is absent over where it is present."""
    p = positive.cast("double")
    got = df.agg(F.count_if(flag).alias("n_present"), F.count_if(~flag).alias("n_absent"), F.avg(F.when(flag, p)).alias("prev_present"), F.avg(F.when(~flag, p)).alias("prev_absent"))
    return got.withColumn("ratio", F.try_divide("prev_absent", "prev_present"))


def level_drift(df: DataFrame, columns: dict[str, tuple[str, ...]]) -> DataFrame:
    """(name, n, n_other, other_share): how much of each categorical column no listed level holds."""
    cells = F.array(*[F.struct(F.lit(k).alias("name"), (~F.coalesce(F.trim(F.col(k)), F.lit("")).isin([v for v in levels if v != "OTHER"])).alias("other")) for k, levels in columns.items()])
    return df.select(F.explode(cells).alias("c")).groupBy("c.name").agg(F.count("*").alias("n"), F.count_if("c.other").alias("n_other")).withColumn("other_share", F.try_divide(F.col("n_other").cast("double"), F.col("n")))


def missing_share(df: DataFrame, site: str, columns: list[str]) -> DataFrame:
    """(site, missing_share): the mean over a site's records of the share of columns that are missing."""
    gone = sum(F.col(c).isNull().cast("double") for c in columns) / float(len(columns))
    return df.groupBy(site).agg(F.avg(gone).alias("missing_share"))


def outcome_missing(df: DataFrame, key: str, order: str, columns: list[str], positive: Column) -> DataFrame:
    """(name, n_present, n_absent, prev_present, prev_absent, ratio): does a missing cell tell of the outcome?

    Of each key the row that comes first in `order` counts, as it stands, even where its cells are missing.
    """
    first = df.groupBy(key).agg(F.min_by(F.struct(positive.cast("double").alias("p"), *columns), order).alias("r")).select("r.*")
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).isNull().alias("gone")) for c in columns])
    long = first.select("p", F.explode(pairs).alias("c")).select("p", "c.name", "c.gone")
    got = long.groupBy("name").agg(F.count_if(~F.col("gone")).alias("n_present"), F.count_if("gone").alias("n_absent"), F.avg(F.when(~F.col("gone"), F.col("p"))).alias("prev_present"), F.avg(F.when(F.col("gone"), F.col("p"))).alias("prev_absent"))
    return got.withColumn("ratio", F.try_divide("prev_absent", "prev_present"))


def worst_missing(contrasts: DataFrame, least: int, top: int = 6) -> DataFrame:
    """The largest ratios of contrasts (name, n_present, n_absent, ratio) of which both sides have at least `least` keys."""
    return contrasts.where((F.least("n_present", "n_absent") >= least) & F.col("ratio").isNotNull()).orderBy(F.desc("ratio"), "name").limit(top)


def identities(found: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(name, n, expected, matches): counts (name, n) against those of the release; a table that is not there has none."""
    known = found.sparkSession.createDataFrame(sorted(expected.items()), "name string, expected long")
    return known.join(found, "name", "left").select("name", "n", "expected", F.coalesce(F.col("n") == F.col("expected"), F.lit(False)).alias("matches"))


def cell_profiles(cells_: DataFrame, by: list[str], cell: str = "cell") -> DataFrame:
    """(by..., n, n_empty, n_minus_one, n_other_negative, n_unparseable, n_zero, n_value, min_positive, p01, p50, p99, max): what text cells hold.

    cells_: a row for each cell, so the columns of all tables are profiled by one plan. Quantiles are exact, over all
    numbers but the -1 that stands for missing.
    """
    text = F.coalesce(cells.stripped(F.col(cell)), F.lit(""))
    # parsed once, as what follows reads the numbers again and again
    rows = staged(cells_.select(*by, (text == "").alias("_blank"), cells.maybe_float(F.col(cell)).alias("_v")), "numbers")
    blank, v = F.col("_blank"), F.col("_v")
    value = F.when(v != C.SENTINEL_MISSING, v)
    told = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(blank).alias("n_empty"), F.count_if(v == C.SENTINEL_MISSING).alias("n_minus_one"), F.count_if((v < 0) & (v != C.SENTINEL_MISSING)).alias("n_other_negative"),
        F.count_if(~blank & v.isNull()).alias("n_unparseable"), F.count_if(v == 0).alias("n_zero"), F.count(value).alias("n_value"), F.min(F.when(v > 0, v)).alias("min_positive"), F.max(value).alias("max"))
    cuts = exact_quantiles(rows.withColumn("_v", value), "_v", {"p01": 0.01, "p50": 0.5, "p99": 0.99}, by).drop("n")
    names = [c for c in told.columns if c != "max"]
    return beside(told, cuts, by, "left").select(*names, "p01", "p50", "p99", "max")


def unknown_tokens(cells_: DataFrame, by: list[str], cell: str = "cell", top: int = 4) -> DataFrame:
    """(by..., token, n, place): the most frequent cells of each column that are neither blank nor numbers, ties by token."""
    text = F.coalesce(cells.stripped(F.col(cell)), F.lit(""))
    odd = cells_.select(*by, text.alias("token")).where((F.col("token") != "") & cells.maybe_float(F.col("token")).isNull())
    counts = odd.groupBy(*by, "token").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), "token"))).where(F.col("place") <= top)


def cell_dispersion(cells_: DataFrame, by: list[str], site: str, cell: str = "cell") -> DataFrame:
    """(by..., sites, mean_minus_one, sd_minus_one, p10, p50, p90, mean_missing, sd_missing): how the rates of missing cells spread over sites.

    A site counts for a column where it has a cell of it. The percentiles are those of the rates of -1.
    """
    number = cells.maybe_float(F.col(cell))
    one = (number == C.SENTINEL_MISSING).cast("double")
    rates = cells_.groupBy(*by, site).agg(F.avg(F.coalesce(one, F.lit(0.0))).alias("m1"), F.avg((number.isNull() | (number == C.SENTINEL_MISSING)).cast("double")).alias("gone"))
    got = rates.groupBy(*by).agg(F.count("*").alias("sites"), F.avg("m1").alias("mean_minus_one"), F.stddev_pop("m1").alias("sd_minus_one"), F.avg("gone").alias("mean_missing"), F.stddev_pop("gone").alias("sd_missing"))
    cuts = exact_quantiles(rates, "m1", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, by).drop("n")
    return beside(got, cuts, by, "left").select(*by, "sites", "mean_minus_one", "sd_minus_one", "p10", "p50", "p90", "mean_missing", "sd_missing")


def window_counts(df: DataFrame, conditions: dict[tuple[str, str], Column]) -> DataFrame:
    """(name, window, n): how many rows meet each named condition; conditions may overlap, unmet ones have 0."""
    flags = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(window).alias("window"), F.coalesce(c, F.lit(False)).alias("hit")) for (name, window), c in conditions.items()])
    return df.select(F.explode(flags).alias("c")).groupBy("c.name", "c.window").agg(F.count_if("c.hit").alias("n"))


def unit_windows(value: Column, name: str) -> dict[tuple[str, str], Column]:
    """The conditions by which the units of fractions of oxygen and temperatures are told apart, for window_counts."""
    if name == "fio2":
        (a, b), (c, d) = C.WINDOW_FIO2_FRACTION, C.WINDOW_FIO2_PERCENT
        fraction, percent = (value > a) & (value <= b), (value > c) & (value <= d)
        told = {"le_1": value <= 1.0, "gt_1": value > 1.0, "gt_100": value > 100.0, "fraction": fraction, "percent": percent, "neither": ~fraction & ~percent, "fraction_floor": value == a, "percent_floor": value == c}
    else:
        (a, b), (c, d) = C.WINDOW_TEMP_C, C.WINDOW_TEMP_F
        low, high = (value > a) & (value < b), (value > c) & (value < d)
        told = {"celsius": low, "fahrenheit": high, "neither": ~low & ~high, "above_celsius": value > b}
    known = value.isNotNull() & (value != C.SENTINEL_MISSING)
    return {(name, "missing"): value.isNull(), (name, "minus_one"): value == C.SENTINEL_MISSING} | {(name, w): known & c for w, c in told.items()}


def lengths(df: DataFrame, hours: str, groups: dict[str, Column]) -> DataFrame:
    """(name, n, n_hours, median_hours, p25, p75, under_4h, under_24h): lengths of stay within named groups, which may overlap."""
    flags = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in groups.items()]), lambda k: k.isNotNull())
    rows = df.select(F.col(hours).alias("_h"), F.explode(flags).alias("name"))
    got = rows.groupBy("name").agg(F.count("*").alias("n"), F.count("_h").alias("n_hours"), F.avg((F.col("_h") < 4).cast("double")).alias("under_4h"), F.avg((F.col("_h") < 24).cast("double")).alias("under_24h"))
    cuts = exact_quantiles(rows, "_h", {"p25": 0.25, "median_hours": 0.5, "p75": 0.75}, ["name"]).drop("n")
    return beside(got, cuts, ["name"], "left").select("name", "n", "n_hours", "median_hours", "p25", "p75", "under_4h", "under_24h")
