"""Registered queries of the column profiler over lineitem with dirty cells, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions import cells
from quorumlake.operators import profile, ranks

from .queries import _DIRTY, _FEATURES, _LONG, _NUMBER, SITES, _screen_input, query, rounded, table

_OTHER = "CASE l_linenumber WHEN 2 THEN ' -1.0 ' WHEN 3 THEN 'NaN' WHEN 4 THEN '\\N' WHEN 6 THEN '0' ELSE round(l_discount * 100)::BIGINT::VARCHAR END"
_CELLS = f"""WITH d AS (SELECT (l_orderkey % {SITES})::INT AS site_id, l_linenumber, trim({_DIRTY}) AS a, trim({_OTHER}) AS b FROM lineitem),
c AS (SELECT site_id, 'quantity' AS name, a AS t FROM d UNION ALL SELECT site_id, 'discount', b FROM d),
v AS (SELECT *, CASE WHEN regexp_matches(t, {_NUMBER}) THEN t::DOUBLE END AS v FROM c)"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    a = F.when(n == 1, "-1").when(n == 2, "").when(n == 3, "n/a").when(n == 4, "-7").when(n == 5, " 21 ").otherwise(F.col("l_quantity").cast("string"))
    b = F.when(n == 2, " -1.0 ").when(n == 3, "NaN").when(n == 4, "\\N").when(n == 6, "0").otherwise(F.round(F.col("l_discount") * 100).cast("long").cast("string"))
    pairs = F.array(F.struct(F.lit("quantity").alias("name"), a.alias("cell")), F.struct(F.lit("discount").alias("name"), b.alias("cell")))
    return table(spark, d, "lineitem").select((F.col("l_orderkey") % SITES).cast("int").alias("site_id"), F.explode(pairs).alias("c")).select("site_id", "c.name", "c.cell")


@query(f"""{_CELLS} SELECT name, count(*) AS n, count(*) FILTER (t = '') AS n_empty, count(*) FILTER (v = -1) AS n_minus_one, count(*) FILTER (v < 0 AND v <> -1) AS n_other_negative, count(*) FILTER (t <> '' AND v IS NULL) AS n_unparseable,
  count(*) FILTER (v = 0) AS n_zero, count(*) FILTER (v <> -1) AS n_value, min(v) FILTER (v > 0) AS min_positive, round(quantile_cont(v, 0.01) FILTER (v <> -1), 9) AS p01, round(quantile_cont(v, 0.5) FILTER (v <> -1), 9) AS p50,
  round(quantile_cont(v, 0.99) FILTER (v <> -1), 9) AS p99, max(v) FILTER (v <> -1) AS max FROM v GROUP BY name""")
def cell_profiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.cell_profiles(_cells(spark, d), ["name"]), 9, "p01", "p50", "p99")


@query(f"""{_CELLS}, r AS (SELECT name, site_id, avg(coalesce(v = -1, false)::INT::DOUBLE) AS m, avg((v IS NULL OR v = -1)::INT::DOUBLE) AS g FROM v GROUP BY ALL)
SELECT name, count(*) AS sites, round(avg(m), 9) AS mean_minus_one, round(stddev_pop(m), 9) AS sd_minus_one, round(quantile_cont(m, 0.1), 9) AS p10, round(quantile_cont(m, 0.5), 9) AS p50, round(quantile_cont(m, 0.9), 9) AS p90,
  round(avg(g), 9) AS mean_missing, round(stddev_pop(g), 9) AS sd_missing FROM r GROUP BY name""")
def cell_dispersion(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.cell_dispersion(_cells(spark, d), ["name"], "site_id"), 9, "mean_minus_one", "sd_minus_one", "p10", "p50", "p90", "mean_missing", "sd_missing")


@query(f"{_CELLS} SELECT name, t AS token, count(*) AS n, (row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, t))::INT AS place FROM v WHERE t <> '' AND v IS NULL GROUP BY name, t QUALIFY place <= 4")
def unknown_tokens(spark: SparkSession, d: str) -> DataFrame:
    return profile.unknown_tokens(_cells(spark, d), ["name"])


@query(f"""{_CELLS}, q AS (SELECT v FROM v WHERE name = 'quantity'), k AS (SELECT *, v IS NOT NULL AND v <> -1 AS known FROM q)
SELECT 'fio2' AS name, w AS window, n FROM (SELECT unnest(['missing', 'minus_one', 'le_1', 'gt_1', 'gt_100', 'fraction', 'percent', 'neither', 'fraction_floor', 'percent_floor']) AS w,
  unnest([count(*) FILTER (v IS NULL), count(*) FILTER (v = -1), count(*) FILTER (known AND v <= 1), count(*) FILTER (known AND v > 1), count(*) FILTER (known AND v > 100), count(*) FILTER (known AND v > 0.21 AND v <= 1),
    count(*) FILTER (known AND v > 21 AND v <= 100), count(*) FILTER (known AND NOT (v > 0.21 AND v <= 1) AND NOT (v > 21 AND v <= 100)), count(*) FILTER (known AND v = 0.21), count(*) FILTER (known AND v = 21)]) AS n FROM k)
UNION ALL SELECT 'temperature', w, n FROM (SELECT unnest(['missing', 'minus_one', 'celsius', 'fahrenheit', 'neither', 'above_celsius']) AS w,
  unnest([count(*) FILTER (v IS NULL), count(*) FILTER (v = -1), count(*) FILTER (known AND v > 25 AND v < 45), count(*) FILTER (known AND v > 77 AND v < 113),
    count(*) FILTER (known AND NOT (v > 25 AND v < 45) AND NOT (v > 77 AND v < 113)), count(*) FILTER (known AND v > 45)]) AS n FROM k)""")
def window_counts(spark: SparkSession, d: str) -> DataFrame:
    v = _cells(spark, d).where("name = 'quantity'").select(cells.maybe_float(F.col("cell")).alias("v"))
    return profile.window_counts(v, profile.unit_windows(F.col("v"), "fio2") | profile.unit_windows(F.col("v"), "temperature"))


@query("""WITH o AS (SELECT o_orderkey, date_diff('second', o_orderdate, l_shipdate) / 3600.0::DOUBLE AS h, l_returnflag = 'R' AS r, l_linenumber = 1 AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT 'returned' AS name, h FROM o WHERE r UNION ALL SELECT 'kept', h FROM o WHERE NOT r UNION ALL SELECT 'first-returned', h FROM o WHERE f AND r)
SELECT name, count(*) AS n, count(h) AS n_hours, round(quantile_cont(h, 0.5), 6) AS median_hours, round(quantile_cont(h, 0.25), 6) AS p25, round(quantile_cont(h, 0.75), 6) AS p75,
  round(avg((h < 4)::INT::DOUBLE), 9) AS under_4h, round(avg((h < 24)::INT::DOUBLE), 9) AS under_24h FROM g GROUP BY name""")
def stay_lengths(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    hours = (F.unix_timestamp("l_shipdate") - F.unix_timestamp("o_orderdate")) / 3600.0
    returned = F.col("l_returnflag") == "R"
    got = profile.lengths(both.withColumn("h", hours), "h", {"returned": returned, "kept": ~returned, "first-returned": returned & (F.col("l_linenumber") == 1)})
    return rounded(rounded(got, 6, "median_hours", "p25", "p75"), 9, "under_4h", "under_24h")


@query(f"""{_LONG}, q AS (SELECT feature, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM long GROUP BY feature),
p AS (SELECT feature, y, value, len(list_filter(cuts, lambda c: c < value)) + 1 AS decile FROM long JOIN q USING (feature))
SELECT feature, decile::INT AS decile, count(*) AS n, round(avg(y::INT::DOUBLE), 9) AS prevalence, round(min(value), 6) AS least, round(max(value), 6) AS most FROM p GROUP BY ALL""")
def decile_contrast(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(ranks.decile_contrast(_screen_input(spark, d), _FEATURES[1:2] + _FEATURES[:1] + _FEATURES[2:], "y"), 9, "prevalence"), 6, "least", "most")
