"""Operator 7: URL filters by dated lists, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def host_of(url: Column) -> Column:
    """The lower-cased host of a URL, without user, port and final dot; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """The path of a URL, without query and fragment, from its first slash on; empty where there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(url: Column, most_labels: int, most_segments: int) -> Column:
    """What a list entry may say to hold a URL: its host and the domains above it, and its host with the path's openings.

    Domains of up to most_labels labels and paths of up to most_segments segments: no entry has more.
    """
    labels = F.split(host_of(url), r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(most_labels))), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    domains = F.when(n <= most_labels, domains).otherwise(F.concat(domains, F.array(host_of(url))))
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    depth = F.least(F.size(segments), F.lit(most_segments))
    paths = F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda k: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(segments, F.lit(1), k), "/"))))
    return F.concat(domains, F.coalesce(paths, F.array().cast("array<string>")))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, since, until): when each pattern was on each list; until is exclusive, null while it still is.

    entries: (list, pattern, day, action) with action 'add' or 'remove'. Of entries of the same day a removal is the
    last. Hosts of patterns are brought to lower case; paths stay as they are. Repeated entries change nothing. Entries with a null in list, pattern, day or action are void.
    """
    host = F.substring_index("pattern", "/", 1)
    pattern = F.concat(F.lower(host), F.expr("substring(pattern, length(substring_index(pattern, '/', 1)) + 1)"))
    one = entries.where("list is not null and pattern is not null and day is not null and action in ('add', 'remove')").groupBy("list", pattern.alias("pattern"), "day").agg(F.max("action").alias("action"))
    order = W.partitionBy("list", "pattern").orderBy("day")
    turns = one.withColumn("before", F.lag("action").over(order)).where("before is null or before <> action")
    return turns.withColumn("until", F.lead("day").over(order)).where("action = 'add'").select("list", "pattern", F.col("day").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame, *, id_col: str = "page_id", url_col: str = "url", day_col: str = "day") -> DataFrame:
    """Operator 7. (id, host, day, blocked, n_lists, n_entries, pattern, since): a row for each row of captures.

    Evaluates each capture against the entries that were active on the day it was fetched, as of then: n_entries of
    n_lists lists hold it, pattern is the longest such pattern (the first by code point among equals) and since the day
    from which the smallest list has had it. A domain entry holds its subdomains, a host/path entry what lies below it.

    Null or hostless URLs and null days match nothing: blocked is false. Repeated rows stay. Entries are turned into
    intervals; captures are reduced to their distinct keys and days before they meet them, so a host with a third of
    all captures meets the lists once a day, and the verdicts go back to captures by URL key and day.
    """
    held = intervals(entries)
    deepest = held.agg(F.max(F.size(F.split(F.substring_index("pattern", "/", 1), r"\."))), F.max(F.size(F.split("pattern", "/")) - 1)).first()
    most_labels, most_segments = (deepest[0] or 1), (deepest[1] or 0)
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(day_col).alias("day"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("keys", F.when(F.col("host").isNotNull(), keys_of(F.col("url"), most_labels, most_segments)))
    # a capture's verdict depends on its day and the last of its keys alone; the other keys are openings and endings of it
    rows = rows.withColumn("place", F.when(F.col("host").isNotNull() & F.col("day").isNotNull(), F.array_join("keys", " ")))
    places = rows.where("place is not null").select("place", "day", "keys").dropDuplicates(["place", "day"])
    asked = places.select("place", "day", F.explode("keys").alias("pattern"))
    # as of each key and day, which lists have it
    moments = asked.select("pattern", "day").distinct()
    active = moments.join(held, "pattern").where("since <= day and (until is null or day < until)")
    per_key = active.groupBy("pattern", "day").agg(F.count("*").alias("n_entries"), F.collect_set("list").alias("lists"), F.min("list").alias("least"), F.expr("min_by(since, list)").alias("since"))
    verdicts = asked.join(per_key, ["pattern", "day"]).groupBy("place", "day").agg(
        F.sum("n_entries").alias("n_entries"), F.size(F.array_distinct(F.flatten(F.collect_list("lists")))).cast("long").alias("n_lists"),
        F.expr("min_by(struct(pattern, since), struct(-length(pattern), pattern))").alias("best"),
    )
    return rows.join(verdicts, ["place", "day"], "left").select(
        "id", "host", rows["day"], F.col("n_entries").isNotNull().alias("blocked"), F.coalesce("n_lists", F.lit(0).cast("long")).alias("n_lists"),
        F.coalesce("n_entries", F.lit(0).cast("long")).alias("n_entries"), F.col("best.pattern").alias("pattern"), F.col("best.since").alias("since"),
    )


def _number(text: Column, start: int, digits: int = 4) -> Column:
    """A number from hex digits of a text's MD5."""
    return F.conv(F.substring(F.md5(text), start, digits), 16, 10).cast("int")


def dated_captures(pages: DataFrame) -> DataFrame:
    """(page_id, url, day): pages with a day of fetching in 2024 that their id determines, as the table has none."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), _number(F.col("page_id").cast("string"), 1) % 366).alias("day"))


def dated_lists(pages: DataFrame) -> DataFrame:
    """(list, pattern, day, action): three dated lists made from the hosts, domains and first path segments of pages.

    The MD5 of a pattern decides on which list it is, from when, and whether and when it is removed and added again.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host is not null")
    patterns = (
        hosts.select("host").distinct().select(F.lit("hosts").alias("list"), F.col("host").alias("pattern"))
        .unionAll(hosts.select(F.lit("domains"), F.substring_index("host", ".", -3)).distinct())
        .unionAll(hosts.where("split_part(path, '/', 2) <> ''").select(F.lit("paths"), F.concat("host", F.lit("/"), F.expr("split_part(path, '/', 2)"))).distinct())
    )
    name = F.concat_ws(":", "list", "pattern")
    start, kind = _number(name, 1) % 300, _number(name, 5) % 4
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    some = patterns.where(_number(name, 9) % 3 == 0).withColumn("start", start).withColumn("kind", kind)
    return (
        some.select("list", "pattern", day(F.col("start")).alias("day"), F.lit("add").alias("action"))
        .unionAll(some.where("kind >= 1").select("list", "pattern", day(F.col("start") + 30), F.lit("remove")))
        .unionAll(some.where("kind >= 2").select("list", "pattern", day(F.col("start") + 50), F.lit("add")))
    )


ORACLE = r"""
WITH c AS (
  SELECT page_id, DATE '2024-01-01' + (('0x' || substr(md5(page_id::VARCHAR), 1, 4))::INT % 366) AS day,
    nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.+$', ''), '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
p AS (
  SELECT DISTINCT 'hosts' AS list, host AS pattern FROM c WHERE host IS NOT NULL
  UNION ALL SELECT DISTINCT 'domains', array_to_string(split(host, '.')[-3:], '.') FROM c WHERE host IS NOT NULL
  UNION ALL SELECT DISTINCT 'paths', host || '/' || split_part(path, '/', 2) FROM c WHERE host IS NOT NULL AND split_part(path, '/', 2) <> ''),
m AS (SELECT *, md5(list || ':' || pattern) AS h FROM p),
k AS (SELECT list, pattern, ('0x' || substr(h, 1, 4))::INT % 300 AS start, ('0x' || substr(h, 5, 4))::INT % 4 AS kind FROM m
  WHERE ('0x' || substr(h, 9, 4))::INT % 3 = 0),
i AS (
  SELECT list, pattern, DATE '2024-01-01' + start AS since, CASE WHEN kind >= 1 THEN DATE '2024-01-01' + (start + 30) END AS until FROM k
  UNION ALL SELECT list, pattern, DATE '2024-01-01' + (start + 50), NULL FROM k WHERE kind >= 2),
hit AS (
  SELECT c.page_id, c.day, i.list, i.pattern, i.since FROM c JOIN i
    ON c.day >= i.since AND (i.until IS NULL OR c.day < i.until)
    AND CASE WHEN contains(i.pattern, '/') THEN i.pattern = c.host || '/' || split_part(c.path, '/', 2)
      ELSE i.pattern = c.host OR suffix(c.host, '.' || i.pattern) END),
g AS (SELECT page_id, day, count(*) AS n_entries, count(DISTINCT list) AS n_lists, arg_min(pattern, (-length(pattern), pattern)) AS pattern,
    arg_min(since, (-length(pattern), pattern, list)) AS since FROM hit GROUP BY ALL)
SELECT c.page_id, c.host, c.day::VARCHAR AS day, g.n_entries IS NOT NULL AS blocked, coalesce(g.n_lists, 0)::BIGINT AS n_lists,
  coalesce(g.n_entries, 0)::BIGINT AS n_entries, g.pattern, g.since::VARCHAR AS since FROM c LEFT JOIN g USING (page_id, day)"""
