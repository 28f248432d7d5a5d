"""Operator 1: mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, cut, fresh

#: Hex digits of the sampling hash that name a bucket: 4,096 buckets of a source, whatever the table's size.
DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with a column `place`, from 0 in the given order; ranges are counted each on its own."""
    parts = cut(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    return parts.withColumn("within", within).join(sizes.select("part", before.alias("before")), "part").withColumn("place", F.col("before") + F.col("within")).drop("part", "within", "before")


def water_fill(sources: DataFrame, max_epochs: float, total: float | None = None) -> DataFrame:
    """sources (size, weight, ...) with `target`: shares of the total by weight, clamped at max_epochs times the size.

    What clamped sources leave goes to the others by weight, until none is above its cap. The total is all sizes unless
    given; where even all caps do not reach it, every source gets its cap. Sources without weight get nothing. Each
    round is one aggregate, so nothing is gathered.
    """
    cap = F.col("size") * F.lit(float(max_epochs))
    weighed = sources.where("weight > 0")
    whole, weight = weighed.agg(F.sum("size"), F.sum("weight").cast("double")).first()
    whole = float(total if total is not None else sources.agg(F.sum("size")).first()[0] or 0)
    level = whole / weight if weight else 0.0
    while weight:
        above = F.col("weight") * F.lit(level) > cap
        clamped, free = weighed.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight"))).cast("double")).first()
        if not free:
            level = float("inf")
            break
        now = (whole - (clamped or 0.0)) / free
        if now == level:
            break
        level = now
    share = F.col("weight") * F.lit(level)
    return sources.withColumn("target", F.when(F.col("weight") > 0, F.when(share > cap, cap).otherwise(share)).otherwise(0.0))


def fill(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """rows (key, bucket, h, doc, size) with `took`: a sample of each key's rows whose sizes add up to nearly its rest.

    rest: (key, bucket, lack), the same lack for all buckets of a key. A walk goes over the key's rows that are not
    taken and no larger than what it lacks, in the order of h, and takes them while their sum is within that; the next
    walk starts anew with what is left and still fits, until nothing fits: then every row not taken is larger than what
    its key lacks. What a walk has decided goes through no other. Buckets are summed first, so each finds its place in
    the walk by itself and a key of any size is sorted bucket by bucket.
    """
    within = W.partitionBy("key", "bucket").orderBy("h", "doc", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    now, decided = rows.join(rest, ["key", "bucket"]), []
    while True:
        now = cut(now)
        decided.append(now.where("size > lack").select(*rows.columns, F.lit(False).alias("took")))
        now = now.where("size <= lack")
        sums = now.groupBy("key", "bucket").agg(F.sum("size").alias("sum"))
        starts = sums.select("key", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
        upto = F.col("start") + F.sum("size").over(within)
        step = cut(now.join(starts, ["key", "bucket"]).withColumn("new", upto <= F.col("lack")).drop("start"))
        decided.append(step.where("new").select(*rows.columns, F.lit(True).alias("took")))
        if step.where("not new").isEmpty():
            return reduce(DataFrame.unionAll, decided)
        given = step.groupBy("key", "bucket").agg(F.sum(F.when(F.col("new"), F.col("size")).otherwise(0)).alias("given"))
        less = given.select("key", "bucket", F.sum("given").over(W.partitionBy("key")).alias("given"))
        now = step.where("not new").join(less, ["key", "bucket"]).withColumn("lack", F.col("lack") - F.col("given")).drop("given", "new")


def round_off(filled: DataFrame, rest: DataFrame) -> DataFrame:
    """The rows of `fill`, of each key the smallest row not taken taken as well where that brings the key nearer to its
    rest: where it is smaller than twice what is lacking. Ties go by h; of rows that repeat one is taken."""
    took = F.sum(F.when(F.col("took"), F.col("size")).otherwise(0))
    least = F.min(F.when(~F.col("took"), F.struct("size", "h", "doc", "bucket")))
    # buckets first, so that a key of many rows is small when it comes together
    sums = filled.groupBy("key", "bucket").agg(took.alias("given"), least.alias("least")).groupBy("key").agg(F.sum("given").alias("given"), F.min("least").alias("least"))
    lacks = rest.groupBy("key").agg(F.first("lack").alias("lack"))
    last = sums.join(lacks, "key").where("least.size < 2 * (lack - given)").select("key", "least.bucket", F.col("least.h").alias("at"))
    joined = cut(filled.join(last, ["key", "bucket"], "left").withColumn("last", F.coalesce(~F.col("took") & (F.col("h") == F.col("at")), F.lit(False))))
    chosen = joined.where("last").withColumn("took", F.row_number().over(W.partitionBy("key", "bucket").orderBy("size")) == 1)
    return joined.where("not last").unionAll(chosen).select(*filled.columns)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_epochs: float = 3.0, seed: int = 7) -> DataFrame:
    """(doc, size, source_size, target, copies, taken): how often the mix repeats each row of docs.

    Sources in code-point order, null last, weigh `weights` in turn. A source of target t and size s repeats all its
    rows floor(t / s) times; the rest is a sample of whole documents in the order of a seeded hash of the id (see
    `fill`): a document that is too long for what is left is passed over, and the walk goes on behind it, until no
    document fits. The smallest one left is taken too where that comes nearer, so a source misses its target by at most
    half of the smallest document that fits no more. Each source's sample hangs on its own rows alone, neither on
    the table's size nor on partitions: reruns agree.

    Null and empty texts have size 0; a null source is a source of its own; a null id is hashed like another id; rows
    that repeat an id are sampled each for itself; an empty table gives no rows. Other columns are not read. A source
    may hold any share of the rows: its sampling order is cut into buckets that are summed before they are joined.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("~"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = docs.select(F.col(id_col).alias("doc"), key.alias("key"), word_count(F.col(text_col)).alias("size"), order.alias("h"))
    rows = cut(rows.withColumn("bucket", F.expr(f"left(h, {DIGITS})")))
    buckets = cut(rows.groupBy("key", "bucket").agg(F.sum("size").alias("bucket_size")))
    sources = buckets.groupBy("key").agg(F.sum("bucket_size").alias("size"))
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    filled = cut(water_fill(cut(ranked(sources, F.col("key")).withColumn("weight", turn)), max_epochs))
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    filled = filled.select("key", F.col("size").alias("source_size"), "target", whole.alias("whole"), (F.col("target") - whole * F.col("size")).alias("lack"))
    plan = cut(buckets.select("key", "bucket").join(filled, "key"))
    out = cut(round_off(fill(rows, plan.select("key", "bucket", "lack")), plan).join(plan.drop("lack"), ["key", "bucket"]))
    copies = F.col("whole") + F.col("took").cast("long")
    return out.select("doc", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; rows taken no time go. Rows of one id share its copies."""
    copies = mix(docs, id_col=id_col, **how).groupBy("doc").agg(F.max("copies").cast("int").alias("n_copies")).where("n_copies > 0")
    doc, n, turn = (fresh(docs, c) for c in ("mix_doc", "mix_copies", "mix_turn"))
    out = docs.join(copies.select(F.col("doc").alias(doc), F.col("n_copies").alias(n)), F.col(id_col).eqNullSafe(F.col(doc)))
    return out.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(n))).alias(turn)).drop(turn)


def oracle(weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 7) -> str:
    """DuckDB SQL for the rows of `mix` over the view documents."""
    cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    walk = "PARTITION BY key ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING"
    return f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, '~') AS key,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
s AS (SELECT key, sum(size)::BIGINT AS source_size, {max_epochs}.0::DOUBLE * sum(size)::DOUBLE AS cap,
    CASE (row_number() OVER (ORDER BY key) - 1) % {len(weights)} {cases} END::DOUBLE AS weight FROM d GROUP BY key),
r AS (SELECT *, (SELECT sum(source_size)::DOUBLE FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_total,
    sum(weight) OVER (ORDER BY cap / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight,
    row_number() OVER (ORDER BY cap / weight, key) AS k FROM s),
l AS (SELECT min_by(rest_total / rest_weight, k) AS level FROM r WHERE weight * (rest_total / rest_weight) <= cap),
t AS (SELECT key, source_size, CASE WHEN weight * level > cap THEN cap ELSE weight * level END AS target FROM s, l),
t2 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
w0 AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS lack FROM d JOIN t2 USING (key)),
w AS (SELECT rid, doc_id, key, size, h, lack, FALSE AS took FROM w0 UNION ALL
  SELECT rid, doc_id, key, size, h, lack - sum(CASE WHEN new THEN size ELSE 0 END) OVER (PARTITION BY key) AS lack, new
  FROM (SELECT *, sum(size) OVER ({walk}) <= lack AS new FROM w WHERE NOT took AND size <= lack)),
f AS (SELECT *, rid IN (SELECT rid FROM w WHERE took) AS took FROM w0),
o AS (SELECT *, (whole + (took OR (row_number() OVER (PARTITION BY key, took ORDER BY size, h, rid) = 1
    AND size < 2 * (lack - sum(CASE WHEN took THEN size ELSE 0 END) OVER (PARTITION BY key))))::INT)::BIGINT AS copies FROM f)
SELECT doc_id, size, source_size, target, copies, (copies * size)::BIGINT AS taken FROM o"""
