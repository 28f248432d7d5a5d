"""Operator 3: weighted SimHash fingerprints and permuted block tables, in DataFrame operations only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import ascii_lower, cut, runs, words
from .simhash import distance, vote


def weighted_fingerprints(texts: DataFrame, by: list[str], text_col: str = "text", width: int = 3) -> DataFrame:
    """(by..., f0): the weighted SimHash of each row's text.

    Terms are runs of `width` ASCII-lower-cased words, each occurrence weighing the term's number of letters, so that
    long and therefore rare terms count more. A bit is 1 where its signed vote is above zero. Null, empty and wordless
    texts get zero. Equal texts get equal fingerprints. `by` must name each row.
    """
    # the hash of a word holds its length (255 at most) in its low byte, so that terms need no strings
    coded = F.transform(words(ascii_lower(F.col(text_col))), lambda w: F.xxhash64(w).bitwiseAND(F.lit(-256)).bitwiseOR(F.least(F.length(w), F.lit(255)).cast("long")))
    rows = texts.select(*by, coded.alias("w")).select(*by, F.explode_outer(runs(F.col("w"), width)).alias("t"))
    parts = [F.col(f"t.t{j}") for j in range(width)]
    weight = sum((F.coalesce(x.bitwiseAND(F.lit(255)), F.lit(0)) for x in parts[1:]), parts[0].bitwiseAND(F.lit(255)))
    return vote(rows.select(*by, F.when(parts[0].isNotNull(), F.xxhash64(*parts)).alias("h"), weight.alias("weight")), by, [F.col("h")], F.col("weight"))


def within_radius(prints: DataFrame, *, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(f0, class_id, size, n_links, n_near): for each distinct fingerprint of (doc, f0), what lies within the radius.

    The 64 bits are cut into `blocks` blocks. Differing bits touch at most `radius` blocks, so the other blocks agree:
    there is a table for each choice of blocks - radius blocks, which permutes the chosen blocks to the front as its
    key, and an equality join on a table's key with a check of the distance finds every pair. A pair is reported by
    the first table that holds it. class_id is the smallest doc of the fingerprint, size its docs, n_links the other
    fingerprints within the radius, n_near the other docs within it, equal ones included. Copies share one row and
    are not expanded into pairs. Null docs count but name no class.
    """
    nodes = cut(prints.groupBy("f0").agg(F.min("doc").alias("class_id"), F.count("*").alias("size")))
    edges = [64 * b // blocks for b in range(blocks + 1)]
    masks = [((1 << edges[b + 1]) - 1) ^ ((1 << edges[b]) - 1) for b in range(blocks)]
    signed = lambda m: F.lit(m if m < 1 << 63 else m - (1 << 64)).cast("long")
    tables = [sum(masks[b] for b in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    index = nodes.select(
        "f0", "size", F.posexplode(F.array(*[F.col("f0").bitwiseAND(signed(m)) for m in tables])).alias("table", "key")
    )
    other = index.select("table", "key", F.col("f0").alias("g0"), F.col("size").alias("other_size"))
    differ = F.col("f0").bitwiseXOR(F.col("g0"))
    first = F.array_position(F.transform(F.array(*[signed(m) for m in tables]), lambda m: differ.bitwiseAND(m) == 0), True) - 1
    pairs = (
        index.join(other, ["table", "key"])
        .where((F.col("f0") != F.col("g0")) & (distance([F.col("f0")], [F.col("g0")]) <= radius))
        .where(F.col("table") == first)
    )
    near = pairs.groupBy("f0").agg(F.count("*").alias("n_links"), F.sum("other_size").alias("near_size"))
    return nodes.join(near, "f0", "left").select(
        "f0", "class_id", "size", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        (F.col("size") - 1 + F.coalesce("near_size", F.lit(0))).alias("n_near"),
    )


def successors(ids: DataFrame, key: str) -> DataFrame:
    """(key, next): each distinct key with the next larger one, the largest with the smallest; keys are not null.

    Keys are dealt into ranges, each range is walked on its own, and the ranges are stitched together from one row
    each, so no task sees more than its range.
    """
    n = ids.select(F.col(key).alias("key")).distinct()
    ranged = cut(n.repartitionByRange(F.col("key")).select("key", F.spark_partition_id().alias("part")))
    ends = ranged.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    row = W.orderBy("first")
    first = F.coalesce(F.lead("first").over(row), F.min("first").over(W.partitionBy()))
    seams = ends.select(F.col("last").alias("key"), first.alias("next"))
    walk = ranged.withColumn("next", F.lead("key").over(W.partitionBy("part").orderBy("key")))
    return walk.where("next is not null").select("key", "next").unionAll(seams)


def compare_with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Operator 3: fingerprints of whole texts and of edited texts, their likeness, and what lies within the radius.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document in ascending id, the last one's next being the first. Null texts count as empty. One row for each distinct
    (id, text); rows with a null id are left out, having no place in the order. Where an id has several texts, the
    smallest text is the one its predecessor sees. Likeness is the share of equal bits. Other columns are not read.
    """
    # ids and lengths first, so that whole texts are moved once and only the borrowed openings a second time
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    needs = base.groupBy("doc").agg(F.max(F.floor(F.length("text") / 4)).cast("int").alias("need"))
    order = successors(base.select("doc"), "doc")
    asks = cut(order.join(needs, order["key"] == needs["doc"]).select(F.col("next").alias("doc"), F.col("key").alias("owner"), "need"))
    lent = base.join(asks, "doc").select("owner", "doc", F.expr("left(text, need)").alias("opening"))
    lent = lent.groupBy("owner", "doc").agg(F.min("opening").alias("opening"))
    n, cutoff = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    both = base.join(lent.select(F.col("owner").alias("doc"), F.col("doc").alias("next"), "opening"), "doc").select(
        "doc", "next", "text", n.cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), n - cutoff), F.substring(F.col("opening"), F.lit(1), cutoff)).alias("edited"),
    )
    sha = F.sha2(F.encode("edited", "UTF-8"), 256)
    shown = both.select("doc", "next", "n_chars", sha.alias("edited_sha256"), F.xxhash64("text").alias("text_hash"), F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")),
    )).alias("t")).select("doc", "next", "n_chars", "edited_sha256", "text_hash", "t.kind", "t.text")
    by = ["doc", "next", "n_chars", "edited_sha256", "text_hash", "kind"]
    got = weighted_fingerprints(shown, by, width=width)
    pair = got.groupBy(*by[:-1]).agg(
        F.max(F.when(F.col("kind") == 0, F.col("f0"))).alias("f0"), F.max(F.when(F.col("kind") == 1, F.col("f0"))).alias("e0")
    )
    own = cut(pair)
    ahead = own.groupBy("doc").agg(F.min(F.struct("text_hash", "f0")).alias("x")).select(F.col("doc").alias("next"), F.col("x.f0").alias("n0"))
    near = within_radius(own.select("doc", "f0"), radius=radius, blocks=blocks)
    like = lambda a, b: F.lit(1.0) - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64.0)
    return own.join(ahead, "next").join(near, "f0").select(
        "doc", "n_chars", "edited_sha256", "f0", "e0", like("f0", "e0").alias("near_edited"), like("f0", "n0").alias("near_next"),
        "class_id", "n_links", "n_near",
    )
