"""Operators 2 and 3: SimHash fingerprints, near-duplicate classes by deletion variants, search by permuted block tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, components, cut, runs, words

#: A lane of 32 bits for bit i and one for bit i + 32, summed at once.
LANES = 0x0000000100000001


def hex16(bits: Column) -> Column:
    """A 64-bit word as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def distance(a: list[Column], b: list[Column]) -> Column:
    """Differing bits of two fingerprints given as 64-bit words."""
    out = F.bit_count(a[0].bitwiseXOR(b[0]))
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + F.bit_count(x.bitwiseXOR(y))
    return out


def vote(rows: DataFrame, by: list[str], hashes: list[Column], weight: Column | None = None) -> DataFrame:
    """Majority votes of term hashes: one row for each `by`, with 64-bit words f0, f1, ... of the fingerprint.

    rows has one row for each term; null hashes do not vote. A bit is 1 where it is set in more than half the weight.
    Each sum carries two bits, so 32 sums make a word. Weights of one key must stay below 2**31 in total.
    """
    sums = []
    for j, h in enumerate(hashes):
        for i in range(32):
            bits = F.shiftrightunsigned(h, i).bitwiseAND(F.lit(LANES))
            sums.append(F.sum(bits if weight is None else bits * weight).alias(f"s{j}_{i}"))
    total = F.sum(F.when(hashes[0].isNotNull(), F.lit(1) if weight is None else weight)).alias("total")
    got = rows.groupBy(*by).agg(total, *sums)

    def word(j: int) -> Column:
        out = F.lit(0).cast("long")
        for i in range(32):
            low, high = F.col(f"s{j}_{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"s{j}_{i}"), 32)
            for count, at in ((low, i), (high, i + 32)):
                out = out.bitwiseOR(F.when(count * 2 > F.col("total"), F.lit(1 << at if at < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long"))
        return F.coalesce(out, F.lit(0).cast("long")).alias(f"f{j}")

    return got.select(*by, *[word(j) for j in range(len(hashes))])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, n_words: int = 1) -> DataFrame:
    """(row, doc, f0, ...): a fingerprint of 64 * n_words bits for every row of docs.

    The first word takes the XXH64 (seed 42) of each shingle of the ASCII-lower-cased words, further words take hashes
    of that hash. Null and empty texts, and texts without words, get zero. Rows with the same id keep a row each.
    """
    text = F.col("text")
    rows = (
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
        .select("row", "doc", words(ascii_lower(text)).alias("w"))
        .select("row", "doc", F.explode_outer(runs(F.col("w"), width)).alias("t"))
        .select("row", "doc", F.when(F.col("t").isNotNull(), F.xxhash64(F.concat_ws(" ", *[F.col(f"t.t{j}") for j in range(width)]))).alias("h"))
    )
    h = F.col("h")
    return vote(rows, ["row", "doc"], [h, *[F.when(h.isNotNull(), F.xxhash64(h, F.lit(j))) for j in range(1, n_words)]])


def bucket_hits(nodes: DataFrame, names: list[str], *, segments: int, bits: int) -> DataFrame:
    """(key, rep, head, n): members of the buckets of more than one node (rep, f0, ...), with the smallest of the bucket.

    A bucket holds the fingerprints that are equal in a segment without one of its bits.
    """
    width = bits // segments
    cuts = []
    for s in range(segments):
        word, off = divmod(s * width, 64)
        own = F.shiftrightunsigned(F.col(names[word]), off)
        if off + width > 64:
            own = own.bitwiseOR(F.shiftleft(F.col(names[word + 1]), 64 - off))
        cuts.append(F.struct(F.lit(s).alias("s"), own.bitwiseAND(F.lit((1 << width) - 1)).alias("own")))
    spread = nodes.where(F.col("rep").isNotNull()).repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rep")
    places = spread.select("rep", F.explode(F.array(*cuts)).alias("c")).select("rep", "c.s", "c.own", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("p"))
    # the segment without bit p, and the place of that bit; for short segments both fit 31 bits, which halves what is shuffled
    kind = "int" if width - 1 + (segments * width - 1).bit_length() <= 31 else "bigint"
    less = f"(own & (shiftleft(1L, p) - 1)) | shiftleft(shiftrightunsigned(own, p + 1), p) | shiftleft(cast(s * {width} + p as bigint), {width - 1})"
    index = places.select("rep", F.expr(less).cast(kind).alias("key"))
    heads = index.groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("n")).where("n > 1")
    return index.join(heads, "key").where(F.col("rep") != F.col("head"))


def judged(pairs: DataFrame, nodes: DataFrame, names: list[str], radius: int) -> DataFrame:
    """pairs (a, b), once each, with whether they are within the radius."""
    print_of = lambda end, to: nodes.select(F.col("rep").alias(end), *[F.col(n).alias(f"{to}{n}") for n in names])
    both = pairs.distinct().join(print_of("a", "x"), "a").join(print_of("b", "y"), "b")
    return both.select("a", "b", (distance([F.col(f"x{n}") for n in names], [F.col(f"y{n}") for n in names]) <= radius).alias("near"))


def near_classes(prints: DataFrame, *, radius: int, segments: int, bits: int) -> DataFrame:
    """(f0, ..., rep, component, size): classes of fingerprints that links of at most `radius` differing bits connect.

    prints: (doc, f0, ...). Equal fingerprints are one node, named by its smallest doc. A radius of 2 on one word links
    nodes by the points they have in common (common_points), at most 65 of them at a point, so neither rows nor groups
    grow with a crowd. Otherwise each fingerprint is cut into `segments` segments; for each bit of a segment it is
    indexed under the segment without that bit. Two fingerprints share such a key exactly if some segment of theirs
    differs by at most one bit: always at 2 * segments - 1 or fewer differing bits, so the result is exact for a radius
    up to that; for larger ones it finds what shares a key. In each bucket all are compared with the smallest one; the
    near ones reach each other through it, and those too far from it are compared with all others of the bucket, so no
    link between members of a bucket that matters is left out. Buckets are joined, never gathered.
    """
    names = [c for c in prints.columns if c.startswith("f") and c[1:].isdigit()]
    nodes = cut(prints.groupBy(*names).agg(F.min("doc").alias("rep"), F.count("*").alias("size")))
    if len(names) == 1 and radius == 2:
        edges = common_points(nodes.where(F.col("rep").isNotNull()), names[0])
    else:
        edges = bucket_links(nodes, names, radius=radius, segments=segments, bits=bits)
    found = components(edges)
    return nodes.join(found, nodes["rep"] == found["node"], "left").select(*names, "rep", "size", F.coalesce("component", "rep").alias("component"))


def bucket_links(nodes: DataFrame, names: list[str], *, radius: int, segments: int, bits: int) -> DataFrame:
    """(a, b): links within the radius that connect what the buckets of near_classes bring together."""
    hits = cut(bucket_hits(nodes, names, segments=segments, bits=bits))
    first = cut(judged(hits.select(F.col("rep").alias("a"), F.col("head").alias("b")), nodes, names, radius))
    far = hits.where("n > 2").join(first.where("not near").select(F.col("a").alias("rep"), F.col("b").alias("head")), ["rep", "head"]).select("key", F.col("rep").alias("b"))
    again = judged(hits.where("n > 2").select("key", F.col("rep").alias("a")).join(far, "key").where("a <> b").select("a", "b"), nodes, names, radius).where("near")
    return first.where("near").select("a", "b").unionAll(again.select("a", "b"))


def common_points(members: DataFrame, word: str) -> DataFrame:
    """(a, b): links that connect all members (rep, word) at two or fewer differing bits, and none at more.

    Two words differ in at most two bits exactly if some word differs from both in at most one. Each member names itself
    and its 64 neighbours; who names the same point is linked to the smallest of them, so a crowd makes no pairs.
    """
    # one exchange serves the smallest and the join
    points = members.select("rep", word, F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i")).select("rep", F.expr(f"{word} ^ if(i < 64, shiftleft(1L, i), 0L)").alias("point")).repartition("point")
    least = points.groupBy("point").agg(F.min("rep").alias("b"), F.count("*").alias("n")).where("n > 1").select("point", "b")
    return points.join(least, "point").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()


def dedup_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, n_words: int = 1, radius: int = 2, segments: int = 2) -> DataFrame:
    """Operator 2. (doc, fingerprint words, component): every row of docs with the smallest id of its near-duplicate class.

    Null and empty texts have fingerprint zero and link like others. Null ids stay alone with a null component unless
    an equal fingerprint has an id. Repeated rows stay. Other columns of docs are not read.
    """
    prints = cut(fingerprints(docs, id_col=id_col, text_col=text_col, width=width, n_words=n_words))
    names = [f"f{j}" for j in range(n_words)]
    classes = near_classes(prints, radius=radius, segments=segments, bits=64 * n_words)
    return prints.select("row", "doc", *names).join(classes.select(*names, "component", "size"), names, "left")
