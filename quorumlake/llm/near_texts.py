"""Operator 2 on whole texts: near copies by their word shingles, found through deletion variants of SimHash segments.

A signature is a few segments. Each is a SimHash of its own over the same distinct shingles: every shingle votes on the
segment's bits with a weight that falls off steeply in a seeded hash of the shingle, so a segment hangs on few shingles
and two texts that share most of them agree in the segment, or differ in one bit, about as often as they are alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, components, fresh, kept, let_go, words

#: Votes of a segment come from about so many shingles of a text, those of the largest weights; the rest together
#: would weigh too little to turn a bit.
VOTERS = 32
#: Bits of a segment above log2 of the table's rows: so many more keys than rows that chance meetings stay rare.
MARGIN = 11
#: Parts of a segment's bits, all but one of which rows are dealt by.
PARTS = 4
#: Shingles that are hashed and voted on at once, which bounds a worker's memory; a longer text is a batch of its own.
BATCH = 100_000
#: Of the shingles that like texts share, one in so many shows in the leads of both.
LEAD = 8
#: Texts that share a shingle and are still paired one by one; more are compared in blocks.
FEW = 32
#: Shingles of a block of texts, each of which counts as BASE more; two blocks are compared in one task.
BLOCK, BASE = 131_072, 128


@dataclass(frozen=True)
class Signing:
    """How texts are signed: words of a shingle, segments and their bits, and how steeply weights fall off."""

    width: int
    segments: int
    bits: int
    steep: float


def _mixed(h):
    """A bijective mix of unsigned 64-bit numbers in which every bit of the input reaches every bit of the output."""
    import numpy as np

    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def by_owner(owner, h):
    """The order by owner and hash; owners are below 65,536, so that the second sort goes by digits."""
    import numpy as np

    first = np.argsort(h)
    return first[np.argsort(owner[first].astype("u2"), kind="stable")]


def shingle_hashes(texts: list[str | None], width: int):
    """(owner, hash): the distinct shingles of each text, ascending by owner and hash; owner is the place in the list.

    A shingle is `width` successive ASCII-lower-cased words, or all words of a text that has fewer; a text without
    words has none. Hashes are 64 bits of the words' XXH64 values, in order.
    """
    import numpy as np
    import xxhash

    cut_up = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    # each distinct word of these texts once; nothing is held from call to call, as workers outlive their tasks
    known = {w: xxhash.xxh64_digest(w, 42) for w in set().union(*cut_up)}
    sizes = np.array([len(w) for w in cut_up], dtype="int64")
    flat = np.frombuffer(b"".join([b"".join(map(known.__getitem__, w)) for w in cut_up]), "<u8")
    # words behind the end of a short text count as zero
    ends, owner = np.cumsum(sizes), np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(flat))
    h = _mixed(flat)
    for j in range(1, width):
        ahead = np.append(flat[j:], np.zeros(min(j, len(flat)), "u8"))
        h = _mixed(h ^ np.where(left > j, ahead, np.uint64(0))) + np.uint64(j)
    first = np.arange(len(flat)) == np.repeat(ends - sizes, sizes)
    use = (left >= width) | first & (np.repeat(sizes, sizes) < width)
    owner, h = owner[use], h[use]
    order = by_owner(owner, h)
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return owner[new], h[new]


def segments_of(owner, h, n: int, how: Signing, level: int = 0):
    """The signatures of n shingle sets (owner, hash, ascending): an array of n by how.segments numbers of how.bits bits.

    Segments of different levels have weights and signs of their own. Sets without shingles get zeros.
    """
    import numpy as np

    out = np.zeros((n, how.segments), "int64")
    if not len(owner):
        return out
    limit = VOTERS / np.bincount(owner, minlength=n)[owner]
    powers = np.int64(1) << np.arange(how.bits, dtype="int64")
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    counts = np.diff(np.r_[starts, len(owner)])
    for s in range(how.segments):
        g = _mixed(h + np.uint64(0x9E3779B97F4A7C15 * (level * how.segments + s + 1) & (1 << 64) - 1))
        u = ((g >> np.uint64(11)).astype("float64") + 1) / float(1 << 53)
        # the heaviest shingle of each set always votes
        votes = (u <= limit) | (u == np.repeat(np.minimum.reduceat(u, starts), counts))
        who, weight = owner[votes], u[votes] ** -how.steep
        signs = np.unpackbits(_mixed(g[votes] ^ np.uint64(0x5851F42D4C957F2D)).view("u1").reshape(-1, 8), axis=1, bitorder="little")[:, : how.bits]
        at = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        sums = np.add.reduceat((signs - 0.5) * weight[:, None], at, axis=0)
        out[who[at], s] = (sums > 0) @ powers
    return out


def batches_of(*columns) -> Iterator[tuple[int, int]]:
    """Ranges of rows of Arrow columns of texts or sets that hold about BATCH words, of six bytes, and 30,000 rows at most."""
    import pyarrow.compute as pc

    sizes = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype("int64") // 6 + 1 for c in columns)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        total += size
        if total >= BATCH or i - start == 29_999:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def least_common(n, likeness: float):
    """How many shingles a set of n shares at least with any set of that Jaccard similarity; for arrays and columns.

    Their union has n or more. What rounding may take is left off, as fewer only means more candidates.
    """
    import numpy as np

    if isinstance(n, Column):
        return F.greatest(F.ceil(n * likeness - 1e-6), F.lit(1)).cast("int")
    return np.maximum(np.ceil(n * likeness - 1e-6), 1).astype("int64")


def signatures(texts: DataFrame, how: Signing, likeness: float) -> DataFrame:
    """(id, node, n, own, lead) of each row of texts (id, node, text): the distinct shingles, by 32 bits of their hashes,
    the signature's segments, and the smallest hashes, of which those that `suspects` asks for are shared by like sets."""
    form = T.StructType([texts.schema["id"], *T.StructType.fromDDL("node bigint, n int, own array<bigint>, lead array<int>").fields])

    def sign(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        let_go()
        for batch in batches:
            for a, b in batches_of(batch.column(2)):
                owner, h = shingle_hashes(batch.column(2).slice(a, b - a).to_pylist(), how.width)
                own = segments_of(owner, h, b - a, how)
                lists = pa.ListArray.from_arrays(np.arange(0, own.size + 1, how.segments, dtype="int32"), own.ravel())
                # ascending by owner and hash, so the upper halves are as well
                one = owner.astype("u8") << np.uint64(32) | h >> np.uint64(32)
                new = np.append(True, one[1:] != one[:-1])[: len(one)]
                who, small = owner[new], (h[new] >> np.uint64(32)).astype("<u4").view("<i4")
                n = np.bincount(who, minlength=b - a)
                common = least_common(n, likeness)
                many = np.where(n > 0, n - common + 1 + common // LEAD, 0)
                first = np.arange(len(who)) - (np.cumsum(n) - n)[who] < many[who]
                leads = pa.ListArray.from_arrays(np.append(0, np.cumsum(many)).astype("int32"), small[first])
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:2]), pa.array(n, pa.int32()), lists, leads], names=[f.name for f in form])

    return texts.select("id", "node", "text").mapInArrow(sign, form)


def _of_classes(rows: DataFrame, *by: str) -> DataFrame:
    """The rows of groups that have several classes c. A window, so that rows go through one exchange and not through one
    for the groups and one to be joined with them."""
    group = W.partitionBy(*by)
    return rows.withColumns({"least_c": F.min("c").over(group), "most_c": F.max("c").over(group)}).where("least_c < most_c").drop("least_c", "most_c")


def meetings(rows: DataFrame, how: Signing, *among: str) -> DataFrame:
    """(a, b, s, ...): each node a with the head b of the buckets they share, once for each place s of the signature.

    rows: (node, c, x, own, ...); c is the node's class so far, and buckets of one class are left out. A bucket holds the
    rows that agree in a segment with one of its bits left out (and in the columns `among`), so two nodes share a bucket
    exactly if some segment of theirs differs in at most one bit. Its head has the smallest x, ties by node.

    A segment's bits are in PARTS parts. All of a bucket agree in the parts that its bit is not in, so rows are dealt by
    all parts but one, a row for each, and the bits are left out where they lie: what is dealt does not grow with the
    bits, and rows that meet none of another class in those parts are left out before.
    """
    parts = min(PARTS, how.bits)
    starts = [k * how.bits // parts for k in range(parts + 1)]
    places = rows.select("node", "c", "x", *among, F.posexplode("own").alias("s", "own")).where("own is not null").select("node", "c", "x", *among, "s", "own", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    low, high = (F.element_at(F.array(*map(F.lit, ends)), F.col("part") + 1) for ends in (starts[:-1], starts[1:]))
    rest = F.expr("shiftleft(1L, high) - shiftleft(1L, low)").alias("mask")
    places = places.withColumns({"low": low, "high": high}).select("*", rest)
    # what is dealt is no wider than it must be: the place is read from the slot, the bits of the part are few
    slot = F.expr(f"shiftleft(cast(s * {parts} + part as bigint), {how.bits}) | (own & ~mask)").alias("slot")
    index = places.select("node", "c", "x", *among, slot, F.expr("shiftright(own & mask, low)").alias("rest"))
    met = _of_classes(index, *among, "slot").select("node", "c", "x", *among, "slot", "rest")
    part = F.pmod(F.shiftright("slot", how.bits), F.lit(parts)).cast("int")
    width = F.element_at(F.array(*[F.lit(j - i) for i, j in zip(starts[:-1], starts[1:], strict=True)]), part + 1)
    buckets = met.select("*", F.explode(F.sequence(F.lit(0), width - 1)).alias("p")).withColumn("rest", F.expr("rest & ~shiftleft(1L, p)"))
    one = F.min(F.struct("x", "node")).over(W.partitionBy(*among, "slot", "p", "rest"))
    heads = _of_classes(buckets.withColumn("one", one), *among, "slot", "p", "rest")
    s = F.floor(F.shiftright("slot", how.bits) / parts).cast("int").alias("s")
    return heads.select(F.col("node").alias("a"), F.col("one.node").alias("b"), s).where("a <> b").distinct()


def hash_sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, hashes): the distinct shingles of each row of texts (node, text) as ascending unsigned 32-bit numbers."""

    def hashed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        let_go()
        for batch in batches:
            for lo, hi in batches_of(batch.column(1)):
                owner, h = shingle_hashes(batch.column(1).slice(lo, hi - lo).to_pylist(), width)
                # owner and 32 bits of the hash in one number
                one = np.unique(owner.astype("u8") << np.uint64(32) | h >> np.uint64(32))
                ends = np.searchsorted(one, np.arange(hi - lo + 1, dtype="u8") << np.uint64(32))
                flat = one.astype("<u4")
                sets = [flat[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], names=["node", "hashes"])

    return texts.select("node", "text").mapInArrow(hashed, "node bigint, hashes binary")


def tagged(column):
    """(sizes, tagged) of an Arrow column of sets: the size of each, and all their hashes below the place of their row."""
    import numpy as np

    sets = [np.frombuffer(x, "<u4") for x in column.to_pylist()]
    sizes = np.array([len(x) for x in sets], "int64")
    return sizes, np.repeat(np.arange(len(sets), dtype="u8"), sizes) << np.uint64(32) | np.concatenate([*sets, np.zeros(0, "<u4")]).astype("u8")


def judged(pairs: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """pairs (a, b, ...) of nodes of sets (node, hashes), with near: their Jaccard similarity is at least `likeness`."""

    def compare(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        let_go()
        for batch in batches:
            for lo, hi in batches_of(*batch.columns[-2:]):
                n = hi - lo
                (p, x), (q, y) = (tagged(c.slice(lo, n)) for c in batch.columns[-2:])
                # ascending in themselves, so a pair's hash comes twice in a row if both sets hold it
                z = np.sort(np.concatenate([x, y]), kind="stable")
                both = np.bincount((z[1:][z[1:] == z[:-1]] >> np.uint64(32)).astype("int64"), minlength=n)
                union = p + q - both
                near = pa.array((both >= likeness * union - 1e-9) & (union > 0))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, n) for c in batch.columns[:-2]), near], names=[*batch.schema.names[:-2], "near"])

    x, y = (sets.select(F.col("node").alias(e), F.col("hashes").alias(t)) for e, t in (("a", "x"), ("b", "y")))
    rows = pairs.join(x, "a").join(y, "b").select(*pairs.columns, "x", "y")
    return rows.mapInArrow(compare, T.StructType([*pairs.schema.fields, T.StructField("near", T.BooleanType())]))


def references(crowds: DataFrame, sets: DataFrame, few: int = 15) -> DataFrame:
    """(head, ref) of crowds (head, node): the hashes that more than half of a few members hold, those of the smallest
    hashed ids. Any set would do for a reference; one that most members are like makes what a member lacks of it short."""

    def vote(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        let_go()
        for batch in batches:
            out = []
            for group in batch.column(1).to_pylist():
                held, n = np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in group]), return_counts=True)
                out.append(held[2 * n > len(group)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["head", "ref"])

    chosen = crowds.withColumn("at", F.row_number().over(W.partitionBy("head").orderBy(F.xxhash64("node"), "node"))).where(F.col("at") <= few)
    return chosen.join(sets, "node").groupBy("head").agg(F.collect_list("hashes").alias("sets")).mapInArrow(vote, "head bigint, ref binary")


def placed(crowds: DataFrame, sets: DataFrame, how: Signing, level: int) -> DataFrame:
    """(head, node, c, x, own) of crowds (head, node, c): how far each member is from its crowd's reference, and where.

    x counts the hashes that one of the two has and the other has not. own is a signature of what the member lacks of
    the reference, in 2 * how.segments places, given where it adds at most a third of its own, then one of what it adds
    in how.segments places, given where that is at least a fifth; segments that are not given are null. Copies edited
    in the same places lack the same; texts that share a passage and go on in their own ways add what they are.
    """

    def place(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        let_go()
        low = np.uint64((1 << 32) - 1)
        for batch in batches:
            for lo, hi in batches_of(*batch.columns[-2:]):
                n = hi - lo
                (size, own), (_, ref) = (tagged(c.slice(lo, n)) for c in batch.columns[-2:])
                lacks, adds = np.setdiff1d(ref, own, assume_unique=True), np.setdiff1d(own, ref, assume_unique=True)
                some, many = ((v >> np.uint64(32)).astype("int64") for v in (lacks, adds))
                lack, add = np.bincount(some, minlength=n), np.bincount(many, minlength=n)
                # 32 bits are spread over 64 before they are weighed
                parts = [segments_of(who, _mixed((v & low) + np.uint64(1)), n, how, at) for who, v, at in ((some, lacks, level), (some, lacks, level + 1), (many, adds, level + 2))]
                values, use = np.hstack(parts), np.zeros((n, 3 * how.segments), bool)
                use[:, : 2 * how.segments] = ((lack > 0) & (3 * add <= size))[:, None]
                use[:, 2 * how.segments :] = ((add > 0) & (5 * add >= size))[:, None]
                lists = pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype="int32"), pa.array(values.ravel(), mask=~use.ravel()))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, n) for c in batch.columns[:3]), pa.array(lack + add, pa.int64()), lists], names=["head", "node", "c", "x", "own"])

    rows = crowds.join(references(crowds, sets), "head").join(sets, "node").select("head", "node", "c", "hashes", "ref")
    return rows.mapInArrow(place, "head bigint, node bigint, c bigint, x bigint, own array<bigint>")


def suspects(nodes: DataFrame, likeness: float) -> DataFrame:
    """(node) of nodes (node, c, n, lead) that may be like one of another class, as far as leads tell; none is missed.

    Of the m shingles that two like sets share, the j-th smallest has at most n - m shingles of either set before it
    that are not shared. So the smallest of them, one in LEAD of what the smaller set must share, are in both leads.
    """
    index = nodes.select("node", "c", F.explode("lead").alias("token"))
    hits = _of_classes(index, "token").groupBy("node").agg(F.count("*").alias("hits"))
    least = least_common(least_common(F.col("n"), likeness), likeness)
    return nodes.select("node", "n").join(hits, "node").where(F.col("hits") >= 1 + F.floor(least / LEAD)).select("node")


def prefixes(sets: DataFrame, likeness: float) -> DataFrame:
    """(token, node, c, n, m) of sets (node, c, hashes): shingles of which like sets of two classes have one in common.

    Those of a single class come first, then those of few sets, then small hashes; of n shingles, like sets share one of
    the first n - least_common + 1. Shingles of a single class join none, and a set with too few others has no row. m
    sets have the token.
    """

    def spread(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        let_go()
        for batch in batches:
            for lo, hi in batches_of(batch.column(2)):
                sizes, all_of = tagged(batch.column(2).slice(lo, hi - lo))
                at = np.repeat(np.arange(hi - lo), sizes)
                token = pa.array(all_of.astype("<u4").view("<i4"))
                yield pa.RecordBatch.from_arrays([token, *(c.slice(lo, hi - lo).take(pa.array(at)) for c in batch.columns[:2]), pa.array(sizes[at], pa.int32())], names=["token", "node", "c", "n"])

    index = sets.select("node", "c", "hashes").mapInArrow(spread, "token int, node bigint, c bigint, n int")
    met = _of_classes(index.withColumn("m", F.count("*").over(W.partitionBy("token"))), "token")
    shared = met.groupBy("node", "c", "n").agg(F.sort_array(F.collect_list(F.struct("m", "token"))).alias("tokens"))
    rest = F.size("tokens") - least_common(F.col("n"), likeness) + 1
    return shared.where(rest > 0).select("node", "c", "n", F.explode(F.slice("tokens", F.lit(1), rest)).alias("t")).select("t.token", "node", "c", "n", "t.m")


def blocked(crowds: DataFrame) -> DataFrame:
    """(crowd, block, node, c, n) of crowds (crowd, node, c, n): blocks of about BLOCK shingles, by hashes.

    A class that fills a block has blocks of its own, whose number shows it: they are not compared with each other.
    """
    load = F.sum(F.col("n") + BASE)
    classes = crowds.groupBy("crowd", "c").agg(load.alias("load"))
    small = classes.where(F.col("load") < BLOCK).groupBy("crowd").agg(F.sum("load").alias("all"))
    whole = classes.join(small, "crowd", "left").select("crowd", "c", F.when(F.col("load") >= BLOCK, F.col("load")).alias("load"), F.ceil(F.col("all") / BLOCK).alias("parts"))
    own = F.struct(F.col("c").alias("only"), F.pmod(F.xxhash64("node"), F.ceil(F.col("load") / BLOCK)).alias("part"))
    mixed = F.struct(F.lit(None).cast("bigint").alias("only"), F.pmod(F.xxhash64("c"), F.col("parts")).alias("part"))
    return crowds.join(whole, ["crowd", "c"]).select("crowd", F.when(F.col("load").isNotNull(), own).otherwise(mixed).alias("block"), "node", "c", "n")


def links_of_blocks(crowds: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """(a, b): links that join all classes with like members in one crowd, of crowds (crowd, node, c, n).

    Every two blocks of a crowd are compared, and each with itself, but for blocks of one class and blocks whose sizes
    are too far apart. What a task holds is two blocks and the table of their pairs, whatever the size of the crowd.
    """

    def compare(rows):
        import numpy as np
        import pyarrow as pa

        let_go()
        left = rows.column("left").to_numpy(zero_copy_only=False).astype(bool)
        node, c = (rows.column(e).to_numpy() for e in ("node", "c"))
        size, all_of = tagged(rows.column("hashes"))
        at, token = (all_of >> np.uint64(32)).astype("int64"), all_of.astype("u4")
        p, q = np.flatnonzero(left), np.flatnonzero(~left)
        if not len(q):
            q = p  # a block and itself
        place, both = np.zeros(len(node), "int64"), np.zeros((len(p), len(q)), "f4")
        place[p], place[q] = np.arange(len(p)), np.arange(len(q))
        of_p = left[at]
        of_q = of_p if q is p else ~of_p
        vocabulary = np.intersect1d(token[of_p], token[of_q])
        number = np.searchsorted(vocabulary, token)
        known = number < len(vocabulary)
        known[known] = vocabulary[number[known]] == token[known]
        sides = []
        for use in (of_p & known, of_q & known):
            order = np.argsort(number[use], kind="stable")
            sides.append((place[at[use]][order], number[use][order]))
        step = 4096
        for start in range(0, len(vocabulary), step):
            tables = []
            for (who, what), n in zip(sides, (len(p), len(q)), strict=True):
                i, j = np.searchsorted(what, [start, start + step])
                one = np.zeros((n, step), "f4")
                one[who[i:j], what[i:j] - start] = 1
                tables.append(one)
            both += tables[0] @ tables[1].T
        x, y = np.nonzero((both > 0) & (both >= likeness * (size[p][:, None] + size[q][None, :] - both.astype("f8")) - 1e-9) & (c[p][:, None] != c[q][None, :]))
        # of the links so many as join the same classes
        a, b = node[p[x]], node[q[y]]
        u, v = np.unique(np.concatenate([c[p[x]], c[q[y]]]), return_inverse=True)[1].reshape(2, -1)
        root = np.arange(max(u.max(initial=-1), v.max(initial=-1)) + 1)
        take = []
        while True:
            i, j = root[u], root[v]
            apart = np.flatnonzero(i != j)
            if not len(apart):
                break
            high, low = np.maximum(i, j)[apart], np.minimum(i, j)[apart]
            tops, first = np.unique(high, return_index=True)
            take.append(apart[first])
            root[tops] = low[first]
            while (root[root] != root).any():
                root = root[root]
        chosen = np.concatenate([*take, np.zeros(0, "int64")])
        return pa.table({"a": pa.array(a[chosen], pa.int64()), "b": pa.array(b[chosen], pa.int64())})

    rows = kept(blocked(crowds), "blocks")
    blocks = rows.groupBy("crowd", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    x, y = (blocks.select("crowd", F.col("block").alias(e), F.col("low").alias(f"{e}_low"), F.col("high").alias(f"{e}_high")) for e in "xy")
    apart = (F.col("x.only") == F.col("y.only")) & F.col("x.only").isNotNull()
    close = (F.col("x_high") >= likeness * F.col("y_low") - 1e-6) & (F.col("y_high") >= likeness * F.col("x_low") - 1e-6)
    pairs = x.join(y, "crowd").where((F.col("x") <= F.col("y")) & ~F.coalesce(apart, F.lit(False)) & close).select("crowd", "x", "y")
    sides = pairs.select("crowd", "x", "y", F.col("x").alias("block"), F.lit(True).alias("left")).unionAll(pairs.where("x <> y").select("crowd", "x", "y", "y", F.lit(False)))
    full = sides.join(rows, ["crowd", "block"]).join(sets.select("node", "hashes"), "node")
    return full.select("crowd", "x", "y", "left", "node", "c", "hashes").groupBy("crowd", "x", "y").applyInArrow(compare, "a bigint, b bigint")


def missed_links(nodes: DataFrame, texts: DataFrame, width: int, likeness: float) -> DataFrame:
    """(a, b): links that join all classes c of nodes (node, id, c, n, lead) with members that are like one another.

    Exact: every pair of two classes is compared that may be as like as that by shared shingles. Sets that share one with
    few others are paired; those that share one with many are crowds, which are compared in blocks.
    """
    asked = kept(nodes.join(suspects(nodes.where("n > 0"), likeness), "node").select("id", "node", "c"), "suspects")
    found = texts.join(asked.select("id", "node"), ["id", "node"], "left_semi").dropDuplicates(["id", "node"])
    sets = kept(hash_sets(found, width).join(asked.select("node", "c"), "node"), "suspect_sets")
    index = kept(prefixes(sets, likeness), "prefixes")
    few = index.where(F.col("m") <= FEW)
    x, y = (few.select("token", F.col("node").alias(e), F.col("c").alias(f"{e}_c"), F.col("n").alias(f"{e}_n")) for e in "ab")
    close = F.least("a_n", "b_n") >= likeness * F.greatest("a_n", "b_n") - 1e-6
    pairs = x.join(y, "token").where((F.col("a") < F.col("b")) & (F.col("a_c") != F.col("b_c")) & close).select("a", "b").distinct()
    near = judged(pairs, sets.select("node", "hashes"), likeness).where("near").select("a", "b")
    many = index.where(F.col("m") > FEW)
    if many.isEmpty():
        return near
    one = many.groupBy("token").agg(F.min("node").alias("b"))
    crowd = components(many.join(one.hint("merge"), "token").select(F.col("node").alias("a"), "b").where("a <> b").distinct())
    crowds = many.select("node", "c", "n").distinct().join(crowd.withColumnRenamed("component", "crowd"), "node")
    return near.unionAll(links_of_blocks(crowds, sets, likeness))


def text_classes(texts: DataFrame, *, width: int = 5, likeness: float = 0.8, segments: int = 6, steep: float = 1.5, levels: int = 3, heads: int = 16, bits: int | None = None) -> DataFrame:
    """(node, id, component): all nodes of texts (id, node, text), their smallest id, and their class if they have links.

    Rows of one node must hold the same words, ids not be null. component is the smallest node of the class, or null.
    Linked are pairs that meet and whose sets of distinct shingles have a Jaccard similarity of at least `likeness`;
    shingles are compared by 32 bits of their hashes, which changes a similarity by less than n / 2^32 for n shingles.
    A pair at 0.8 agrees in a segment, but for a bit, with a chance of 0.6, so one of six segments finds it with 0.995,
    and closer pairs more surely; wherever in the texts the edits lie does not matter.

    In each bucket all are compared with one head. Those who met a head and are not all of one class are a crowd. It
    gets a reference, the shingles that most of its members hold, and two kinds of next heads: the `heads` members
    nearest to the reference for the whole crowd, and the nearest one in each bucket of a signature of what members
    lack of the reference or add to it. Those who met by what they add may be a crowd again, `levels` levels in all. So
    a crowd makes a bounded number of pairs for each member, never all its pairs, and a passage that very many texts
    share brings them together once. These links are found by chance. Of classes they leave apart, all pairs that can be
    linked by what they share are compared (`missed_links`), so that the classes are exact.

    The segments' width follows the logarithm of the table's rows, so chance meetings grow with the rows and no faster.
    """
    if bits is None:
        bits = min(52, max(20, texts.count().bit_length() + MARGIN))
    how = Signing(width, segments, bits, steep)
    signed = signatures(texts, how, likeness)
    nodes = kept(signed.groupBy("node").agg(F.min("id").alias("id"), *[F.first(e).alias(e) for e in ("n", "own", "lead")]), "signatures")
    pairs = kept(meetings(nodes.where("n > 0").select("node", F.col("node").alias("c"), F.lit(0).alias("x"), "own"), how).select("a", "b", F.lit(True).alias("more")).distinct(), "pairs")
    # one row for each node that meets another; by id as well, so that many copies of a text do not come to one task
    asked = nodes.join(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct(), "node", "left_semi").select("id", "node")
    sets = kept(hash_sets(texts.join(asked, ["id", "node"], "left_semi").dropDuplicates(["id", "node"]), width), "sets")
    near = []
    for level in range(1, levels + 1):
        new = kept(judged(pairs, sets, likeness), "judged")
        near.append(new.where("near").select("a", "b"))
        if level < levels:
            met = new.where("more").select(F.col("b").alias("head"), F.col("a").alias("node"), F.when(F.col("near"), F.col("b")).otherwise(F.col("a")).alias("c"))
            mixed = met.groupBy("head").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("head")
            crowd = kept(placed(met.join(mixed, "head"), sets, how, 3 * level), "crowd")
            nearest = crowd.withColumn("at", F.row_number().over(W.partitionBy("head").orderBy("x", "node"))).where(F.col("at") <= heads)
            nearest = nearest.select("head", F.col("node").alias("b"), F.col("c").alias("d"), F.col("x").alias("y"))
            # of two heads the one nearer to the reference is b
            stars = crowd.join(nearest, "head").where("c <> d and struct(x, node) > struct(y, b)").select(F.col("node").alias("a"), "b", F.lit(False).alias("more"))
            told = meetings(crowd, how, "head").select("a", "b", (F.col("s") >= 2 * segments).alias("more"))
            pairs = kept(stars.unionAll(told).groupBy("a", "b").agg(F.max("more").alias("more")), "pairs")
    named = kept(nodes.select("node", "id", "n", "lead").join(components(reduce(DataFrame.unionAll, near)), "node", "left").withColumn("c", F.coalesce("component", "node")), "classes")
    links = kept(missed_links(named, texts, width, likeness), "missed")
    found = named.select("node", "id", "component", "c")
    if not links.isEmpty():
        a, b = (found.select(F.col("node").alias(e), F.col("c").alias(f"{e}_c")) for e in "ab")
        joined = components(links.join(a, "a").join(b, "b").select(F.col("a_c").alias("a"), F.col("b_c").alias("b")))
        found = found.join(joined.select(F.col("node").alias("c"), F.col("component").alias("whole")), "c", "left").withColumn("component", F.coalesce("whole", "component"))
    return found.select("node", "id", "component")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, likeness: float = 0.8, segments: int = 6) -> DataFrame:
    """docs without all but one row of each near-duplicate class, with the columns of docs.

    Classes are those of text_classes; texts that are equal word for word (ASCII case aside) are one node of it, known
    by a 64-bit hash, and texts without words are equal. The row of smallest id stays, where that id has several texts
    of the class the one of smallest hash, and where the row repeats, one of its repeats. Rows with one id and texts of
    different classes are judged each for itself. Rows with a null id stay, and drop no other.
    """
    name = fresh(docs, "near_node")
    rows = docs.where(F.col(id_col).isNotNull()).withColumn(name, F.xxhash64(F.array_join(words(ascii_lower(F.col(text_col))), " ")))
    texts = rows.select(F.col(id_col).alias("id"), F.col(name).alias("node"), F.col(text_col).alias("text"))
    found = text_classes(texts, width=width, likeness=likeness, segments=segments)
    named = found.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min(F.struct("id", "node")).alias("one"))
    stay = kept(named.select(F.col("one.id").alias(f"{name}_id"), F.col("one.node").alias(f"{name}_node")), "stay")
    one = rows.join(stay, (F.col(id_col) == F.col(f"{name}_id")) & (F.col(name) == F.col(f"{name}_node")), "left_semi")
    return one.dropDuplicates([id_col, name]).select(*docs.columns).unionAll(docs.where(F.col(id_col).isNull()))
