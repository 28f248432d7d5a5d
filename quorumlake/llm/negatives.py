"""Operator 13: hard negatives by distributed radix selection on integer scores."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import kept, scratch
from .whitening import FARTHEST, commonest_length, finite_vectors, matrix

#: A digit of a radix pass, in bits; a window's histogram has so many buckets.
DIGIT = 8
#: Rows and anchors whose scores are held at once.
ROWS, ASKING = 2048, 256
LOWEST, HIGHEST = -(1 << 63) + 1, (1 << 63) - 1


def whole_rows(rows: DataFrame, *, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, x) of the rows that take part, one for each id: entries as whole numbers floor(scale * entry)."""
    # the label travels with the id through the check of vectors
    good = finite_vectors(rows.select(F.struct(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label")).alias("who"), F.col(vector_col).alias("vector")), "who", "vector")
    good = good.select(F.col("id.id").alias("id"), F.col("id.label").alias("label"), "v").where("id is not null and label is not null")
    x = F.transform("v", lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(-FARTHEST)), F.lit(FARTHEST))))
    own = good.select("id", F.struct("label", x.alias("x")).alias("of")).groupBy("id").agg(F.min("of").alias("of")).select("id", "of.label", "of.x")
    return kept(own, "rows")


class Block:
    """A bounded number of anchors and the windows of scores that are searched for each: the k best rows in each window.

    Better is the higher score, then the smaller id. A window stands for [low, high] and for rows with the anchor's
    label or for rows with another. `high` and `low` narrow to one bucket after another until the k-th best row is
    known closely enough; `level` says whether it is the score's digits that are searched or, among rows of one score,
    the id's.
    """

    def __init__(self, ids, labels, vectors, anchor, low, high, names, *, same: bool, k: int, ids_from: int, ids_to: int):
        import numpy as np

        self.ids, self.labels, self.vectors, self.same, self.k = ids, labels, vectors, same, k
        self.anchor, self.low, self.high, self.names = anchor, low.copy(), high.copy(), names  # windows lie in order of their anchors
        self.first_low, self.first_high, self.n = low, high, len(anchor)
        self.by_id = np.zeros(self.n, bool)
        self.ids_from, self.ids_to = np.full(self.n, ids_from, np.int64), np.full(self.n, ids_to, np.int64)
        self.above, self.done = np.zeros(self.n, np.int64), low > high

    def span(self):
        """The distance of the worst place from the best in what is searched, and the bits below the next digit."""
        import numpy as np

        width = np.where(self.by_id, self.ids_to - self.ids_from, self.high - self.low).view(np.uint64)
        return width, np.array([max(0, int(w).bit_length() - DIGIT) for w in width], np.uint64)

    def scores(self, batch) -> Iterator:
        """(rows' places, windows, scores) of the pairs within the windows, some rows and anchors at a time."""
        import numpy as np

        x, labels, ids = matrix(batch.column(2)), batch.column(1).to_numpy(), batch.column(0).to_numpy()
        largest = max(1, *(int(f(z)) * s for z in (x, self.vectors) for f, s in ((np.max, 1), (np.min, -1))))
        plain = largest**2 * x.shape[1] < 1 << 53  # doubles hold the sums exactly
        starts = np.searchsorted(self.anchor, np.arange(len(self.ids) + 1))
        for a in range(0, len(self.ids), ASKING):
            b = min(a + ASKING, len(self.ids))
            own = slice(starts[a], starts[b])
            if own.start == own.stop:
                continue
            which = self.anchor[own] - a
            least, most = np.full(b - a, HIGHEST), np.full(b - a, LOWEST)
            np.minimum.at(least, which, self.first_low[own])
            np.maximum.at(most, which, self.first_high[own])
            if plain:
                s = (x.astype(float) @ self.vectors[a:b].T.astype(float)).astype(np.int64)
            else:
                s = np.clip(x.astype(object) @ self.vectors[a:b].T.astype(object), LOWEST, HIGHEST).astype(np.int64)
            fits = (s >= least) & (s <= most) & ((labels[:, None] == self.labels[a:b]) == self.same) & (ids[:, None] != self.ids[a:b])
            row, at = np.nonzero(fits)
            times = starts[a + at + 1] - starts[a + at]
            window = np.repeat(starts[a + at] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            row, score = np.repeat(row, times), np.repeat(s[row, at], times)
            good = (score >= self.first_low[window]) & (score <= self.first_high[window])
            yield ids[row[good]], window[good], score[good]

    def histogram(self, batches: Iterator) -> Iterator:
        """(window, bucket, n, need): a task's counts of the next digit, from the best bucket to the one that holds its own k-th best row.

        The table's k-th best row is no worse, so the counts of its bucket and of all better ones are whole.
        """
        import numpy as np
        import pyarrow as pa

        width, shift = self.span()
        counts = np.zeros(self.n << DIGIT, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for ids, window, score in self.scores(batch.slice(at, ROWS)):
                    off = np.where(self.by_id[window], ids - self.ids_from[window], self.high[window] - score).view(np.uint64)
                    good = ~self.done[window] & (off <= width[window]) & (~self.by_id[window] | (score == self.low[window]))
                    np.add.at(counts, (window[good] << DIGIT) + (off[good] >> shift[window[good]]).astype(np.int64), 1)
        counts = counts.reshape(self.n, -1)
        need = self.k - self.above
        window, bucket = np.nonzero((counts > 0) & (np.cumsum(counts, axis=1) - counts < need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(window.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[window, bucket]), pa.array(need[window])], names=["window", "bucket", "n", "need"])

    def narrow(self, found, gather: int) -> None:
        """Takes the bucket with the k-th best row of each window; windows without one hold fewer than k rows: all of them count."""
        import numpy as np

        _, shift = self.span()
        w, bucket, before, n = (found.column(c).to_numpy() for c in ("window", "bucket", "before", "n"))
        open_ = np.zeros(self.n, bool)
        open_[w] = True
        self.done |= ~open_
        self.above[w] += before
        step, last = (bucket.astype(np.uint64) << shift[w]).view(np.int64), ((np.uint64(1) << shift[w]) - np.uint64(1)).view(np.int64)
        score, by_id = w[~self.by_id[w]], w[self.by_id[w]]
        near, far = step[~self.by_id[w]], last[~self.by_id[w]]
        self.high[score] -= near
        reach = (self.high[score] - self.low[score]).view(np.uint64) > far.view(np.uint64)
        self.low[score] = np.where(reach, self.high[score] - far, self.low[score])
        near, far = step[self.by_id[w]], last[self.by_id[w]]
        self.ids_from[by_id] += near
        reach = (self.ids_to[by_id] - self.ids_from[by_id]).view(np.uint64) > far.view(np.uint64)
        self.ids_to[by_id] = np.where(reach, self.ids_from[by_id] + far, self.ids_to[by_id])
        few = self.above[w] + n <= gather
        single = self.low[w] == self.high[w]
        self.done[w] = few | (self.by_id[w] & (self.ids_from[w] == self.ids_to[w]))
        self.by_id[w] |= single & ~few

    def qualifying(self, batches: Iterator) -> Iterator:
        """(name, of, of_score, id, score) of the rows at least as good as the bucket of the k-th best."""
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for ids, window, score in self.scores(batch.slice(at, ROWS)):
                    good = (score > self.low[window]) | ((score == self.low[window]) & (~self.by_id[window] | (ids <= self.ids_to[window])))
                    window = window[good]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[window]) for x in (self.ids[self.anchor], *self.names)), pa.array(ids[good]), pa.array(score[good])], names=["anchor", "of", "of_score", "id", "score"])


def best_rows(rows: DataFrame, block: Block, *, gather: int) -> DataFrame:
    """(anchor, of, of_score, id, score, rank): the k best rows of each window, ranked from 1."""
    while not block.done.all():
        counts = rows.mapInArrow(block.histogram, "window int, bucket int, n long, need long").groupBy("window", "bucket").agg(F.sum("n").alias("n"), F.first("need").alias("need"))
        upto = counts.withColumn("upto", F.sum("n").over(W.partitionBy("window").orderBy("bucket")))
        # a row for each of the block's windows at most
        block.narrow(upto.where("upto >= need and upto - n < need").select("window", "bucket", (F.col("upto") - F.col("n")).alias("before"), "n").toArrow(), gather)
    found = rows.mapInArrow(block.qualifying, "anchor long, of long, of_score long, id long, score long")
    order = W.partitionBy("anchor", "of").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= block.k)


def mine(
    rows: DataFrame, anchors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5,
    low: int = 80, high: int = 100, scale: int = 256, block_rows: int = 2048, gather: int = 20,
) -> DataFrame:
    """Operator 13. (anchor, positive, rank, negative, positive_score, negative_score), all but the int rank long.

    Entries count as floor(scale * entry), and a row's score is its inner product with the anchor; better is the higher
    score, then the smaller id. An anchor's positives are its best `positives` other rows of the same label. For each,
    its best `negatives` rows of another label with low * positive_score <= 100 * score <= high * positive_score come
    back; fewer where there are fewer, none for a positive of negative score.

    anchors: ids (column id_col), taken in blocks of about block_rows, which bounds what is sent to all tasks; the rows
    stay where they lie. Within a block every (anchor, positive) window has a histogram of the next eight bits of the
    score; the bucket of the last wanted row is refined digit by digit, and on through the digits of the id where one
    score has very many rows, until it leaves at most `gather` rows, and these alone are gathered and ranked.

    Rows with a null id or label, a vector that is null, empty, of another length than most, or that holds null, NaN or
    an infinity take no part. Of rows that repeat an id the one of least label, then vector, counts. Scaled entries
    beyond 9e18 count as that, and scores end at a long's ends. Other columns are not read; empty tables give no rows.
    """
    import numpy as np

    spark = rows.sparkSession
    every = whole_rows(rows, id_col=id_col, vector_col=vector_col, label_col=label_col, scale=scale)
    width = commonest_length(every, "x")
    every = every.where(F.size("x") == width)
    square = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    first, last, norm = every.agg(F.min("id"), F.max("id"), F.max(square)).first()
    schema = T.StructType.fromDDL("anchor long, positive long, rank int, negative long, positive_score long, negative_score long")
    if first is None:
        return spark.createDataFrame([], schema)
    far = min(HIGHEST, int(norm * 1.000001) + 1)
    asking = every.join(anchors.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi")
    blocks = max(1, -(-asking.count() // block_rows))
    at = scratch(spark, "anchors")
    asking.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartition("block").write.partitionBy("block").parquet(at)
    to = scratch(spark, "negatives")
    spark.createDataFrame([], schema).write.parquet(to)
    found = spark.read.schema("id long, label long, x array<long>, block int").parquet(at)
    for b in range(blocks):
        own = found.where(F.col("block") == b).orderBy("id").toArrow()  # about block_rows rows
        if not own.num_rows:
            continue
        ids, labels, vectors = own.column("id").to_numpy(), own.column("label").to_numpy(), matrix(own.column("x").combine_chunks())
        how = {"ids_from": first, "ids_to": last}
        each = np.arange(len(ids))
        widest = np.full(len(ids), far)
        like = Block(ids, labels, vectors, each, -widest, widest, (ids, ids), same=True, k=positives, **how)
        near = best_rows(every, like, gather=gather).select("anchor", "id", "score").orderBy("anchor", "rank").toArrow()  # positives for each anchor
        anchor = np.searchsorted(ids, near.column("anchor").to_numpy())
        score = near.column("score").to_numpy()
        bounds = [(-(-low * s // 100), high * s // 100) for s in score.tolist()]
        least, most = (np.array([min(max(x[i], LOWEST), HIGHEST) for x in bounds], np.int64) for i in (0, 1))
        unlike = Block(ids, labels, vectors, anchor, least, most, (near.column("id").to_numpy(), score), same=False, k=negatives, **how)
        hard = best_rows(every, unlike, gather=gather)
        hard.select("anchor", F.col("of").alias("positive"), "rank", F.col("id").alias("negative"), F.col("of_score").alias("positive_score"), F.col("score").alias("negative_score")).write.mode("append").parquet(to)
    return spark.read.schema(schema).parquet(to)
