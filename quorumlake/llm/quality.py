"""Operator 8: a quality classifier by importance resampling with hashed n-gram models."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, held, kth_largest, with_fields

BYTE_BUCKETS, SHAPE_BUCKETS = 1 << 16, 1 << 14
BUCKETS = BYTE_BUCKETS + SHAPE_BUCKETS
#: Bytes that are looked at together; longer texts are taken window by window.
WINDOW = 1 << 20


def powers() -> list:
    """Powers of an odd number and of its inverse modulo 2**64, as many as a window has bytes."""
    import numpy as np

    base = 0x9E3779B97F4A7C15
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(WINDOW + 4, b, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out


def grams(text: str) -> Iterator:
    """Buckets of the hashed n-grams of a text: runs of four bytes, and runs of three word shapes.

    A word's shape is the class of its first, second and last byte, its length up to four sizes, and whether it repeats
    the word before it.
    """
    import numpy as np

    power, inverse_power = held("powers", powers)
    whole = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    for at in range(0, len(whole), WINDOW):
        data = whole[at : at + WINDOW + 3]
        v = data.astype(np.uint32)
        if len(v) >= 4:
            four = v[:-3] | (v[1:-2] << 8) | (v[2:-1] << 16) | (v[3:] << 24)
            yield ((four * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
        data = data[:WINDOW]
        blank = np.concatenate([[True], (data == 32) | ((data >= 9) & (data <= 13)), [True]])
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        start, end = edges[::2], edges[1::2]
        if len(start) < 3:
            continue
        kind = np.full(256, 4, np.int64)
        kind[97:123], kind[65:91], kind[48:58], kind[128:] = 0, 1, 2, 3
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)])
        names = (sums[end] - sums[start]) * inverse_power[start]
        same = np.concatenate([[False], names[1:] == names[:-1]])
        size = np.minimum(end - start, 15) >> 2
        shape = (((kind[data[start]] * 5 + kind[data[end - 1]]) * 2 + (kind[data[np.minimum(start + 1, end - 1)]] == 1)) * 2 + same) * 4 + size
        three = (shape[:-2] + 400 * shape[1:-1] + 160_000 * shape[2:]).astype(np.uint32)
        yield BYTE_BUCKETS + ((three * np.uint32(2246822519)) >> np.uint32(18)).astype(np.int64)


def bucket_counts(texts: DataFrame) -> list[int]:
    """How often each bucket occurs in all texts of the column `text`; counted where the texts lie, summed by bucket."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for codes in grams(text.as_py() or ""):
                    total += np.bincount(codes, minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype("int32")), pa.array(total[found])], names=["bucket", "n"])

    # as many rows as there are buckets, whatever the input
    rows = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = [0] * BUCKETS
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def log_ratios(target: list[int], raw: list[int], smoothing: float = 0.5):
    """The log ratio of a bucket's probability in the target and in the raw model, for each of the two kinds of runs."""
    import numpy as np

    out = np.zeros(BUCKETS)
    for part in (slice(0, BYTE_BUCKETS), slice(BYTE_BUCKETS, BUCKETS)):
        t, r = np.array(target[part], float) + smoothing, np.array(raw[part], float) + smoothing
        out[part] = np.log(t / t.sum()) - np.log(r / r.sum())
    return out


def weighed(docs: DataFrame, ratios, text_col: str = "text", evidence: int = 200, names: tuple[str, str] = ("log_weight", "n_grams")) -> DataFrame:
    """docs with log_weight, the log ratios of the text's n-grams, and n_grams; null texts have none.

    The n-grams of a text are far from independent, so a text of more than `evidence` n-grams weighs as that many of its
    average; the log weight of a shorter one is the plain sum.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # of fixed size: one number for each bucket
    schema = with_fields(docs, f"`{names[0]}` double, `{names[1]}` long")
    place = docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                weights, sizes = [], []
                for text in part.column(place):
                    got = [(float(table[codes].sum()), len(codes)) for codes in grams(text.as_py() or "")]
                    total, n = sum((g[0] for g in got), 0.0), sum(g[1] for g in got)
                    weights.append(total * min(1.0, evidence / n) if n else 0.0)
                    sizes.append(n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(weights, pa.float64()), pa.array(sizes, pa.int64())], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def best_cut(good: list[float], bad: list[float]) -> float:
    """The log weight that best parts good from bad rows: highest mean of both rates, in the middle of its gap."""
    if not good:
        return float("-inf")
    if not bad:
        return min(good)
    marked = sorted([(w, 1) for w in good] + [(w, 0) for w in bad])
    kept, dropped, best, cut_at = len(good), 0, -1.0, float("-inf")
    for i, (w, is_good) in enumerate(marked):
        score = kept / len(good) + dropped / len(bad)
        if score > best and (i == 0 or marked[i - 1][0] < w):
            best, cut_at = score, w if i == 0 else (marked[i - 1][0] + w) / 2
        kept, dropped = kept - is_good, dropped + (1 - is_good)
    if dropped / len(bad) > best:
        cut_at = marked[-1][0] + 1.0
    return cut_at


class Resampler:
    """The fitted models: log ratios by bucket and the log weight from which a document counts as like the target."""

    def __init__(self, ratios, cut_at: float, seed: int):
        self.ratios, self.cut_at, self.seed = ratios, cut_at, seed

    def keyed(self, docs: DataFrame, id_col: str, text_col: str, names: tuple[str, str, str] = ("log_weight", "n_grams", "sample_key")) -> DataFrame:
        """docs with log_weight, n_grams and sample_key: the log weight plus Gumbel noise seeded by the id."""
        uniform = (F.xxhash64(F.lit(self.seed), F.col(id_col)).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))
        return weighed(docs, self.ratios, text_col, names=names[:2]).withColumn(names[2], F.col(names[0]) - F.log(-F.log(uniform)))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_labels: int = 20_000, seed: int = 11) -> Resampler:
    """Fits the target model to labelled good rows and the raw model to all rows of docs.

    At most most_labels labelled ids, those of smallest hash, are used; a quarter of them is held out to choose the cut.
    The raw model counts every n-gram of every row. Ids labelled both ways count as good only if all labels say so.
    Without labelled good rows every document is kept.
    """
    spark = docs.sparkSession
    mixed = F.xxhash64(F.lit(seed), F.col("id"))
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("good"))
    some = known.select("id", "good", mixed.alias("h")).orderBy("h", "id").limit(most_labels).collect()
    sample = spark.createDataFrame([(r["id"], r["good"], int(i % 4 == 0)) for i, r in enumerate(some)], "label_id bigint, good int, held int")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    labelled = texts.join(F.broadcast(sample), F.col("id") == F.col("label_id"))  # most_labels rows at most
    raw = bucket_counts(texts)
    ratios = log_ratios(bucket_counts(labelled.where("good = 1 and held = 0")), raw)
    held = weighed(labelled.where("held = 1"), ratios).select("good", "log_weight").collect()
    return Resampler(ratios, best_cut([r[1] for r in held if r[0] == 1], [r[1] for r in held if r[0] == 0]), seed)


def resample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, **how) -> DataFrame:
    """Operator 8. (doc, n_grams, log_weight, sample_key, kept): a row for each row of docs.

    Importance weights are ratios of hashed n-gram models of good and raw text. The k rows with the largest sum of log
    weight and Gumbel noise are kept, which samples without replacement in proportion to the weights; rows tied with
    the last one are kept as well. Unless given, k is the number of rows whose weight is at least the fitted cut.

    Null and empty texts have no n-grams and log weight 0. Rows that repeat an id have the same noise. Rows with a null
    id share one. Other columns are not read. An empty table gives no rows.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **how)
    keyed = model.keyed(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), "doc", "text").drop("text")
    scored = cut(keyed)
    least = threshold(scored, model, k)
    return scored.select("doc", "n_grams", "log_weight", "sample_key", (F.col("sample_key") >= F.lit(least)).alias("kept"))


def threshold(scored: DataFrame, model: Resampler, k: int | None) -> float:
    """The sample key of the k-th row."""
    want = scored.where(F.col("log_weight") >= F.lit(model.cut_at)).count() if k is None else k
    if want < 1:
        return float("inf")
    least = kth_largest(scored, "sample_key", want)
    return float("-inf") if least is None else least


def keep_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, **how) -> DataFrame:
    """docs without the rows that importance resampling leaves out, with the columns of docs; texts are not moved."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **how)
    least = threshold(cut(model.keyed(docs.select(id_col, text_col), id_col, text_col).select("log_weight", "sample_key")), model, k)
    names = tuple(fresh(docs, c) for c in ("log_weight", "n_grams", "sample_key"))
    return model.keyed(docs, id_col, text_col, names).where(F.col(names[2]) >= F.lit(least)).select(*docs.columns)
