"""Operator 11: the language of a text by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import cut

#: Bytes of a column that are looked at together.
SPAN = 1 << 18
#: Code lengths are whole numbers of this part of a bit, so that sums do not depend on their order.
UNIT = 1 << 20
#: Codes that are held before they are counted, and distinct codes that a task holds before it passes them on.
PENDING, HELD = 1 << 22, 1 << 21


def column_bytes(column):
    """(bytes, offsets) of an Arrow column of strings, one piece behind the other; nulls are empty."""
    import numpy as np
    import pyarrow as pa

    plain = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
    data = plain.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def history_codes(data, width: int):
    """For each place from width - 1 on the last `width` bytes as one number, the latest lowest."""
    import numpy as np

    n = max(0, len(data) - width + 1)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = (out << np.uint64(8)) | data[j : j + n]
    return out


def gram_counts(texts: DataFrame, order: int) -> DataFrame:
    """(lang, top, code, n): how often a byte follows `top` bytes; texts has the columns lang and text.

    Every byte counts with as many bytes before it as its text has, `order` at most, and with each shorter run of them.
    Tasks count what they read and pass sums on.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        pending, held, waiting = {}, {}, 0

        def settle() -> int:
            for key, parts in pending.items():
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                if key in held:
                    codes, back = np.unique(np.concatenate([held[key][0], codes]), return_inverse=True)
                    n = np.bincount(back, np.concatenate([held[key][1], n])).astype(np.int64)
                held[key] = codes, n.astype(np.int64)
            pending.clear()
            return sum(len(x[0]) for x in held.values())

        def emit() -> Iterator:
            for (lang, top), (codes, n) in held.items():
                for at in range(0, len(codes), 1 << 16):
                    c, k = codes[at : at + (1 << 16)].astype(np.int64), n[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(np.full(len(c), top, np.int32)), pa.array(c), pa.array(k)], names=["lang", "top", "code", "n"])
            held.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for at in range(0, batch.num_rows, 256):
                data, offsets = column_bytes(batch.column(1).slice(at, 256))
                for i, lang in enumerate(langs[at : at + 256]):
                    own = data[offsets[i] : offsets[i + 1]]
                    for top in range(min(order, len(own))):
                        pending.setdefault((lang, top), []).append(history_codes(own[: top + 1], top + 1))
                    for start in range(0, max(0, len(own) - order), SPAN):
                        got = history_codes(own[start : start + SPAN + order], order + 1)
                        pending.setdefault((lang, order), []).append(got)
                        waiting += len(got)
                        if waiting > PENDING:
                            waiting = 0
                            if settle() > HELD:
                                yield from emit()
        settle()
        yield from emit()

    counted = texts.select("lang", "text").mapInArrow(run, "lang string, top int, code long, n long").groupBy("lang", "top", "code").agg(F.sum("n").alias("n"))
    shorter = counted.select("lang", "n", "code", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("order"))
    masked = F.col("code").bitwiseAND(F.expr("shiftleft(1L, 8 * (`order` + 1)) - 1"))
    return shorter.select("lang", F.col("order").alias("top"), masked.alias("code"), "n").groupBy("lang", "top", "code").agg(F.sum("n").alias("n"))


class ContextTrees:
    """Frozen byte context trees of several languages and the code lengths they give.

    A byte is coded in the longest context of the bytes before it that the language's tree holds. There each byte seen
    in the context has its count and escaping has the number of distinct bytes; after an escape the next shorter
    context codes without the bytes that were ruled out, and below the empty one all others are equally likely.
    """

    def __init__(self, langs: list[str], order: int, rows: list, slots: int = 1 << 21):
        """rows: by order (codes, lang places, counts) of the contexts that stay."""
        import numpy as np

        self.langs, self.order, n_langs = langs, order, len(langs)
        self.contexts, self.grams = [], []
        counts: list = []
        with np.errstate(divide="ignore", invalid="ignore"):
            bits = lambda x: np.where(x > 0, np.rint(np.log2(np.maximum(x, 1)) * UNIT), -1).astype(np.int32)
            for j in range(order + 1):
                codes, lang, n = rows[j]
                grams, at = np.unique(codes, return_inverse=True)
                table = np.zeros((len(grams), n_langs), np.int64)
                table[at, lang] = n
                context, first = np.unique(grams >> np.uint64(8), return_index=True)
                total, kinds = (np.add.reduceat(x, first, axis=0) if len(grams) else np.zeros((0, n_langs), np.int64) for x in (table, (table > 0).astype(np.int64)))
                rest = left = np.zeros_like(total)
                if j and len(grams):
                    mask = np.uint64((1 << 8 * j) - 1)
                    above = np.searchsorted(counts[j - 1][0], grams & mask)
                    ruled = np.add.reduceat(np.where(table > 0, counts[j - 1][1][above], 0), first, axis=0)
                    up = np.searchsorted(counts[j - 1][2], context & (mask >> np.uint64(8)))
                    rest, left = counts[j - 1][3][up] - ruled, counts[j - 1][4][up] - kinds
                counts.append((grams, table, context, total, kinds))
                in_all, after = bits(np.where(total > 0, total + kinds, 0)), bits(np.where(total > 0, rest + left, 0))
                # as the first context: of all, of an escape; of the next shorter one after this: of all, of an escape
                self.contexts.append((context, in_all, in_all - bits(kinds), after, np.where((left > 0) & (total > 0), after - bits(left), 0)))
                self.grams.append((grams, bits(table)))
        unseen = 256 - (counts[0][4][0] if len(counts[0][4]) else np.zeros(n_langs, np.int64))
        self.below = np.rint(np.log2(np.maximum(unseen, 1)) * UNIT).astype(np.int64)
        codes = self.grams[order][0]
        self.shift = np.uint64(64 - slots.bit_length() + 1)
        self.slots = np.full(slots, -1, np.int32)
        where = self.slot(codes)
        by_count = np.argsort(counts[order][1].sum(axis=1), kind="stable")
        self.slots[where[by_count]] = by_count.astype(np.int32)  # of codes that share a slot the most frequent stays
        self.known = self.lengths(codes, order).astype(np.int32) if len(codes) else np.zeros((1, n_langs), np.int32)
        self.codes = codes if len(codes) else np.full(1, np.iinfo(np.uint64).max, np.uint64)

    def slot(self, codes):
        import numpy as np

        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def lengths(self, codes, top: int):
        """The code length of each code's last byte after the `top` bytes before it, in every language."""
        import numpy as np

        out = np.zeros((len(codes), len(self.langs)), np.int64)
        open_, began = np.ones(out.shape, bool), np.zeros(out.shape, bool)
        of_all, of_escape = np.zeros(out.shape, np.int64), np.zeros(out.shape, np.int64)
        for j in range(top, -1, -1):
            context = (codes >> np.uint64(8)) & np.uint64((1 << 8 * j) - 1)
            gram = codes & np.uint64((1 << 8 * (j + 1)) - 1)
            names, in_all, escape, after, after_escape = self.contexts[j]
            if not len(names):
                continue
            at = np.minimum(np.searchsorted(names, context), len(names) - 1)
            held = (names[at] == context)[:, None] & (in_all[at] >= 0)
            all_ = np.where(began, of_all, in_all[at])
            leave = np.where(began, of_escape, escape[at])
            words, n = self.grams[j]
            place = np.minimum(np.searchsorted(words, gram), len(words) - 1)
            seen = np.where((words[place] == gram)[:, None], n[place], -1)
            hit = open_ & held & (seen >= 0)
            out += np.where(hit, all_ - seen, np.where(open_ & held, leave, 0))
            open_ &= ~hit
            began |= held
            of_all, of_escape = np.where(held, after[at], of_all), np.where(held, after_escape[at], of_escape)
        return out + np.where(open_, self.below, 0)

    def texts(self, data, offsets):
        """Code lengths of whole texts that lie one behind the other, in every language."""
        import numpy as np

        out = np.zeros((len(offsets) - 1, len(self.langs)), np.int64)
        starts, sizes, zero = offsets[:-1], np.diff(offsets), np.zeros((1, len(self.langs)), np.int32)
        for top in range(self.order):  # the first bytes of a text have fewer before them
            own = np.flatnonzero(sizes > top)
            code = np.zeros(len(own), np.uint64)
            for j in range(top + 1):
                code = (code << np.uint64(8)) | data[starts[own] + j]
            if len(own):
                codes, back = np.unique(code, return_inverse=True)
                out[own] += self.lengths(codes, top)[back]
        for at in range(0, len(data) - self.order, SPAN):
            code = history_codes(data[at : at + SPAN + self.order], self.order + 1)
            place = at + self.order  # of the first of these bytes
            row = self.slots[self.slot(code)]
            got = self.known.take(row, axis=0, mode="wrap")
            new = np.flatnonzero((row < 0) | (self.codes[row] != code))
            if len(new):
                codes, back = np.unique(code[new], return_inverse=True)
                got[new] = self.lengths(codes, self.order)[back]
            some = slice(*np.searchsorted(offsets[1:], [place, place + len(code) - 1], side="right") + np.array([0, 1]))
            low, high = np.clip(starts[some] + self.order, place, None) - place, np.clip(offsets[1:][some], None, place + len(code)) - place
            own = np.arange(some.start, some.stop)[low < high]
            if len(own):  # every other stretch lies between two texts
                out[own] += np.add.reduceat(np.concatenate([got, zero]), np.stack([low, high], 1)[low < high].ravel(), axis=0, dtype=np.int64)[::2]
        return out


def fit(texts: DataFrame, *, order: int = 4, most_grams: int = 1_000_000, most_langs: int = 64) -> ContextTrees:
    """Context trees from all rows of texts (lang, text); rows with a null in either teach nothing.

    Counts cover every byte of every row. Of each language's contexts those of largest count stay, as many whole levels
    of counts (eight for each doubling) as hold most_grams / number of languages (context, byte) pairs at most, and the
    empty context; a shorter context has never a smaller count, so every context that stays has its shorter ones. The
    most_langs languages with the most rows are learned, ties by name. These bounds are what is broadcast, whatever the
    input: most_grams pairs, each with a number for each language.
    """
    import numpy as np

    good = texts.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    names = [r["lang"] for r in good.where(F.length("text") > 0).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()]
    langs = sorted(names)
    counted = gram_counts(good.where(F.col("lang").isin(langs)), order)
    node = W.partitionBy("lang", "top", F.shiftright("code", 8))
    sized = counted.withColumn("level", F.floor(F.log2(F.sum("n").over(node)) * 8).cast("int"))
    sized = cut(sized.join(F.broadcast(spark_table(texts.sparkSession, langs)), "lang").select("place", "top", "code", "n", "level"))
    least = {}
    for r in sized.groupBy("place", "level").count().orderBy("place", F.desc("level")).collect():  # a row a doubling's eighth
        used, low, shut = least.get(r["place"], (0, 1 << 30, False))
        shut = shut or used + r["count"] > most_grams // len(langs)
        least[r["place"]] = (used, low, True) if shut else (used + r["count"], r["level"], False)
    edge = F.lit(1 << 30)
    for place, (_, low, _) in least.items():
        edge = F.when(F.col("place") == place, low).otherwise(edge)
    found = sized.where((F.col("top") == 0) | (F.col("level") >= edge)).select("place", "top", "code", "n").toArrow()
    place, top, code, n = (found.column(c).to_numpy() for c in ("place", "top", "code", "n"))
    return ContextTrees(langs, order, [(code[top == j].astype(np.uint64), place[top == j], n[top == j]) for j in range(order + 1)])


def spark_table(spark: SparkSession, langs: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(langs)), "place int, lang string")


def spread(docs: DataFrame) -> DataFrame:
    """docs, dealt out evenly where the scan has fewer tasks than there are cores."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def predict(docs: DataFrame, trees: ContextTrees, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Operator 11. (doc, lang_pred, score, bits): a row for each row of docs, from its whole text alone.

    lang_pred: the language whose tree codes the text in the fewest bits, ties by name; bits: how many; score: its share
    of the languages' probabilities 2^-bits. Null texts and those without a letter have `und`, score 0 and null bits, as
    has every text where no language was learned. Repeated rows and null ids are rows like others; other columns are not
    read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    asked = docs.select(F.col(id_col).alias("doc"), F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("text"))
    schema = T.StructType([T.StructField("doc", kind), *T.StructType.fromDDL("lang_pred string, score double, bits double").fields])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                known = part.column(1).is_valid().to_numpy(zero_copy_only=False) & bool(own.langs)
                pred, score, bits = np.full(len(known), "und", object), np.zeros(len(known)), np.zeros(len(known))
                if known.any():
                    lengths = own.texts(*column_bytes(part.column(1)))
                    best, least = lengths.argmin(axis=1), lengths.min(axis=1)
                    shares = 1 / np.exp2((least[:, None] - lengths) / UNIT).sum(axis=1)
                    pred = np.where(known, np.array(own.langs, object)[best], pred)
                    score, bits = np.where(known, shares, 0.0), least / UNIT
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(bits, mask=~known)], names=schema.names)

    return spread(asked).mapInArrow(run, schema)


def identify(docs: DataFrame, learned_from: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """predict() with trees that fit() learns from all rows of learned_from (lang, text)."""
    return predict(docs, fit(spread(learned_from), **how), id_col=id_col, text_col=text_col)
