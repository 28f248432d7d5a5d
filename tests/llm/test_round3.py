"""Operators 11 to 13 against brute force and on odd tables."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlake.llm import language, negatives, queries, whitening

VECTORS = "vec_id bigint, embedding array<double>, label int"


# ---- op11 -------------------------------------------------------------------


class PlainTrees:
    """Counts by context in dictionaries, one byte after another, escapes with exclusion."""

    def __init__(self, texts, order):
        self.order, self.seen = order, defaultdict(Counter)
        for text in texts:
            data = text.encode()
            for i, b in enumerate(data):
                for j in range(min(i, order) + 1):
                    self.seen[data[i - j : i]][b] += 1

    def probability(self, history: bytes, byte: int) -> float:
        out, ruled = 1.0, set()
        for j in range(min(len(history), self.order), -1, -1):
            context = history[len(history) - j :]
            if context not in self.seen:
                continue
            open_ = {b: n for b, n in self.seen[context].items() if b not in ruled}
            whole = sum(open_.values()) + len(open_)
            if byte in open_:
                return out * open_[byte] / whole
            if open_:
                out *= len(open_) / whole
            ruled |= set(open_)
        return out / (256 - len(ruled))

    def bits(self, text: str) -> float:
        data = text.encode()
        return -sum(math.log2(self.probability(data[:i], b)) for i, b in enumerate(data))


SPOKEN = {"aa": "the rain in spain stays mainly in the plain and the train", "bb": "der regen in spanien bleibt hauptsächlich in der ebene", "cc": "zzz yyy"}


def learned(spark, order=3, **how):
    rows = [(lang, text) for lang, text in SPOKEN.items()] + [("aa", "a"), ("aa", ""), (None, "no language"), ("bb", None)]
    return language.fit(spark.createDataFrame(rows, "lang string, text string"), order=order, **how)


def test_code_lengths_are_those_of_plain_trees(spark):
    trees = learned(spark)
    plain = {"aa": PlainTrees([SPOKEN["aa"], "a"], 3), "bb": PlainTrees([SPOKEN["bb"]], 3), "cc": PlainTrees([SPOKEN["cc"]], 3)}
    assert trees.langs == ["aa", "bb", "cc"]
    for own in plain.values():
        for history in (b"", b"the", b"n s", b"\xc3", b"qqq"):
            assert sum(own.probability(history, b) for b in range(256)) == pytest.approx(1)
    r = random.Random(1)
    texts = [*SPOKEN.values(), "t", "th", "thé tráin", "".join(r.choice("therainsp dü\x00") for _ in range(400)), "x" * 50, "the rain " * 300]
    import pyarrow as pa

    for span in (1 << 18, 7):
        held, language.SPAN = language.SPAN, span
        got = trees.texts(*language.column_bytes(pa.array(["", *texts, None, texts[0]])))
        language.SPAN = held
        assert (got[0] == 0).all() and (got[-2] == 0).all() and (got[-1] == got[1]).all()
        for text, bits in zip(texts, got[1:-2], strict=True):
            for lang, own in zip(trees.langs, bits, strict=True):
                assert own / language.UNIT == pytest.approx(plain[lang].bits(text), abs=1e-5 * len(text) + 1e-5)


def test_pruned_trees_keep_their_shorter_contexts_and_sum_to_one(spark):
    trees = learned(spark, most_grams=150)
    for j in range(1, 4):
        assert set(trees.contexts[j][0] & np.uint64((1 << 8 * (j - 1)) - 1)) <= set(trees.contexts[j - 1][0])
    assert sum(len(g[0]) for g in trees.grams) <= 150 + 256
    for history in (b"the", b"n d", b"qqq"):
        codes = np.array([int.from_bytes(history + bytes([b]), "big") for b in range(256)], np.uint64)
        assert np.exp2(-trees.lengths(codes, 3) / language.UNIT).sum(axis=0) == pytest.approx(np.ones(3), abs=1e-4)


def test_languages_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "the train"), (2, None), (3, ""), (4, "12 34 !"), (5, "der regen"), (5, "der regen"), (None, "zzz"), (7, "the rain " * 60_000)], "doc_id bigint, text string").withColumns({"doc": F.lit("clash"), "bits": F.lit("clash")})
    got = Counter((r["doc"], r["lang_pred"]) for r in language.predict(docs, learned(spark)).collect())
    assert got == Counter({(1, "aa"): 1, (2, "und"): 1, (3, "und"): 1, (4, "und"): 1, (5, "bb"): 2, (None, "cc"): 1, (7, "aa"): 1})
    nothing = language.fit(docs.select(F.lit(None).cast("string").alias("lang"), "text"))
    assert {(r["lang_pred"], r["score"], r["bits"]) for r in language.predict(docs, nothing).collect()} == {("und", 0.0, None)}
    assert language.predict(docs.limit(0), learned(spark)).count() == 0


def test_languages_of_held_out_documents(spark):
    rows = queries.op11_language(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["lang_pred"] != "und" and lang[r["doc_id"]]]
    assert len(held) > 200 and sum(lang[r["doc_id"]] == r["lang_pred"] for r in held) / len(held) > 0.98


# ---- op12 -------------------------------------------------------------------


def whitened_by_hand(x, k):
    n = len(x)
    centred = x - x.sum(axis=0) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return centred @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n), ((n * x - x.sum(axis=0)) ** 2).sum(axis=1)


def compare(rows, x, ids, k):
    want, share, deviation = whitened_by_hand(x, k)
    got = {(r["id"], r["component"]): r for r in rows}
    assert len(rows) == len(ids) * k
    table = np.array([[got[i, c + 1]["whitened"] for c in range(k)] for i in ids])
    assert np.abs(table * np.sign((table * want).sum(axis=0)) - want).max() < 1e-8
    for c in range(k):
        assert got[ids[0], c + 1]["explained"] == pytest.approx(share[c], rel=1e-9)
    assert [got[i, 1]["deviation"] for i in ids] == deviation.tolist()
    assert rows[0]["identity_error"] < 1e-8 and rows[0]["residual"] <= 1e-12


def test_whitening_of_a_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    x = np.floor(1024 * np.array([r["embedding"] for r in e], float)).astype(np.int64) + 100_000
    compare(queries.op12_whitening(spark, "/root/testdata/sf0.01").withColumnRenamed("vec_id", "id").collect(), x, [r["vec_id"] for r in e], 8)


def test_whitening_wider_than_its_blocks(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((700, 150)) * np.linspace(1, 2, 150)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS)
    rows = whitening.whiten(df, components=4).collect()
    compare(rows, np.floor(1024 * x).astype(np.int64) + 100_000, list(range(700)), 4)


def test_whitening_of_odd_vectors(spark):
    r = np.random.default_rng(1)
    good = [(i, [*r.standard_normal(3).tolist(), 0.5], 1) for i in range(60)] + [(7, [1.0, 2.0, 3.0, 0.5], 1), (None, [0.0, 1.0, 0.0, 0.5], None)]
    bad = [(100, None, 0), (101, [1.0, None, 0.0, 0.5], 0), (102, [float("nan"), 0.0, 0.0, 0.5], 0), (103, [0.0, float("inf"), 0.0, 0.5], 0), (104, [], 0), (105, [1.0, 2.0], 0)]
    df = spark.createDataFrame(good + bad, VECTORS).withColumns({"id": F.lit("clash"), "x": F.lit("clash"), "component": F.lit("clash")})
    rows = whitening.whiten(df).collect()
    assert Counter(r["id"] for r in rows) == Counter(i for i, _, _ in good for _ in range(3))  # the fourth entry has no variance
    assert {r["n"] for r in rows} == {62} and max(r["identity_error"] for r in rows) < 1e-8
    for few in (df.limit(0), df.where("vec_id = 7").limit(1), df.where("vec_id >= 100 and vec_id < 104")):
        assert whitening.whiten(few).count() == 0
    vast = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0], 0), (2, [-1e300, 1.0], 0), (3, [0.0, -1.0], 0)], VECTORS)).collect()
    assert all(r["deviation"] is None for r in vast if r["id"] < 3) and all(math.isfinite(r["whitened"]) for r in vast)


# ---- op13 -------------------------------------------------------------------


def mined(rows, k=5, best=5, low=80, high=100, every=100):
    own = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        x = (label, [math.floor(256 * c) for c in v])
        own[i] = min(own.get(i, x), x)
    out = set()
    for a in (i for i in own if i % every == 0):
        scored = sorted((-sum(p * q for p, q in zip(own[a][1], own[i][1], strict=True)), i) for i in own if i != a)
        for ps, p in [(s, i) for s, i in scored if own[i][0] == own[a][0]][:k]:
            fit = [(s, i) for s, i in scored if own[i][0] != own[a][0] and low * -ps <= 100 * -s <= high * -ps][:best]
            out |= {(a, p, r + 1, i, -ps, -s) for r, (s, i) in enumerate(fit)}
    return out


def as_set(df):
    rows = [tuple(r[c] for c in ("anchor", "positive", "rank", "negative", "positive_score", "negative_score")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_hard_negatives(spark):
    r = random.Random(3)
    rows = [(i * 3 - 600, [r.gauss(0, 0.4) for _ in range(6)], r.randrange(3)) for i in range(700)]
    df = spark.createDataFrame(rows, VECTORS)
    anchors = df.where("vec_id % 100 = 0").select("vec_id")
    assert as_set(negatives.mine(df, anchors)) == mined(rows)
    assert as_set(negatives.mine(df.repartition(7), anchors, block_rows=2, gather=5, low=50, positives=3, negatives=4)) == mined(rows, 3, 4, 50)


def test_hard_negatives_among_equal_scores_and_odd_rows(spark):
    r = random.Random(4)
    same = [0.5, 0.25, -0.5]
    rows = [(i, same, i % 2) for i in range(0, 1500)] + [(5000 + i, [r.choice([0.5, 0.25, -0.25]) for _ in range(3)], r.randrange(4)) for i in range(300)]
    rows += [(-(1 << 62), same, 0), (1 << 62, same, 1), (9000, [0.0, 0.0, 0.0], 1), (9100, [-1.0, 0.0, 0.0], 77), (9200, [1.0, 0.0, 0.0], 77)]
    rows += [(9300, None, 1), (9301, [1.0, None, 1.0], 1), (9302, [float("nan"), 1.0, 1.0], 1), (None, same, 1), (9303, same, None), (9304, [float("-inf"), 1.0, 1.0], 1), (9305, [], 1)]
    rows += [(5001, same, 3), (0, same, 0), (0, same, 1)]
    df = spark.createDataFrame([*rows, (9306, [1.0], 1)], VECTORS).withColumns({"id": F.lit("clash"), "x": F.lit("clash"), "who": F.lit("clash"), "window": F.lit("clash")})
    anchors = df.where("vec_id % 500 = 0").select("vec_id")
    assert as_set(negatives.mine(df, anchors)) == mined(rows, every=500)
    assert negatives.mine(df.limit(0), anchors).count() == 0 and negatives.mine(df, anchors.limit(0)).count() == 0


def test_hard_negatives_beyond_doubles(spark):
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) * 3e6 for _ in range(4)], i % 2) for i in range(0, 120)]
    df = spark.createDataFrame(rows, VECTORS)
    assert as_set(negatives.mine(df, df.where("vec_id % 20 = 0").select("vec_id"))) == mined(rows, every=20)
