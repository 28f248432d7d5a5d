"""Corpus operators against brute force, the public libraries and odd tables."""

from __future__ import annotations

import base64
import gc
import hashlib
import random
import re
import weakref
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quorumlake.llm import ann, bpe, common, fingerprints, mixing, near_texts, pieces, quality, queries, simhash, token_counts, token_store, url_filters, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(1, 9))) + r.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty, blank and very long texts, repeated rows, clashing columns."""
    long = prose(1, 30_000)
    rows = [
        (1, long, "en", "a", 1), (2, prose(2, 300), "en", "b", 1), (3, prose(2, 300) + " end", "en", None, None), (4, None, None, "a", 0), (5, "", "en", "a", 0),
        (6, " \t\n ", "en", "c", 4), (7, "one", "en", "a", 3), (7, "one", "en", "a", 3), (None, "no id here", "en", "a", 1), (8, "Ünïcödé 𝒳 " * 50, "de", "b", 1),
        (9, long, "en", "a", 1), (10, "x" * 70_000, "en", "a", 1), (11, "a  b\n\n c \x00 <|endoftext|> d", "en", "a", 1), (12, long[: len(long) // 2] + prose(3, 2000), "en", "b", 2),
    ]
    df = spark.createDataFrame(rows, DOCS)
    clash = {c: F.lit("clash") for c in ("row", "doc", "f0", "key", "component", "size", "log_weight", "sample_key", "mix_doc", "mix_turn", "near_doc", "bpe_text", "h", "t", "part")}
    return df.withColumns(clash)


@pytest.fixture(scope="module")
def void(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, 0), (7, None, 1)], "doc_id bigint, quality int, toxic int")


# ---- common -----------------------------------------------------------------


def test_components_of_chains_and_stars(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(500, 501), (501, 500), (700, 700)]
    r.shuffle(edges)
    got = {x["node"]: x["component"] for x in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160)) and got[501] == got[500] == 500
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_kth_largest(spark):
    values = [random.Random(i).gauss(0, 100) for i in range(500)] + [5.0] * 50
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 100, 260, 550):
        assert common.kth_largest(df, "v", k, bins=16) == ordered[k - 1]
    assert common.kth_largest(df, "v", 551) is None


# ---- op1 --------------------------------------------------------------------


def test_water_filling(spark):
    s = spark.createDataFrame([("a", 10, 100.0), ("b", 100, 1.0), ("c", 1000, 1.0), ("d", 0, 5.0), ("e", 50, 0.0)], "k string, size bigint, weight double")
    got = {r["k"]: r["target"] for r in mixing.water_fill(s, 3.0).collect()}
    assert got["a"] == 30.0 and got["d"] == 0.0 and got["e"] == 0.0
    assert got["b"] == 300.0 and got["c"] == pytest.approx(1160 - 330)
    assert {r["target"] for r in mixing.water_fill(s.where("k in ('a', 'b')"), 3.0, total=1e9).collect()} == {30.0, 300.0}


def test_mix(spark, odd, void):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and mixing.mix(void).count() == 0
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in rows)
    again = mixing.mix(odd.repartition(7)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert set(mixing.take_mix(odd).columns) == set(odd.columns)
    assert mixing.take_mix(odd).where("doc <> 'clash' or mix_turn <> 'clash'").count() == 0


def test_mix_comes_near_targets(spark):
    docs = spark.createDataFrame([(i, prose(i, 1 + random.Random(i).randint(0, 200)), "en", f"s{i % 7}", 0) for i in range(700)], DOCS)
    got = mixing.mix(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(got) == 7 and all(abs(r["taken"] - r["target"]) <= 0.01 * r["target"] for r in got)


def test_small_sources_of_a_large_table_come_near_their_targets(spark):
    """1,000 sources of 12 documents, of 20 to 2,000 words, and one with a document of a third of its words."""
    r = random.Random(9)
    sizes = [(i, f"s{i % 1000:03}", int(20 * 100 ** r.random())) for i in range(12_000)]
    sizes += [(20_000 + i, "t", r.randint(50, 750)) for i in range(500)] + [(30_000, "t", 100_000)]
    docs = spark.createDataFrame(sizes, "doc_id bigint, source string, n int").select("doc_id", "source", F.expr("repeat('w ', n)").alias("text"))
    of = {i: (s, n) for i, s, n in sizes}
    taken, left, target = Counter(), defaultdict(list), {}
    for x in mixing.mix(docs).collect():
        source, n = of[x["doc"]]
        assert x["size"] == n and x["taken"] <= 3 * n
        taken[source] += x["taken"]
        target[source] = x["target"]
        if x["copies"] == int(x["target"] // x["source_size"]):
            left[source].append(n)
    assert len(target) == 1001
    for source, t in target.items():
        # the smallest document left would not bring the source nearer
        assert 2 * abs(t - taken[source]) <= min(left[source], default=float("inf")) + 1e-6
    assert abs(target["t"] - taken["t"]) < 50


# ---- op2, op3 ---------------------------------------------------------------


def fingerprint(text: str | None) -> int:
    import xxhash

    w = WORD.findall((text or "").translate(LOW))
    runs = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    votes = Counter(b for s in runs for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(runs))


def test_fingerprints_are_as_defined(spark, odd):
    got = odd.select("doc_id", "text").collect()
    mine = Counter((r["doc_id"], f"{fingerprint(r['text']):016x}") for r in got)
    theirs = simhash.fingerprints(odd).select("doc", simhash.hex16(F.col("f0"))).collect()
    assert Counter((r[0], r[1]) for r in theirs) == mine


def brute_classes(prints: list[int], docs: list[int], radius: int) -> list[int]:
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 62)
    for i, d in enumerate(docs):
        least[find(i)] = min(least[find(i)], d)
    return [least[find(i)] for i in range(len(docs))]


def test_classes_are_exact(spark):
    r, prints = random.Random(9), []
    for _ in range(60):
        p = r.getrandbits(64)
        for _ in range(r.randint(1, 8)):
            prints.append(p)
            for b in r.sample(range(64), r.randint(0, 3)):
                p ^= 1 << b
    near = r.getrandbits(64)
    prints += [near ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(enumerate(signed)), "doc bigint, f0 bigint")
    got = simhash.near_classes(df, radius=2, segments=2, bits=64)
    by = {row["f0"]: row["component"] for row in got.collect()}
    assert [by[s] for s in signed] == brute_classes(prints, list(range(len(prints))), 2)


def test_dedup_of_odd_tables(spark, odd, void):
    got = simhash.dedup_classes(odd).collect()
    assert len(got) == odd.count() and simhash.dedup_classes(void).count() == 0
    by = {r["doc"]: r["component"] for r in got}
    assert by[4] == by[5] == by[6] == 4 and by[9] == 1 and by[7] == 7
    kept = near_texts.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 2, 4, 7, 8, 10, 11, 12]
    assert kept.where("doc_id is null").count() == 1 and near_texts.drop_near_duplicates(void).count() == 0


def test_crowded_buckets_lose_no_link(spark):
    rng = random.Random(4)
    # 200 fingerprints that share 32 bits; the others differ from one another in few bits, many too far from the smallest
    prints = list({(rng.getrandbits(9) | rng.getrandbits(3) << 24) << 32 | 0x0F0F1234 for _ in range(200)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(enumerate(signed)), "doc long, f0 long")
    by = {r["f0"]: r["component"] for r in simhash.near_classes(df, radius=2, segments=2, bits=64).collect()}
    assert [by[s] for s in signed] == brute_classes(prints, list(range(len(prints))), 2)
    sparse = [0, 0b11, 0b1111, 0b111 << 20, 1 << 63, 7 << 61]
    found = simhash.common_points(spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(sparse)], "rep long, f0 long"), "f0")
    assert sorted(map(tuple, found.collect())) == [(1, 0), (2, 1), (4, 0), (5, 4)]


def test_crowds_are_linked_by_points_alone(spark, monkeypatch):
    rng = random.Random(5)
    # 150 fingerprints that share 32 bits: a bucket of all of them must not be opened, by pairs or in a second pass
    prints = list({(rng.getrandbits(5) | rng.getrandbits(5) << 20) << 32 | 0x0F0F1234 for _ in range(150)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    monkeypatch.setattr(simhash, "bucket_hits", None)
    got = simhash.near_classes(spark.createDataFrame(list(enumerate(signed)), "doc long, f0 long"), radius=2, segments=2, bits=64).collect()
    by = {r["f0"]: r["component"] for r in got}
    assert [by[s] for s in signed] == brute_classes(prints, list(range(len(prints))), 2)


def test_near_copies_by_jaccard(spark):
    rows, r = [], random.Random(3)
    for i in range(80):
        words = prose(1000 + i, 250).split()
        rows.append((2 * i, " ".join(words)))
        for at in r.sample(range(250), 3):
            words[at] = "changed"
        rows.append((2 * i + 1, " ".join(words)))
    kept = {x["doc_id"] for x in near_texts.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {2 * i for i in range(80)} <= kept and sum(2 * i + 1 in kept for i in range(80)) <= 4


def shingles(text: str) -> set[tuple[str, ...]]:
    words = WORD.findall(text.translate(LOW))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def jaccard(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def edited(seed: int, n: int, edits: int) -> tuple[str, str]:
    """A text and one where so many words, 7 apart or more, are others."""
    words = prose(seed, n).split()
    other = list(words)
    for at in random.Random(seed).sample(range(0, n, 7), edits):
        other[at] = f"other{at}"
    return " ".join(words), " ".join(other)


def test_every_pair_at_the_likeness_is_found(spark):
    pairs = [edited(5000 + i, 300, 5 + i % 3) for i in range(240)]
    likes = [jaccard(a, b) for a, b in pairs]
    assert min(likes) < 0.81 and sum(0.8 <= x < 0.86 for x in likes) > 150
    docs = spark.createDataFrame([(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)], "doc_id bigint, text string")
    kept = {x["doc_id"] for x in near_texts.drop_near_duplicates(docs).collect()}
    assert kept == {2 * i for i in range(240)} | {2 * i + 1 for i, x in enumerate(likes) if x < 0.8}


def test_repeated_ids_lose_no_text(spark):
    a, b, c, d = (prose(400 + i, 200) for i in range(4))
    rows = [(1, a), (9, a), (9, b), (20, c), (20, d), (20, d)]
    for n in (1, 3, 7):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(n)
        kept = near_texts.drop_near_duplicates(docs).collect()
        assert sorted(map(tuple, kept)) == sorted([(1, a), (9, b), (20, c), (20, d)])


def test_truncated_and_block_edits_are_found(spark):
    rows = []
    for i in range(60):
        words = prose(3000 + i, 400).split()
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(words[:335])), (3 * i + 2, " ".join(words[:190] + prose(6000 + i, 15).split() + words[200:]))]
    kept = {x["doc_id"] for x in near_texts.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {3 * i for i in range(60)} <= kept and len(kept) <= 62


def test_texts_below_the_likeness_stay(spark):
    pairs = [edited(7000 + i, 300, 8 + i % 4) for i in range(120)]
    assert all(0.6 < jaccard(a, b) < 0.8 for a, b in pairs)
    line = prose(1, 12).replace("\n", "") + "\n"
    pairs += [(line * 40 + prose(8000 + i, 60), line * 40 + prose(9000 + i, 60)) for i in range(10)]
    docs = spark.createDataFrame([(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)], "doc_id bigint, text string")
    assert near_texts.drop_near_duplicates(docs).count() == 260


@pytest.mark.parametrize("size, edits, cuts", [(120, (1, 6), [200, 200, 170]), (120, (3, 8), [200]), (1000, (3, 8), [200])])
def test_likeness_classes_of_a_crowd(spark, size, edits, cuts):
    base, r = prose(77, 200).split(), random.Random(6)
    texts = [prose(78, 40), ""]
    for _ in range(size):
        words = list(base)
        for at in r.sample(range(200), r.randint(*edits)):
            words[at] = f"w{r.random()}"
        texts.append(" ".join(words[: r.choice(cuts)]))
    least = list(range(len(texts)))

    def root(i: int) -> int:
        while least[i] != i:
            i = least[i]
        return i

    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = root(i), root(j)
                least[max(x, y)] = min(x, y)
    kept = {x["doc_id"] for x in near_texts.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    # links in a cloud of copies around the likeness are found by chance; nothing is dropped without one
    want = {root(i) for i in range(len(texts))}
    print(f"{len(texts) - len(want)} should go, {len(kept) - len(want)} of them stay")
    assert len(kept) >= len(want) and len(kept) - len(want) <= 0.1 * (len(texts) - len(want))
    # nothing goes but a text with a smaller one in its class
    assert all(root(i) != i for i in range(len(texts)) if i not in kept)


def test_radius_search_is_exact(spark):
    r, prints = random.Random(5), []
    for _ in range(40):
        p = r.getrandbits(64)
        prints += [p, p] + [p ^ sum(1 << b for b in r.sample(range(64), k)) for k in (1, 2, 3, 4)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {x["f0"]: x for x in fingerprints.within_radius(spark.createDataFrame(list(enumerate(signed)), "doc bigint, f0 bigint")).collect()}
    for i, (p, s) in enumerate(zip(prints, signed)):
        near = [q for j, q in enumerate(prints) if j != i and (p ^ q).bit_count() <= 3]
        assert got[s]["n_near"] == len(near) and got[s]["n_links"] == len({q for q in near if q != p})


def test_edits(spark, odd, void):
    got = {r["doc"]: r for r in fingerprints.compare_with_edits(odd).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in odd.where("doc_id is not null").collect()}
    ids = sorted(texts)
    assert sorted(got) == ids and fingerprints.compare_with_edits(void).count() == 0
    for a, b in zip(ids, ids[1:] + ids[:1]):
        t, k = texts[a], len(texts[a]) // 4
        assert got[a]["n_chars"] == len(t)
        assert got[a]["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + texts[b][:k]).encode()).hexdigest()
        assert got[a]["near_next"] == 1 - ((got[a]["f0"] ^ got[b]["f0"]) & (1 << 64) - 1).bit_count() / 64
    assert got[1]["f0"] == got[9]["f0"] and got[1]["near_edited"] > 0.65 > got[1]["near_next"]
    alone = fingerprints.compare_with_edits(odd.where("doc_id = 2")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


# ---- tokenizers -------------------------------------------------------------


def texts_of_all_kinds() -> list[str]:
    r, kinds = random.Random(8), "abcXYZ  \n\t.,'!-é ßΣ中文🙂́\xa0\x85\x1f0123456789"
    out = ["".join(r.choice(kinds) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    return out + ["<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "foo   <|endoftext|>", "it's I'll 's x's", "a" * 500, " " * 300 + "x", "x ́y", "ab\n\ncd \n e", "\x00 a b", "İstanbul ΑΣ ΣΑΣ"]


@pytest.fixture(scope="module")
def many(spark):
    return spark.createDataFrame(list(enumerate(texts_of_all_kinds())), "doc_id bigint, text string")


def tiktoken_encoding():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_word_caches_keep_the_ids():
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    cache = token_store.tokenizer(path, True)
    r = random.Random(4)
    odd = ["".join(r.choice("abYZéÀß ,'!\n\t12%s&st") for _ in range(r.randint(0, 40))) for _ in range(3000)]
    for t in [*texts_of_all_kinds(), *odd, "don't!'s it's' 's", "a,\tb", "×÷ªº µ", "naïve—x", "<|startoftext|> A"]:
        assert np.frombuffer(cache.ids(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_starts_go_by_file_number(spark):
    rows = [(f"part-{n}-x.parquet", i, 1 + n % 3) for n in (99998, 99999, 100000, 100001) for i in range(2)]
    got = token_store.starts(spark.createDataFrame(rows, "file string, row long, n_tokens int")).collect()
    at, start = {(r["file"], r["row"]): r["start"] for r in got}, 0
    for file, row, n in rows:
        assert at[file, row] == start
        start += n


def test_pieces_are_the_text():
    for t in texts_of_all_kinds():
        assert "".join(pieces.pieces(t)) == t


def test_bpe_is_what_the_library_gives(spark, many, odd, void):
    enc = tiktoken_encoding()
    how = {"path": queries.vocabulary("byte_bpe_multi_50k.tiktoken"), "pattern": queries.word_pattern()}
    for r in bpe.encode_texts(many, **how).collect():
        text = texts_of_all_kinds()[r["doc_id"]]
        ids = enc.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    got = bpe.encode_texts(odd, **how, with_ids=False)
    assert "text" not in got.columns and "bpe_text" in got.columns
    want = Counter((r["doc_id"], len(enc.encode_ordinary(r["text"] or "")), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in odd.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in got.collect()) == want
    assert bpe.encode_texts(void, **how).count() == 0


def test_prefix_table_appends_and_edits():
    enc = bpe.PrefixBPE.load(queries.vocabulary("byte_bpe_multi_50k.tiktoken"))
    r = random.Random(2)
    for _ in range(60):
        data = "".join(r.choice("theraniongs") for _ in range(r.randint(0, 25))).encode()
        table = bpe.EditableText(enc, data)
        more = "".join(r.choice("theran") for _ in range(r.randint(0, 9))).encode()
        table.append(more)
        assert table.tokens() == enc.merged(data + more) and enc.decode(table.tokens()) == data + more
        a, b = sorted((r.randint(0, len(table.data)), r.randint(0, len(table.data))))
        table.replace(a, b, b"ing")
        assert table.tokens() == enc.merged(table.data)


def test_counts_are_what_the_library_gives(spark, many, odd, void):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    count = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
    texts = texts_of_all_kinds()
    assert all(r["n_tokens"] == count(texts[r["doc"]]) for r in token_counts.count_tokens(many, path=path).collect())
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), count(r["text"])) for r in odd.collect())
    got = token_counts.count_tokens(odd, path=path, chunk=1000, overlap=16).collect()
    assert Counter((r["doc"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    assert token_counts.count_tokens(void, path=path).count() == 0


def test_chunks_of_hard_texts(spark):
    from tokenizers import Tokenizer

    path, r = queries.vocabulary("byte_bpe_50k.json"), random.Random(6)
    tok = Tokenizer.from_file(path)
    hard = ["".join(r.choice(k) for _ in range(700)) for k in ("a", "ab ", " ", "  \n", "中文", "1 ", "é'", "a<|endoftext|> ", "́a") for _ in range(4)]
    df = spark.createDataFrame(list(enumerate(hard)), "doc_id bigint, text string")
    for r_ in token_counts.count_tokens(df, path=path, chunk=64, overlap=8).collect():
        assert r_["n_tokens"] == len(tok.encode(hard[r_["doc"]], add_special_tokens=False).ids), hard[r_["doc"]][:80]


def test_sentencepiece_counts(spark, many):
    import sentencepiece

    path = queries.vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = texts_of_all_kinds()
    assert all(r["n_tokens"] == len(sp.encode(texts[r["doc"]])) for r in token_counts.count_tokens(many.limit(300), path=path).collect())


def test_token_files(spark, many, odd, void, tmp_path):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for n, (df, texts) in enumerate(((many, dict(enumerate(texts_of_all_kinds()))), (odd, None), (void, {}))):
        to = f"file://{tmp_path}/t{n}"
        token_store.write_tokens(df, to, path=path, word_level=n != 1)
        tokens = token_store.read_tokens(spark, to)
        got = token_store.digests(tokens).join(token_store.starts(tokens), ["file", "row"]).collect()
        assert len(got) == df.count()
        if texts is None:
            assert sum(r["n_tokens"] for r in got) == max(r["start"] + r["n_tokens"] for r in got)
            continue
        start = 0
        for r in sorted(got, key=lambda r: r["doc"]):
            ids = tok.encode(texts[r["doc"]], add_special_tokens=False).ids + [2]
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)


# ---- op6 --------------------------------------------------------------------


def test_nearest(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 16))
    x[1000:2000] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0, 2.0]), (5200, [None] * 16), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("rep", F.lit("clash"))
    got = defaultdict(list)
    for row in ann.search(df, df.where("vec_id % 50 = 0"), sample=1024, leaf=32, probes=24).orderBy("query", "rank").collect():
        got[row["query"]].append((row["neighbour"], row["score"]))
    norms, hits = np.linalg.norm(x, axis=1), 0
    assert sorted(got) == list(range(0, 3000, 50))
    for q, found in got.items():
        s = x @ x[q] / norms / norms[q]
        s[q] = -9
        best = np.lexsort((np.arange(3000), -np.round(s, 12)))[:5]
        hits += len(set(best) & {n for n, _ in found})
        assert len(found) == 5 and all(abs(s[n] - v) < 1e-12 for n, v in found) and [v for _, v in found] == sorted((v for _, v in found), reverse=True)
        if 1000 <= q < 2000:
            assert [n for n, _ in found] == [7, 1000, 1001, 1002, 1003] if q != 1000 else [7, 1001, 1002, 1003, 1004]
    assert hits >= 0.9 * 5 * len(got)
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r)[:3] for r in ann.search(two, two.where("vec_id = 0")).collect()] == [(0, 1, 1)]


def test_centroid_graph_finds_the_nearest():
    x = np.random.default_rng(3).normal(size=(600, 12))
    graph = ann.CentroidGraph(x)
    good = 0
    for q in np.random.default_rng(4).normal(size=(50, 12)):
        found, far = graph.search(q, 40)
        assert list(far) == sorted(far)
        good += np.argmin(((x - q) ** 2).sum(axis=1)) == found[0]
    assert good >= 48


# ---- op7 --------------------------------------------------------------------


def test_url_filters_as_of(spark):
    entries = spark.createDataFrame([
        ("l1", "Example.com", "2024-01-10", "add"), ("l1", "example.com", "2024-02-10", "remove"), ("l1", "example.com", "2024-03-10", "add"), ("l1", "example.com", "2024-03-10", "remove"),
        ("l2", "a.example.com/x", "2024-01-01", "add"), ("l2", None, "2024-01-01", "add"), ("l2", "b.org", "2024-01-01", "ban"),
    ], "list string, pattern string, day string, action string").withColumn("day", F.col("day").cast("date"))
    pages = [(1, "http://a.example.com/x/y?q=1", "2024-01-10"), (2, "https://u:p@EXAMPLE.com.:8080/", "2024-02-09"), (3, "http://example.com", "2024-02-10"), (4, "http://notexample.com/x", "2024-01-15"),
             (5, None, "2024-01-15"), (6, "no url", "2024-01-15"), (7, "http://a.example.com/xy", None), (8, "http://a.example.com/x", "2023-12-31"), (8, "http://a.example.com/x", "2024-03-11")]
    caps = spark.createDataFrame(pages, "page_id int, url string, day string").withColumn("day", F.col("day").cast("date")).withColumn("host", F.lit("clash"))
    got = sorted((r["id"], r["blocked"], r["n_lists"], r["pattern"]) for r in url_filters.evaluate(caps, entries).collect() if r["id"] != 8)
    assert got == [(1, True, 2, "a.example.com/x"), (2, True, 1, "example.com"), (3, False, 0, None), (4, False, 0, None), (5, False, 0, None), (6, False, 0, None), (7, False, 0, None)]
    assert sorted(r["blocked"] for r in url_filters.evaluate(caps.where("page_id = 8"), entries).collect()) == [False, True]
    assert url_filters.evaluate(caps.limit(0), entries.limit(0)).count() == 0


def test_url_filters_keep_the_case_of_paths(spark):
    day = F.lit("2024-01-01").cast("date")
    entries = spark.createDataFrame([("l1", "H.org/Ads", "add"), ("l1", "g.org/ads", "add")], "list string, pattern string, action string").withColumn("day", day)
    urls = ["http://h.org/Ads/1", "http://H.ORG/Ads", "http://h.org/ads/1", "http://g.org/Ads", "http://G.org/ads/X"]
    caps = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("day", day)
    got = {r["id"]: r["pattern"] for r in url_filters.evaluate(caps, entries).collect()}
    assert got == {0: "h.org/Ads", 1: "h.org/Ads", 2: None, 3: None, 4: "g.org/ads"}


# ---- op8 --------------------------------------------------------------------


def test_quality_parts_good_from_junk(spark):
    good = [(i, prose(i, 120), 1) for i in range(300)]
    junk = [(1000 + i, prose(i, 100).upper().replace(" ", "!! "), 0) for i in range(50)] + [(2000 + i, "spam " * 90, 0) for i in range(50)]
    docs = spark.createDataFrame(good + junk, "doc_id bigint, text string, q int").withColumn("log_weight", F.lit("clash"))
    known = docs.where("doc_id % 2 = 0").select("doc_id", F.col("q").alias("quality"))
    got = quality.resample(docs, known).join(docs.select(F.col("doc_id").alias("doc"), "q"), "doc").where("doc % 2 = 1").groupBy("q").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    rates = {r["q"]: r["kept"] for r in got}
    assert rates[1] >= 0.98 and rates[0] <= 0.02
    assert quality.resample(docs, known, k=17).where("kept").count() == 17
    kept = quality.keep_quality(docs, known)
    assert kept.columns == docs.columns and kept.where("log_weight <> 'clash'").count() == 0


def test_quality_of_odd_tables(spark, odd, void, labels):
    assert quality.resample(odd, labels).count() == odd.count()
    assert quality.resample(odd, labels.limit(0)).where("not kept").count() == 0
    assert quality.resample(void, labels).count() == 0 and quality.keep_quality(void, labels).count() == 0


# ---- op9 --------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}\r\nX: y", f"<p>{i % 5} é</p>" * 40) for i in range(200)] + [(300, None, None), (301, "u", ""), (None, "u", "lone"), (302, "u", "\r\n\r\nWARC/1.1\r\n"), (303, "u", "z" * 300_000), (302, "u", "\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("key", F.lit("clash")).withColumn("refers_to", F.lit("clash"))
    for least in (0, 10):
        to = f"file://{tmp_path}/w{least}"
        warc.write_archives(pages, to, least_bytes=least)
        got = warc.read_records(warc.read_index(spark, to), to, gap=100, most=2000, with_payload=True).collect()
        assert len(got) == len(rows)
        head = {}
        for i, _, h in rows:
            if i is not None:
                head[h or ""] = max(head.get(h or "", -1), i)
        for r in got:
            i = None if r["page"] is None else int(r["page"])
            body = next(h for j, _, h in rows if j == i) or ""
            assert r["payload_bytes"] == len(body.encode()) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()
            again = i is not None and len(body.encode()) >= least and head[body] != i
            assert r["record_type"] == ("revisit" if again else "response") and r["refers_to"] == (str(head[body]) if again else None)
            assert r["payload"] == (None if again else body.encode())
        some = warc.read_records(warc.read_index(spark, to).where("url = 'u'"), to)
        assert some.count() == 5
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_records(warc.read_index(spark, f"file://{tmp_path}/none"), f"file://{tmp_path}/none").count() == 0


def test_warc_ids_of_any_kind_come_back(spark, tmp_path):
    ids = [None, "", "null", "a\r\nWARC-Type: x", "b>\n", "é %41 \x00", "same", "zame"]
    pages = spark.createDataFrame([(x, "u", "equal" if x in ("same", "zame") else f"<p>{i}") for i, x in enumerate(ids)], "page_id string, url string, html string")
    warc.write_archives(pages, f"file://{tmp_path}/ids")
    got = warc.read_records(warc.read_index(spark, f"file://{tmp_path}/ids"), f"file://{tmp_path}/ids").collect()
    assert Counter(r["page"] for r in got) == Counter(ids)
    assert {r["page"]: r["refers_to"] for r in got if r["record_type"] == "revisit"} == {"same": "zame"}


# ---- pipeline ---------------------------------------------------------------


def test_pipeline_stages(spark, odd, void, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, void):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            docs = stage(spark, docs, str(tmp_path))
            assert i == 3 or docs.columns == columns
            docs = common.kept(docs, "stage")
        assert {"ids", "n_tokens"} <= set(docs.columns)


def test_pipeline_over_a_table(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 50 and {"doc_id", "ids"} <= set(got.columns)


def cloud(size: int, edits: tuple[int, int], cuts: list[int], seed: int) -> list[str]:
    """Texts of one base whose likeness to each other lies around 0.8."""
    base, r, texts = prose(77, 200).split(), random.Random(seed), []
    for _ in range(size):
        words = list(base)
        for at in r.sample(range(200), r.randint(*edits)):
            words[at] = f"w{r.random()}"
        texts.append(" ".join(words[: r.choice(cuts)]))
    return texts


def alike(texts: list[str]) -> list[int]:
    """The place of the first text of each text's class, from all pairs."""
    sets, least = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                x, y = least[i], least[j]
                least = [min(x, y) if k in (x, y) else k for k in least] if x != y else least
    return least


def test_classes_of_a_crowd_lose_no_link(spark):
    texts = cloud(1000, (3, 8), [200], 6) + [prose(78, 40), ""]
    kept = {x["doc_id"] for x in near_texts.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert kept == set(alike(texts))


@pytest.mark.parametrize("few, block", [(32, 131_072), (4, 9_000), (10_000, 131_072)])
def test_missed_links_are_all_links(spark, monkeypatch, few, block):
    monkeypatch.setattr(near_texts, "FEW", few)
    monkeypatch.setattr(near_texts, "BLOCK", block)
    passage = prose(79, 80)
    texts = cloud(300, (1, 7), [200, 200, 170], 8) + [f"{passage} {prose(900 + i, 15)}" for i in range(60)] + [t for i in range(30) for t in edited(5000 + i, 300, 5 + i % 3)]
    texts += ["one", "one two", "one two three four five", "one two three four five six", prose(80, 9000), prose(80, 8500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").selectExpr("id", "id as node", "text")
    signed = near_texts.signatures(rows, near_texts.Signing(5, 6, 20, 1.5), 0.8).cache()
    want = alike(texts)
    # every text for itself, then a class that fills blocks of its own: the even ones of the first text's class
    for c in (list(range(len(texts))), [want[i] if want[i] == 0 and i % 2 == 0 else i for i in range(len(texts))]):
        classes = spark.createDataFrame(list(enumerate(c)), "node bigint, c bigint")
        links = [tuple(x) for x in near_texts.missed_links(signed.join(classes, "node"), rows, 5, 0.8).collect()]
        assert all(want[a] == want[b] for a, b in links)
        joined = list(c)
        for a, b in links:
            x, y = joined[a], joined[b]
            joined = [min(x, y) if k in (x, y) else k for k in joined]
        assert joined == want


def test_workers_let_go_of_other_operators_caches():
    """A worker that has encoded texts holds its encoder for the next task of the kind, and nothing of it for near copies."""

    class Here:
        """A table of one batch whose tasks run in this process."""

        def select(self, *columns):
            return self

        def mapInArrow(self, run, form):  # noqa: N802
            return list(run(iter([pa.RecordBatch.from_pydict({"node": [1], "text": [prose(81, 50)]})])))

    path, pattern = queries.vocabulary("byte_bpe_multi_50k.tiktoken"), queries.word_pattern()
    cache = weakref.ref(bpe.encoder(path, pattern)[1])
    assert bpe.encoder(path, pattern)[1] is cache()
    assert near_texts.hash_sets(Here(), 5)[0].num_rows == 1
    gc.collect()
    assert cache() is None


@pytest.mark.parametrize("bits", [3, 9, 52])
def test_meetings_deal_rows_once_whatever_the_bits(spark, bits):
    rng = random.Random(bits)
    base = [rng.getrandbits(bits) for _ in range(12)]
    rows = []
    for node in range(90):
        own = [None if rng.random() < 0.1 else rng.choice(base) ^ (1 << rng.randrange(bits) if rng.random() < 0.6 else 0) for _ in range(5)]
        rows.append((node % 3, node, node // 2 if node < 20 else node, rng.randrange(3), own))
    table = spark.createDataFrame(rows, "head bigint, node bigint, c bigint, x bigint, own array<bigint>")
    how = near_texts.Signing(5, 5, bits, 1.5)
    for among in ((), ("head",)):
        buckets: dict = {}
        for head, node, c, x, own in rows:
            for s, v in enumerate(own):
                for p in range(bits) if v is not None else ():
                    buckets.setdefault((head if among else None, s, p, v & ~(1 << p)), []).append((x, node, c))
        want = {(node, min(b)[1], k[1]) for k, b in buckets.items() if len({c for *_, c in b}) > 1 for _, node, _ in b if node != min(b)[1]}
        found = near_texts.meetings(table, how, *among)
        assert sorted(map(tuple, found.collect())) == sorted(want) and want
        # one exchange by what rows agree in, one for distinct pairs
        assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2


def test_suspects_and_prefixes_deal_rows_once(spark):
    rows = spark.createDataFrame([(0, 0, 5, [1, 2, 3]), (1, 1, 5, [1, 2, 9])], "node bigint, c bigint, n int, lead array<int>")
    assert near_texts.suspects(rows, 0.8).count() == 2
    sets = spark.createDataFrame([(0, 0, np.arange(5, dtype="<u4").tobytes()), (1, 1, np.arange(6, dtype="<u4").tobytes())], "node bigint, c bigint, hashes binary")
    assert {x["node"] for x in near_texts.prefixes(sets, 0.8).collect()} == {0, 1}
    for df in (near_texts.suspects(rows, 0.8), near_texts.prefixes(sets, 0.8)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(token#") == 1


def test_encode_looks_at_few_prefixes_and_gives_what_the_table_gives(monkeypatch):
    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            Counted.asked += 1
            return dict.get(self, key, default)

    rng = random.Random(82)
    real = bpe.PrefixBPE.load(queries.vocabulary("byte_bpe_multi_50k.tiktoken"))
    # a small vocabulary in which the longest token often leads nowhere
    parts = [bytes([b]) for b in b"abc"]
    while len(parts) < 40:
        if (new := rng.choice(parts) + rng.choice(parts)) not in parts and len(new) < 9:
            parts.append(new)
    small = bpe.PrefixBPE({p: i for i, p in enumerate(parts)})
    for coder, signs in ((real, " abcdefghijklmnopqrstuvwxyzéß日"), (small, "abc")):
        for _ in range(400):
            data = "".join(rng.choices(signs, k=rng.randrange(40))).encode()
            want = [coder.ranks[data]] if data in coder.ranks else coder.tokens(coder.extend(data, []))
            assert coder.encode(data) == want
            assert data in coder.ranks or want == coder.merged(data)
    with pytest.raises(ValueError):
        small.encode(b"abdc")
    data = b"understandingcommunicationinternational" * 3
    assert real.encode(data) == real.tokens(real.extend(data, []))  # pairs are known from here on
    monkeypatch.setattr(real, "ranks", Counted(real.ranks))
    assert real.encode(data) and Counted.asked < len(data) * min(len(data), real.longest) / 4


def test_plain_texts_are_neither_searched_nor_renamed(monkeypatch):
    from quorumlake.llm.pieces import WordCache
    from tokenizers import Tokenizer

    class Never:
        def search(self, text):
            assert not text.isascii()
            return None

    tok = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    words = WordCache(tok)
    plain = "It isn't so: words, 12 of them (un-\nknown)!! zqxvk zqxvk. WORDS"
    latin = "Élan de l'été, cœur n'est pas là; straße zqxvké."
    odd = "a <|endoftext|> b"
    want = {t: words.whole(t) for t in (plain, latin, odd, "")}
    assert all(words.ids(t) == want[t] for t in want)
    fresh = WordCache(tok)
    fresh.names = None
    monkeypatch.setattr(pieces, "_UNPLAIN", Never())
    assert fresh.ids(plain) == want[plain]
