"""Operator 5: exact token counts, with huge documents encoded in overlapping chunks that are spliced where they agree."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import Window as W

from .common import cut, kept, with_fields
from .pieces import PieceCache, pieces

_loaded: dict = {}


def counter(path: str) -> tuple[object, PieceCache]:
    """The tokenizer of this Python worker and its cache of token counts of pieces."""
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            tok = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = tok, None
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            _loaded[path] = tok, PieceCache(lambda some: [len(e) for e in tok.encode_batch_fast(some, add_special_tokens=False)])
    return _loaded[path]


def marks(tok, text: str, zones: list[tuple[int, int]]) -> tuple[int, list[list[tuple[int, int]]]]:
    """The tokens of a text and, for each zone, the places in it where one match of the word pattern ends and the next
    begins, each with the tokens before it. The text is encoded with offsets; places are counted in characters."""
    enc = tok.encode(text, add_special_tokens=False)
    words, offsets = enc.word_ids, enc.offsets
    ends: list[list[tuple[int, int]]] = [[] for _ in zones]
    for i in range(1, len(offsets)):
        # between two matches, not inside one; a special token has no number of its own
        if words[i] != words[i - 1] or words[i] is None:
            place = offsets[i][0]
            if place == offsets[i - 1][1]:
                for z, (low, high) in enumerate(zones):
                    if low <= place < high:
                        ends[z].append((place, i))
    return len(offsets), ends


def count_tokens(docs: DataFrame, *, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, chunk: int = 32_768, overlap: int = 512) -> DataFrame:
    """Operator 5. (doc, n_bytes, n_tokens, over_limit): a row for each row of docs, counts as the library gives them.

    No begin, end or added special tokens; strings of special tokens inside texts count as the library's default has
    it; no truncation. Texts of up to `chunk` characters are encoded where they lie. Longer ones become chunks, each
    with `overlap` characters of the next, that are dealt over the cluster and encoded with offsets. A place where both
    neighbours end a match of the word pattern is a stable boundary: matching looks back at nothing, so from there on
    both agree with the whole text. The first such place splices them. Where a seam has none, its document is encoded
    again with an overlap four times as wide, until all seams are spliced or the document is one chunk.
    A sentencepiece model (.model), which joins across blanks, encodes each document whole.

    Null and empty texts have 0 bytes and 0 tokens. Null and repeated ids keep their rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc"), text.alias("text"))
    chunked = not path.endswith(".model")
    short = base.where(F.length("text") <= chunk) if chunked else base
    out = short.mapInArrow(_whole(path, base), with_fields(base.drop("text"), "n_bytes long, n_tokens long"))
    if chunked:
        # written once, so that a row keeps its number whichever executors are lost
        long = kept(base.where(F.length("text") > chunk).select("doc", F.monotonically_increasing_id().alias("row"), "text"), "long")
        out = out.unionAll(_spliced(long, path, chunk, overlap))
    return out.select("doc", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _whole(path: str, base: DataFrame):
    names = [*base.drop("text").columns, "n_bytes", "n_tokens"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        tok, cache = counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(part.num_columns - 1)
                listed = texts.to_pylist()
                if cache is None:
                    counts = [len(x) for x in tok.encode(listed, num_threads=1)]
                else:
                    cuts = [pieces(t) for t in listed]
                    cache.fill(cuts)
                    counts = [sum(map(cache.__getitem__, c)) for c in cuts]
                sizes = pc.cast(pc.binary_length(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], sizes, pa.array(counts, pa.int64())], names=names)

    return run


_MARKS = "array<struct<place:int,tokens:int>>"


def _spliced(long: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(doc, n_bytes, n_tokens) of texts of more than a chunk."""
    schema = T.StructType.fromDDL(f"row long, doc {long.schema['doc'].dataType.simpleString()}, i int, n int, n_bytes long, tokens int, head {_MARKS}, tail {_MARKS}")
    done = None
    while True:
        width = max(chunk, 2 * overlap)
        parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
        rows = long.select("row", "doc", parts.alias("parts")).select(
            "row", "doc", F.size("parts").alias("n"),
            F.posexplode(F.transform("parts", lambda p, i: F.struct(p.alias("own"), F.concat(p, F.coalesce(F.substring(F.get(F.col("parts"), i + 1), 1, overlap), F.lit(""))).alias("text")))).alias("i", "part"),
        ).select("row", "doc", "i", "n", F.octet_length("part.own").cast("long").alias("n_bytes"), F.length("part.own").alias("own"), "part.text")
        got = cut(rows.repartition("row", "i").mapInArrow(_chunks(path, schema, overlap), schema))
        order = W.partitionBy("row").orderBy("i")
        met = got.withColumn("next_head", F.lead("head").over(order))
        met = met.withColumn("splice", F.get(F.filter("tail", lambda t: F.exists("next_head", lambda h: h["place"] == t["place"])), 0))
        met = met.withColumn("from_place", F.lag("splice.place").over(order))
        begun = F.coalesce(F.get(F.filter("head", lambda h: h["place"] == F.col("from_place")), 0)["tokens"], F.lit(0))
        ended = F.when(F.col("i") == F.col("n") - 1, F.col("tokens")).otherwise(F.col("splice.tokens"))
        whole = met.groupBy("row", "doc").agg(
            F.sum("n_bytes").alias("n_bytes"), F.sum((ended - begun).cast("long")).alias("n_tokens"),
            F.bool_and((F.col("i") == F.col("n") - 1) | F.col("splice").isNotNull()).alias("good"),
        )
        whole = cut(whole)
        good = whole.where("good").select("doc", "n_bytes", "n_tokens")
        done = good if done is None else done.unionAll(good)
        bad = whole.where("not good").select("row")
        if bad.isEmpty():
            return done
        long = long.join(bad, "row", "left_semi")
        overlap *= 4


def _chunks(path: str, schema: T.StructType, overlap: int):
    form = to_arrow_schema(schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tok, _ = counter(path)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                # a match that ends within two characters of the cut may go on behind it
                end = len(r["text"]) - 2
                tokens, (head, tail) = marks(tok, r["text"], [(1, overlap if r["i"] else 0), (r["own"] + 1, end if r["i"] < r["n"] - 1 else 0)])
                listed = [[{"place": p - shift, "tokens": t} for p, t in zone] for zone, shift in ((head, 0), (tail, r["own"]))]
                out.append({"row": r["row"], "doc": r["doc"], "i": r["i"], "n": r["n"], "n_bytes": r["n_bytes"], "tokens": tokens, "head": listed[0], "tail": listed[1]})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=form)

    return run
