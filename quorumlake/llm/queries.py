"""The registered queries of the corpus operators: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, language, mixing, negatives, quality, token_counts, token_store, url_filters, warc, whitening
from .common import scratch
from .fingerprints import compare_with_edits
from .simhash import dedup_classes, hex16


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies on this machine; all machines have the same."""
    import public_tokenizers

    return public_tokenizers.path(name)


def word_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: fingerprint and class of documents linked at two or fewer differing bits."""
    found = dedup_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), hex16(F.col("f0")).alias("fingerprint"), F.col("component").alias("component_id"), F.col("size").alias("copies"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: fingerprints of it and its edited text, likenesses, and what lies within three bits."""
    found = compare_with_edits(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("doc").alias("doc_id"), "n_chars", "edited_sha256", hex16(F.col("f0")).alias("fingerprint"), hex16(F.col("e0")).alias("edited_fingerprint"),
        "near_edited", "near_next", "class_id", "n_links", "n_near",
    )


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: how many words of it the mix takes, and its source's size and target."""
    return mixing.mix(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, from the files: where its ids start, how many there are, and their checksum."""
    docs, to = table(spark, sf_dir, "documents"), scratch(spark, "tokens")
    token_store.write_tokens(docs, to, path=vocabulary("word_bpe_49k.json"), end_id=2, word_level=True)
    tokens = token_store.read_tokens(spark, to, docs.schema["doc_id"].dataType.simpleString())
    got = token_store.digests(tokens).join(token_store.starts(tokens), ["file", "row"])
    return got.select(F.col("doc").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: bytes, tokens, and whether they are over the limit."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), path=vocabulary("byte_bpe_50k.json"), limit=1024).withColumnRenamed("doc", "doc_id")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for each vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    found = ann.search(vectors, vectors.where("vec_id % 50 = 0").select("vec_id"))
    return found.select(F.col("query").alias("query_id"), "rank", F.col("neighbour").alias("vec_id"), "score")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each page: which dated list entries held its URL on the day it was fetched."""
    pages = table(spark, sf_dir, "pages")
    return url_filters.evaluate(url_filters.dated_captures(pages), url_filters.dated_lists(pages)).withColumnsRenamed({"id": "page_id"}).withColumns({"day": F.col("day").cast("string"), "since": F.col("since").cast("string")})


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its importance weight and whether the sample keeps it."""
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("doc", "doc_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each page, as read back from archives."""
    pages, to = table(spark, sf_dir, "pages"), scratch(spark, "warc")
    warc.write_archives(pages, to)
    kind = pages.schema["page_id"].dataType
    found = warc.read_records(warc.read_index(spark, to), to)
    return found.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its ids and what they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_texts(docs, path=vocabulary("byte_bpe_multi_50k.tiktoken"), pattern=word_pattern(), with_ids=False)


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its language as learned from documents whose id's checksum is not 2 modulo 4.

    A null id counts as not held out, and nothing is learned from it.
    """
    docs = table(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    found = language.identify(docs, docs.where(part != 2).select("lang", "text"))
    own = F.crc32(F.col("doc").cast("string").cast("binary")) % 4
    return found.select(F.col("doc").alias("doc_id"), own.eqNullSafe(2).alias("held_out"), "lang_pred", "score", "bits")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each fitted vector and component: its whitened coordinate and what certifies it."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8).withColumnRenamed("id", "vec_id")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five hard negatives for each anchor, a row whose id is divisible by 100, and each of its positives."""
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    found = negatives.mine(rows, rows.where("vec_id % 100 = 0").select("vec_id"))
    return found.withColumnsRenamed({"anchor": "anchor_id", "positive": "positive_id", "negative": "negative_id"})


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_mixing": op1_mixing, "op2_simhash_dedup": op2_simhash_dedup, "op3_fingerprints": op3_fingerprints, "op4_token_output": op4_token_output,
    "op5_token_counts": op5_token_counts, "op6_nearest": op6_nearest, "op7_url_filters": op7_url_filters, "op8_quality": op8_quality,
    "op9_warc": op9_warc, "op10_bpe": op10_bpe, "op11_language": op11_language, "op12_whitening": op12_whitening, "op13_negatives": op13_negatives,
}

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS head, sha1(body) AS hex FROM p)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{_ALPHABET}',
    ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM q"""

NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5"""

ORACLES: dict[str, str] = {"op13_negatives": NEGATIVES_SQL, "op1_mixing": mixing.oracle(), "op7_url_filters": url_filters.ORACLE, "op9_warc": WARC_SQL}
