"""The registered queries of the operators in this folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.llm import (backoff_lm, binary_tokens, decontam, exact_dedup, hard_negatives, host_graph, jaccard_join, language_id,
                            packing, phrase_mining, suffix_dedup, topk_search, warc)
from threadloom.llm.common import in_fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_binary_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as framed binary files and read back from them."""
    docs = table(spark, sf_dir, "documents")
    folder, _ = binary_tokens.write_records(docs, vocabulary("word_bpe_49k.json"))
    return binary_tokens.record_summary(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back from the archives."""
    folder, _ = warc.write_warc(warc.mark_revisits(table(spark, sf_dir, "pages")))
    return warc.read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op8_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS response FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT d.page_id, payload_bytes, d.payload_digest,
  CASE WHEN g.response IS NULL OR g.response = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.response <> d.page_id THEN g.response END AS refers_to
FROM d LEFT JOIN g ON d.payload_digest = g.payload_digest AND d.payload_bytes >= 1000
"""


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token pieces of every document with their places in sequences of 2048."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json")).drop("text_key")


URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict by rule, else by its host's place in the link graph."""
    return host_graph.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


ORACLES["op7_url_filter"] = host_graph.judge_urls_sql(URL_RULES)


@query
def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every vector whose id is divisible by 50, by integer inner product."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("id"), topk_search.quantised(F.col("embedding")).alias("vector"))
    return topk_search.exact_top_k(rows, F.col("id") % 50 == 0)


ORACLES["op6_topk_search"] = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.n <> c.n)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; a quarter of the ids is never learned from."""
    docs = table(spark, sf_dir, "documents")
    held_out = in_fold(F.col("doc_id"), 4, 2)
    net = language_id.train(docs.filter(~held_out))
    return language_id.identify(docs.select("doc_id", "text", held_out.alias("held_out")), net).select(
        "doc_id", "held_out", "lang_pred", "score")


@query
def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document under a model of order 3 of six sevenths of them."""
    return backoff_lm.score_texts(table(spark, sf_dir, "documents"), in_fold(F.col("doc_id"), 7, 2), order=3)


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shingle count and the smallest document it is linked to."""
    return jaccard_join.linked_documents(table(spark, sf_dir, "documents")).drop("text_key")


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a copy of a benchmark item, edited or not, with the alignment's score."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontam.find_leaks(docs, items).drop("passage")


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that lie in a 400-byte string which also starts elsewhere."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), 400, with_text=False).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), "spans")


@query
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the equal document that stays, the size of its group and the digest of its text."""
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


ORACLES["op11_exact_dedup"] = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


@query
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two to five words of each language, with their counts."""
    return phrase_mining.mine_phrases(table(spark, sf_dir, "documents"))


ORACLES["op12_phrases"] = phrase_mining.phrases_sql()


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each of the five best same-label rows of every anchor, three other-label rows that score nearly as high."""
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("id"), changed.alias("label"),
        topk_search.quantised(F.col("embedding")).alias("vector"), (F.col("vec_id") % 50 == 0).alias("is_anchor"))
    return hard_negatives.hard_negatives(rows)


ORACLES["op13_hard_negatives"] = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS e,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (SELECT a.n, a.vec_id AS anchor_id, c.n AS other, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.n <> c.n),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS nth FROM s WHERE same) WHERE nth <= 5),
m AS (SELECT p.n, p.nth, p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.n, p.nth ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.n = p.n AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM m WHERE rank <= 3
"""
