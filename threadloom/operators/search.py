"""Ranking of candidates: multi-query search, fusion, two-phase scoring, funnels.

Queries come as a table, so any number of them costs one job. The cheap first phase keeps
a bounded number of candidates per query (the rerank depth); everything costly runs on
those rows only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.constants import HYBRID_LEGS, LEG_WEIGHTS
from threadloom.functions import vectors as V
from threadloom.functions.text import squash
from threadloom.operators.lexical import bm25_by_field, bm25_hits, bm25_pairs, document_fields, prepare
from threadloom.operators.nearest import nearest, pair_scores
from threadloom.operators.ranking import best_per_key, top_k, top_k_per_group
from threadloom.runtime import spread, stored

# fixed values: depths and limits of the searches
RERANK_DEPTH = 1000
ANN_HITS = 5000
HITS = 700
RERANK_QUERIES = 100_000  # query texts that travel to a task at once
RERANK_TEXTS = 512  # texts that a scorer gets at once
LEG_HITS = 10_000   # rows a hybrid search fetches per leg and query


def best_query_per_doc(hits: DataFrame, ascending: bool = False) -> DataFrame:
    """Per document the best score over all queries and the query that gave it, best first.

    `ascending` gives the worst-first order of the relational path.
    """
    best = best_per_key(hits, ["id"], "score", "qid", ["qid", "score"])
    return best.orderBy(F.asc("score") if ascending else F.desc("score"), "id")


def hits_above(hits: DataFrame, cut: float, limit: int | None = None, nearest_first: bool = True) -> DataFrame:
    """Hits above the cut; `limit` keeps that many per query."""
    found = hits.filter(F.col("score") > cut)
    order = F.desc("score") if nearest_first else F.asc("score")
    return found if limit is None else top_k_per_group(found, ["qid"], [order, F.col("id")], limit).drop("rn")


def rerank_top(best: DataFrame, cut: float = 0.25, keep: int | None = None) -> DataFrame:
    kept, order = best.filter(F.col("score") > cut), [F.desc("score"), F.col("id")]
    return kept.orderBy(*order) if keep is None else top_k(kept, order, keep)


def reciprocal_rank_fusion(candidates: DataFrame, scores: list[str], constant: int = 60) -> DataFrame:
    """Adds `rrf`. Candidates are at most the rerank depth per query, so the windows are small."""
    # fixed value: the default constant is 60, ranks start at 1
    total = F.lit(0.0)
    for s in scores:
        w = Window.partitionBy("qid").orderBy(F.desc(s), F.col("id"))
        candidates = candidates.withColumn(f"_r_{s}", F.row_number().over(w))
        total = total + 1.0 / (constant + F.col(f"_r_{s}"))
    return candidates.withColumn("rrf", total).drop(*[f"_r_{s}" for s in scores])


def two_phase(candidates: DataFrame, cheap: str, costly: Callable[[DataFrame], DataFrame], depth: int = RERANK_DEPTH) -> DataFrame:
    """Adds `phase` (2 for the best `depth` by `cheap` per query) and `score`.

    `costly` turns (qid, id) rows into (qid, id, costly) and only ever sees the best ones; the
    rest keep their cheap score and sort after all of phase 2. No query's whole candidate list
    is sorted in one task: the top is found by a pruned window and joined back.
    """
    best = top_k_per_group(candidates.select("qid", "id", cheap), ["qid"], [F.desc(cheap), F.col("id")], depth, "_rn")
    scored = costly(best.select("qid", "id")).select("qid", "id", "costly", F.lit(2).alias("_phase"))
    return candidates.join(scored, ["qid", "id"], "left").select(
        *candidates.columns, F.coalesce("_phase", F.lit(1)).alias("phase"),
        F.when(F.col("_phase") == 2, F.col("costly")).otherwise(F.col(cheap)).alias("score"))


def minmax_fusion(vector_leg: DataFrame, text_leg: DataFrame, alpha: float) -> DataFrame:
    """(qid, id, score): alpha * scaled vector score + (1 - alpha) * scaled text score.

    Each leg is scaled to 0..1 per query. Legs are fetched with a limit per query, so the window
    over a query's rows is small. A leg whose scores are all equal scales to 1. A document in
    one leg only gets 0 for the other.
    """
    def scaled(leg: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("qid")
        lo, hi = F.min("score").over(w), F.max("score").over(w)
        return leg.select("qid", "id", F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(1.0).alias(name))

    both = scaled(vector_leg, "_v").join(scaled(text_leg, "_t"), ["qid", "id"], "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select("qid", "id", (alpha * zero("_v") + (1 - alpha) * zero("_t")).alias("score"))


def three_way_intersect(body: DataFrame, keywords: DataFrame, title: DataFrame, keys: list[str]) -> DataFrame:
    """Documents in all three hit lists with (9 body + 2 keywords + 1 title) / 12."""
    legs = {"body": body, "keywords": keywords, "title": title}
    out = None
    for name, leg in legs.items():
        leg = leg.select(*keys, F.col("score").alias(name))
        out = leg if out is None else out.join(leg, keys)
    total = sum(w * F.col(n) for n, w in LEG_WEIGHTS.items()) / sum(LEG_WEIGHTS.values())
    return out.withColumn("score", total)


def hybrid_leg(docs: DataFrame, queries: DataFrame, terms: DataFrame, vector: str, fields: dict[str, Column],
               weights: dict[str, float], alpha: float, max_distance: float, prepared=None) -> DataFrame:
    """One field's hybrid search: vectors within a distance fused with weighted BM25."""
    vec = nearest(docs, queries, k=LEG_HITS, vector=vector).filter(F.col("score") > 1 - max_distance)
    return minmax_fusion(vec, bm25_hits(docs, "id", fields, terms, LEG_HITS, weights, prepared=prepared), alpha)


def three_leg_search(docs: DataFrame, queries: DataFrame, terms: DataFrame, legs: dict = HYBRID_LEGS) -> DataFrame:
    """Body, keyword and title hybrid searches, then the intersection."""
    f = document_fields(with_community=True)
    prepared = prepare(docs, f, terms, LEG_HITS)  # one pass for the statistics of all fields
    body = hybrid_leg(docs, queries, terms, "v", {k: f[k] for k in ("body", "title", "community")},
                      {"body": 3.0, "title": 2.0, "community": 1.0}, *legs["body"], prepared)
    keywords = hybrid_leg(docs, queries, terms, "kw", {"keywords": f["keywords"]}, {}, *legs["keywords"], prepared)
    title = hybrid_leg(docs, queries, terms, "tv", {"title": f["title"]}, {}, *legs["title"], prepared)
    return three_way_intersect(body, keywords, title, ["qid", "id"])


def union_candidates(text_hits: DataFrame, *vector_hits: DataFrame) -> DataFrame:
    """(qid, id) found by any leg, once."""
    out = text_hits.select("qid", "id")
    for h in vector_hits:
        out = out.unionByName(h.select("qid", "id"))
    return out.distinct()


def funnel(first: DataFrame, *stages: DataFrame) -> DataFrame:
    """Each later stage only among the documents the stage before found, per query."""
    kept = first
    for stage in stages:
        kept = stage.join(kept.select("qid", "id"), ["qid", "id"], "left_semi")
    return kept


def funnel_search(docs: DataFrame, queries: DataFrame, terms: DataFrame, fields: dict[str, Column], k: int | None = None, cut: float = 0.0,
                  body_cut: float = 0.0) -> DataFrame:
    """(qid, id, score): of all documents whose body vector is above `body_cut`, those with a query word, of those the ones
    whose title vector is above `cut`; only the pairs of a stage reach the next one. `k` takes the k nearest by body instead."""
    near = (nearest(docs, queries, threshold=body_cut) if k is None else nearest(docs, queries, k=k)).select("qid", "id")
    words = bm25_pairs(docs, "id", fields, terms, near).filter(sum(F.col(f) for f in fields) > 0).select("qid", "id")
    # stored, so that the few query vectors are sent by their known size and no pair is shuffled with its vectors
    asked = stored(queries.select("qid", F.col("v").alias("_q")), "queries")
    pairs = words.join(docs.filter("tv IS NOT NULL").select("id", "tv"), "id").join(asked, "qid")
    return pair_scores(pairs, {"score": ("tv", "_q")}).filter(F.col("score") > cut).select("qid", "id", "score")


def nearest_query(docs: DataFrame, queries: DataFrame, cut: float) -> DataFrame:
    """(id, score, qid): each document's most similar query above `cut`, lowest qid on a tie. One row per
    document is formed, not one per pair."""
    asked = docs.select(F.col("id").alias("qid"), "v")
    found = nearest(queries.select(F.col("qid").alias("id"), "v"), asked, k=1)
    return found.filter(F.col("score") > cut).select(F.col("qid").alias("id"), "score", F.col("id").alias("qid"))


def cosine_or_zero(pairs: DataFrame, docs: DataFrame, queries: DataFrame, name: str) -> DataFrame:
    """(qid, id, name): cosine of document and query vector, 0 for a document without a vector."""
    q = queries.select("qid", F.col("v").alias("_q"))
    scored = pair_scores(pairs.join(docs.filter("v IS NOT NULL").select("id", "v"), "id").join(q, "qid"), {name: ("v", "_q")})
    return pairs.join(scored.select("qid", "id", name), ["qid", "id"], "left").fillna(0.0, [name])


def first_phase(docs: DataFrame, queries: DataFrame, terms: DataFrame, fields: dict[str, Column], depth: int, prepared=None) -> DataFrame:
    """(qid, id, first_phase): the `depth` best documents of text OR sign-code neighbours.

    They are ranked by sign-code closeness, which every document with a vector has, then by text score; a document
    without a vector has closeness 0 and comes in by its words alone. `prepared` is the result of `prepare`, if known.
    """
    near = nearest(docs, queries, k=depth, metric="hamming").withColumnRenamed("score", "first_phase").withColumn("_text", F.lit(0.0))
    bare = docs.filter("v IS NULL")
    prepared = prepared or prepare(docs, fields, terms, depth)  # statistics of the whole corpus
    if prepared[0] is None:
        total = sum(F.col(f) for f in fields)
        hits = bm25_by_field(docs, "id", fields, terms).select("qid", "id", F.round(total, 12).alias("score")).filter("score > 0")
        hits = top_k_per_group(hits.join(bare.select("id"), "id", "left_semi"), ["qid"], [F.desc("score"), F.col("id")], depth).drop("rn")
    else:
        hits = bm25_hits(bare, "id", fields, terms, k=depth, prepared=prepared)
    text = hits.join(queries.select("qid"), "qid", "left_semi").select("qid", "id", F.lit(0.0).alias("first_phase"), F.col("score").alias("_text"))
    both = near.select("qid", "id", "first_phase", "_text").unionByName(text)
    return top_k_per_group(both, ["qid"], [F.desc("first_phase"), F.desc("_text"), F.col("id")], depth).drop("rn", "_text")


def semantic_rescoring(docs: DataFrame, queries: DataFrame, vector: str = "v", depth: int = RERANK_DEPTH, hits: int = HITS) -> DataFrame:
    """First phase: sign code times float query. Second phase: closeness of the float vectors."""
    first = nearest(docs, queries, k=depth, metric="signs", vector=vector).withColumnRenamed("score", "first_phase")
    pairs = first.join(docs.select("id", F.col(vector).alias("_v")), "id").join(queries.select("qid", F.col("v").alias("_q")), "qid")
    scored = pair_scores(pairs, {"_cos": ("_v", "_q")}).withColumn("score", V.closeness(1 - F.col("_cos"))).drop("_cos")
    return top_k_per_group(scored, ["qid"], [F.desc("score"), F.col("id")], hits).drop("rn")


def weighted_closeness(docs: DataFrame, queries: DataFrame, terms: DataFrame, depth: int = RERANK_DEPTH, hits: int = HITS) -> DataFrame:
    """Hits with every score part (match features).

    The candidate set is text OR sign-code neighbours (see `first_phase`). A document without a vector
    counts 0 in every vector part.
    """
    prepared = prepare(docs, document_fields(), terms, depth)  # one pass for both phases
    first = first_phase(docs, queries, terms, document_fields(), depth, prepared)
    parts = bm25_pairs(docs, "id", document_fields(), terms, first, prepared)
    pairs = first.join(parts, ["qid", "id"], "left").fillna(0.0, ["title", "body", "keywords"])
    with_vector = pairs.join(docs.filter("v IS NOT NULL").select("id", "v", "tv", "kv"), "id").join(
        queries.select("qid", F.col("v").alias("_q")), "qid")
    scored = pair_scores(with_vector, {"_body": ("v", "_q"), "cosine_title": ("tv", "_q")}, best={"max_keyword_similarity": ("kv", "_q")})
    scored = scored.withColumn("closeness_body", V.closeness(1 - F.col("_body"))).drop("_body")
    bare = pairs.filter("first_phase = 0").withColumns({n: F.lit(0.0) for n in ("cosine_title", "max_keyword_similarity", "closeness_body")})
    parts = scored.unionByName(bare)
    # fixed values: weights of the three fields
    scored = parts.select(
        "qid", "id", "first_phase", F.col("title").alias("bm25_title"), F.col("body").alias("bm25_body"), F.col("keywords").alias("bm25_keywords"),
        "closeness_body", "cosine_title", "max_keyword_similarity",
    ).withColumn("score", 0.5 * (F.col("closeness_body") + squash(F.col("bm25_body")))
                 + 0.3 * (squash(F.col("bm25_keywords")) + F.coalesce("max_keyword_similarity", F.lit(0.0)))
                 + 0.2 * (squash(F.col("bm25_title")) + F.col("cosine_title")))
    return top_k_per_group(scored, ["qid"], [F.desc("score"), F.col("id")], hits).drop("rn")


def hybrid_rrf(docs: DataFrame, queries: DataFrame, terms: DataFrame, depth: int = RERANK_DEPTH, hits: int = HITS) -> DataFrame:
    """Text OR sign-code neighbours first, then rank fusion of four-field BM25 and vector closeness (0 without a vector)."""
    fields = document_fields(with_community=True)
    prepared = prepare(docs, fields, terms, depth)  # one pass for both phases
    first = first_phase(docs, queries, terms, fields, depth, prepared)
    text = bm25_pairs(docs, "id", fields, terms, first, prepared).select("qid", "id", sum(F.col(f) for f in fields).alias("bm25sum"))
    pairs = first.join(text, ["qid", "id"], "left").fillna(0.0, ["bm25sum"])
    with_vector = pairs.join(docs.filter("v IS NOT NULL").select("id", "v"), "id").join(queries.select("qid", F.col("v").alias("_q")), "qid")
    scored = pair_scores(with_vector, {"_cos": ("v", "_q")}).withColumn("closeness", V.closeness(1 - F.col("_cos"))).drop("_cos")
    scored = scored.unionByName(pairs.filter("first_phase = 0").withColumn("closeness", F.lit(0.0)))
    fused = reciprocal_rank_fusion(scored, ["bm25sum", "closeness"]).withColumnRenamed("rrf", "score")
    return top_k_per_group(fused, ["qid"], [F.desc("score"), F.col("id")], hits).drop("rn")


def hit_rows(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Result rows: fields renamed, title never null, UTC time, each document once, best first."""
    best = hits.groupBy("id").agg(F.max("score").alias("relevance_score"))
    return best.join(docs, "id").select(
        "id", "relevance_score", F.coalesce("title", F.lit("")).alias("title"), "body", "author",
        F.col("community").alias("subreddit_name"), F.col("permalink"),
        F.date_format(F.timestamp_seconds("created_utc"), "yyyy-MM-dd HH:mm:ss").alias("created_utc"), "score",
    ).orderBy(F.desc("relevance_score"), "id")


def rerank_best_query(docs: DataFrame, queries: DataFrame, text: str, scorer, max_queries: int | None = None,
                      block: int = 1000) -> DataFrame:
    """Best (query, score) per document for a pluggable scorer; only scores above 0 count.

    Queries travel to every task, which scores its texts against `block` of them at a time; the documents are scanned
    once for every RERANK_QUERIES of them. `max_queries` takes the first ones only.
    `scorer` gets the query texts and a series of whole texts and returns one row of scores per text;
    a task emits one row per document and block, never a row per pair.
    """
    queries = queries.select("qid", "query") if max_queries is None else queries.select("qid", "query").orderBy("qid").limit(max_queries)
    shares = queries.count() // RERANK_QUERIES + 1
    found = None
    for b in range(shares):
        own = queries if shares == 1 else queries.filter(F.pmod(F.xxhash64("qid"), F.lit(shares)) == b)
        best = _best_of_share(docs, own, text, scorer, block)
        found = best if found is None else found.unionByName(best)
    return found if shares == 1 else best_per_key(found, ["id"], "score", "qid", ["qid", "score"]).select("id", "qid", "score")


def _best_of_share(docs: DataFrame, queries: DataFrame, text: str, scorer, block: int) -> DataFrame:
    import numpy as np
    import pandas as pd

    wanted = sorted((r["qid"], r["query"]) for r in queries.collect())  # RERANK_QUERIES rows or so

    def run(batches):
        for pdf in (whole.iloc[at:at + RERANK_TEXTS].reset_index(drop=True) for whole in batches for at in range(0, len(whole), RERANK_TEXTS)):
            if not wanted:
                continue
            best, qid = np.zeros(len(pdf)), np.full(len(pdf), wanted[0][0], "int64")
            for at in range(0, len(wanted), block):
                part = wanted[at:at + block]
                scores = np.asarray(scorer([q for _, q in part], pdf[text]), dtype="float64")
                pick = scores.argmax(axis=1)  # the first query wins a tie
                top = scores[np.arange(len(pdf)), pick]
                higher = top > best
                best[higher], qid[higher] = top[higher], np.array([k for k, _ in part], "int64")[pick][higher]
            out = pd.DataFrame({"id": pdf["id"], "qid": qid, "score": best})
            yield out[out["score"] > 0]

    return spread(docs).select("id", text).mapInPandas(run, "id bigint, qid bigint, score double")
