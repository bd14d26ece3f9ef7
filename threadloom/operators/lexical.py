"""Lexical search as batch jobs: many queries against a whole corpus at once.

Query sets are small next to a corpus, so they travel: their size is checked, each task scores
its own documents against all of them and emits its best. A query set too large for that is
joined by term instead; then a hot term is a hot join key, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from threadloom.constants import BM25_B, BM25_K1
from threadloom.functions.text import bold_matches, tokens
from threadloom.operators.nearest import KEPT, Best
from threadloom.operators.ranking import merged_top_k, top_k_per_group
from threadloom.runtime import fetch_if_small, splits, spread

QUERY_TERMS = 200_000   # (query, term) rows that may travel to every task
DOCS = 512              # documents scored at once inside a task
TOKENS = 250_000        # tokens looked up at once inside a task
PIECE = 500_000         # additions done at once inside a task


def query_counts(docs: DataFrame, key: str, fields: dict[str, Column], terms: DataFrame) -> DataFrame:
    """(key, field, dl, term, tf) for the query vocabulary; `fields` maps names to token arrays."""
    parts = F.array(*[F.struct(F.lit(n).alias("field"), toks.alias("toks")) for n, toks in fields.items()])
    # the length is taken before the second explode, so a row per token does not carry the tokens
    long = spread(docs).select(F.col(key), F.explode(parts).alias("_f")).select(
        key, "_f.field", F.size("_f.toks").alias("dl"), F.col("_f.toks").alias("toks")
    ).select(key, "field", "dl", F.explode("toks").alias("term"))
    vocabulary = terms.select("term").distinct()
    return long.join(vocabulary, "term", "left_semi").groupBy(key, "field", "dl", "term").agg(
        F.count(F.lit(1)).alias("tf")
    )


def field_lengths(docs: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, n, avgdl): one pass, one row per field."""
    sizes = spread(docs).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.greatest(F.coalesce(F.size(toks), F.lit(0)), F.lit(0))).alias(f) for f, toks in fields.items()]
    )
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("avgdl")) for f in fields])
    return sizes.select("n", F.explode(rows).alias("_r")).select("_r.field", "n", "_r.avgdl")


def bm25_by_field(docs: DataFrame, key: str, fields: dict[str, Column], terms: DataFrame) -> DataFrame:
    """One row per (qid, document) with a BM25 column per field (0 when no term is in it).

    Every matching pair is a row, so use this for query sets too large for `bm25_hits`. Sums
    are rounded to twelve places, so copies of a text tie whatever order they were added in.
    """
    terms = terms.select("qid", "term").distinct()  # a repeated term counts once
    counts = query_counts(docs, key, fields, terms)
    frequency = counts.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    weights = frequency.join(field_lengths(docs, fields), "field").withColumn(
        "idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    ).select("field", "term", "idf", "avgdl")
    tf, dl = F.col("tf"), F.col("dl")
    part = F.col("idf") * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / F.col("avgdl")))
    weighted = counts.join(weights, ["field", "term"]).select(key, "field", "term", part.alias("_w"))
    return weighted.join(terms, "term").groupBy("qid", key).agg(*[
        F.round(F.sum(F.when(F.col("field") == f, F.col("_w")).otherwise(0.0)), 12).alias(f) for f in fields
    ])


@dataclass
class QuerySet:
    """Queries small enough to travel to every task: a vocabulary and, per term, its queries."""

    vocabulary: list[str]
    qids: np.ndarray
    start: np.ndarray    # start[t]:start[t + 1] are the places of term t's queries in `query`
    query: np.ndarray

    @classmethod
    def of(cls, terms: DataFrame, k: int = 1, max_rows: int | None = None) -> QuerySet | None:
        """The query set, or None when it is too large to travel or to keep k hits per query."""
        rows = fetch_if_small(terms.select("qid", "term").distinct(), QUERY_TERMS if max_rows is None else max_rows)
        if rows is None or len({r["qid"] for r in rows}) * k > KEPT:
            return None
        vocabulary, t = np.unique([r["term"] for r in rows] or np.empty(0, "U1"), return_inverse=True)
        qids, q = np.unique(np.array([r["qid"] for r in rows], "int64"), return_inverse=True)
        order = np.argsort(t, kind="stable")
        start = np.searchsorted(t[order], np.arange(len(vocabulary) + 1))
        return cls([str(v) for v in vocabulary], qids, start, q[order])

    def counts(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, tf) of the vocabulary in an Arrow list column, and the rows' lengths."""
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype("int64")
        flat = column.flatten()
        found = pc.fill_null(pc.index_in(flat, value_set=pa.array(self.vocabulary, flat.type)), -1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lengths)), lengths)
        hit = found >= 0
        n = max(1, len(self.vocabulary))
        code, tf = np.unique(row[hit] * n + found[hit], return_counts=True)
        return code // n, code % n, tf, lengths

    def expand(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n_rows: int) -> np.ndarray:
        """Weights added up per (row, query)."""
        n_q = len(self.qids)
        total = np.zeros(n_rows * n_q)
        count = self.start[term + 1] - self.start[term]
        ends = np.cumsum(count)
        at = 0
        while at < len(row):  # bounded pieces, however many queries share the common terms
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE)))
            c = count[at:upto]
            within = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            q = self.query[np.repeat(self.start[term[at:upto]], c) + within]
            total += np.bincount(np.repeat(row[at:upto], c) * n_q + q, np.repeat(weight[at:upto], c), n_rows * n_q)
            at = upto
        return total.reshape(n_rows, n_q)


def _pieces(batch: pa.RecordBatch, columns: range) -> Iterator[pa.RecordBatch]:
    """Parts of at most DOCS documents and TOKENS tokens in the list columns; a longer document is a part of its own."""
    lengths = [pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False) for c in columns]
    ends = np.cumsum(np.sum(lengths, axis=0, dtype="int64"))
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKENS, "right"))
        upto = max(at + 1, min(upto, at + DOCS))
        yield batch.slice(at, upto - at)
        at = upto


@dataclass
class FieldStats:
    """Corpus statistics of one field for the query vocabulary."""

    idf: np.ndarray
    avgdl: float


def corpus_stats(docs: DataFrame, fields: dict[str, Column], queries: QuerySet) -> dict[str, FieldStats]:
    """Document frequencies and mean lengths in one pass: a task emits one row per seen term."""
    names = list(fields)
    n_terms = len(queries.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((len(names), n_terms + 1), "int64")   # the last place is the total length
        seen = 0
        for whole in batches:
            seen += whole.num_rows
            for b in _pieces(whole, range(len(names))):
                for f in range(len(names)):
                    _, term, _, lengths = queries.counts(b.column(f))
                    df[f, :n_terms] += np.bincount(term, minlength=n_terms)[:n_terms]
                    df[f, n_terms] += lengths.sum()
        f, t = np.nonzero(df)
        yield _rows(["field", "term", "n"], np.append(f, -1), np.append(t, -1), np.append(df[f, t], seen))

    parts = spread(docs).select(*[toks.alias(f"_{f}") for f, toks in fields.items()]).mapInArrow(count, "field bigint, term bigint, n bigint")
    # at most fields x vocabulary rows, both bounded by the query set
    totals = {(r["field"], r["term"]): r["n"] for r in parts.groupBy("field", "term").agg(F.sum("n").alias("n")).collect()}
    n = totals.get((-1, -1), 0)
    df = lambda f: np.array([totals.get((f, t), 0) for t in range(n_terms)], "float64")
    return {name: FieldStats(np.log(1 + (n - df(f) + 0.5) / (df(f) + 0.5)), totals.get((f, n_terms), 0) / max(1, n)) for f, name in enumerate(names)}


def _rows(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _bm25_weight(stats: FieldStats, term, tf, dl):
    return stats.idf[term] * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / (stats.avgdl or 1.0)))


def _share_weight(_, term, tf, dl):
    return tf / dl


def _search(docs: DataFrame, key: str, fields: dict[str, Column], queries: QuerySet, k: int | None, weigh, stats, weights, bonus: str | None) -> DataFrame:
    names = list(fields)
    extra = [F.coalesce(F.col(bonus).cast("double"), F.lit(0.0)).alias("_bonus")] if bonus else []

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None if k is None else Best(len(queries.qids), k)
        for whole in batches:
            for b in _pieces(whole, range(1, len(names) + 1)):
                total = np.zeros((b.num_rows, len(queries.qids)))
                for f, name in enumerate(names):
                    row, term, tf, dl = queries.counts(b.column(f + 1))
                    total += weights.get(name, 1.0) * queries.expand(row, term, weigh(stats.get(name), term, tf, dl[row]), b.num_rows)
                total = np.round(total, 12)
                total[total <= 0] = np.nan
                if bonus:
                    total += np.asarray(b.column(len(names) + 1))[:, None]
                if best is None:  # every match is a row
                    row, q = np.nonzero(~np.isnan(total))
                    yield pa.RecordBatch.from_arrays([pa.array(queries.qids[q]), b.column(0).take(pa.array(row)), pa.array(total[row, q])], ["qid", "id", "score"])
                else:
                    best.add(np.asarray(b.column(0)), total, None)
        if best is not None:
            yield best.rows(queries.qids)

    source = spread(docs).select(F.col(key).cast("bigint").alias("id"), *[t.alias(f"_{n}") for n, t in fields.items()], *extra)
    found = source.mapInArrow(scan, "qid bigint, id bigint, score double")
    if k is None:
        return found.withColumnRenamed("id", key)
    return merged_top_k(found, splits(docs), ["qid"], [F.desc("score"), F.col("id")], k).drop("rn").withColumnRenamed("id", key)


def prepare(docs: DataFrame, fields: dict[str, Column], terms: DataFrame, k: int | None) -> tuple[QuerySet | None, dict[str, FieldStats]]:
    """The query set and the corpus statistics of its terms; (None, {}) when it cannot travel."""
    queries = QuerySet.of(terms, k or 1)  # without k a task keeps nothing
    return queries, {} if queries is None else corpus_stats(docs, fields, queries)


def bm25_hits(docs: DataFrame, key: str, fields: dict[str, Column], terms: DataFrame, k: int | None = 700,
              weights: dict[str, float] | None = None, bonus: str | None = None, prepared=None) -> DataFrame:
    """(qid, key, score): the k best documents per query by weighted BM25 over the fields, or all with a score if k is None.

    A query with common words matches nearly every document, so with a k (query, document) pairs are
    never rows: the queries travel to the tasks, a task counts and scores its own documents and
    emits its k best per query. The corpus is read twice (statistics, scores) and never
    shuffled. `bonus` names a column added to the score of matching documents, 0 where it is null.
    Keys are bigint. A query set too large to travel gives the same rows by a join.
    `prepared` shares the result of `prepare` between searches of one corpus.
    """
    queries, stats = prepared or prepare(docs, fields, terms, k)
    if queries is None:
        scored = bm25(docs, key, fields, terms, weights)
        if bonus:
            scored = scored.join(docs.select(key, F.coalesce(F.col(bonus).cast("double"), F.lit(0.0)).alias("_bonus")), key).withColumn(
                "score", F.col("score") + F.col("_bonus"))
        positive = _positive(scored, key, bool(bonus))
        return positive if k is None else top_k_per_group(positive, ["qid"], [F.desc("score"), F.col(key)], k).drop("rn")
    return _search(docs, key, fields, queries, k, _bm25_weight, stats, weights or {}, bonus)


def _positive(scored: DataFrame, key: str, bonus: bool) -> DataFrame:
    """Rows as the travelling way gives them: (qid, key, score), the text score above 0."""
    text = F.col("score") - F.col("_bonus") if bonus else F.col("score")
    return scored.filter(F.round(text, 12) > 0).select(F.col("qid").cast("bigint"), F.col(key).cast("bigint"), F.round("score", 12).alias("score") if not bonus else "score")


def bm25_pairs(docs: DataFrame, key: str, fields: dict[str, Column], terms: DataFrame, pairs: DataFrame, prepared=None) -> DataFrame:
    """(qid, key, one BM25 column per field) for the given (qid, key) pairs only.

    Statistics count the whole corpus; then only documents of a pair are tokenised again, each
    with the list of its own queries (no longer than the query set). A pair of a known query and
    document without a common word is a row of zeros. `prepared` shares the result of `prepare`
    for the same documents.
    """
    queries, stats = prepared if prepared and prepared[0] is not None else prepare(docs, fields, terms, 1)
    if queries is None:
        wanted = pairs.select(F.col("qid").cast("bigint").alias("qid"), F.col(key).cast("bigint").alias(key))
        known = wanted.join(terms.select("qid").distinct(), "qid", "left_semi").join(docs.select(key), key, "left_semi")
        return known.join(bm25_by_field(docs, key, fields, terms), ["qid", key], "left").select(
            "qid", key, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in fields])
    names = list(fields)
    wanted = pairs.groupBy(F.col(key).alias("_key")).agg(F.collect_list("qid").alias("_qids"))
    chosen = docs.join(wanted, F.col(key) == F.col("_key"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _pieces(whole, range(2, len(names) + 2)):
                lists = b.column(1)
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                qid = np.asarray(lists.flatten())
                place = np.searchsorted(queries.qids, qid)
                known = (place < len(queries.qids)) & (queries.qids[np.minimum(place, len(queries.qids) - 1)] == qid)
                row, qid, place = row[known], qid[known], place[known]
                parts = []
                for f, name in enumerate(names):
                    r, term, tf, dl = queries.counts(b.column(f + 2))
                    parts.append(np.round(queries.expand(r, term, _bm25_weight(stats[name], term, tf, dl[r]), b.num_rows)[row, place], 12))
                yield _rows(["qid", key, *names], qid, np.asarray(b.column(0))[row], *parts)

    source = chosen.select(F.col(key).cast("bigint"), F.col("_qids"), *[t.alias(f"_{n}") for n, t in fields.items()])
    return source.mapInArrow(score, f"qid bigint, {key} bigint, " + ", ".join(f"{n} double" for n in names))


def text_matches(docs: DataFrame, key: str, fields: dict[str, Column], terms: DataFrame) -> DataFrame:
    """(qid, key) of every document with any query term in any of the fields, found in one scan of the documents.

    A query set too large to travel gives the same rows by a join.
    """
    queries = QuerySet.of(terms)
    if queries is None:
        return query_counts(docs, key, fields, terms).select(key, "term").distinct().join(terms, "term").select("qid", key).distinct()

    columns = range(1, len(fields) + 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _pieces(whole, columns):
                found = np.zeros((b.num_rows, len(queries.qids)))
                for f in columns:
                    row, term, tf, _ = queries.counts(b.column(f))
                    found += queries.expand(row, term, tf, b.num_rows)
                row, q = np.nonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array(queries.qids[q]), b.column(0).take(pa.array(row))], ["qid", key])

    source = spread(docs).select(F.col(key).cast("bigint").alias(key), *[t.alias(f"_{n}") for n, t in fields.items()])
    return source.mapInArrow(scan, f"qid bigint, `{key}` bigint")


def document_fields(with_community: bool = False) -> dict[str, Column]:
    """The default field set of search documents."""
    fields = {"title": tokens(F.col("title")), "body": tokens(F.col("body")), "keywords": F.col("keywords")}
    if with_community:
        fields["community"] = tokens(F.col("community"))
    return fields


def bm25(docs: DataFrame, key: str, fields: dict[str, Column], terms: DataFrame,
         weights: dict[str, float] | None = None) -> DataFrame:
    """(qid, key, score): weighted sum of the fields' BM25."""
    total = sum((weights or {}).get(f, 1.0) * F.col(f) for f in fields)
    return bm25_by_field(docs, key, fields, terms).select("qid", key, total.alias("score"))


def fulltext_hits(docs: DataFrame, key: str, text: str, terms: DataFrame, k: int = 10_000, toks: Column | None = None) -> DataFrame:
    """(qid, key, score): occurrences of any query term per token of the document, k best. `toks` replaces the
    plain tokens of `text`."""
    fields = {"text": tokens(F.col(text)) if toks is None else toks}
    queries = QuerySet.of(terms, k)
    if queries is None:
        terms = terms.select("qid", "term").distinct()
        scored = query_counts(docs, key, fields, terms).join(terms, "term").groupBy("qid", key).agg(
            F.round(F.sum("tf") / F.max("dl"), 12).alias("score"))
        return top_k_per_group(_positive(scored, key, False), ["qid"], [F.desc("score"), F.col(key)], k).drop("rn")
    return _search(docs, key, fields, queries, k, _share_weight, {}, {}, None)


def phrase_hits(docs: DataFrame, key: str, text: str, phrases: DataFrame, lengths: list[int], keep: tuple[str, ...] = ()) -> DataFrame:
    """(phrase, key, *keep): documents that hold the phrase's tokens next to each other, in order.

    `phrases` has a `phrase` column of space-joined tokens, whose token counts are `lengths`.
    Every run of that many tokens is looked up by equality, so there is no document x phrase
    product; runs no phrase asks for never leave their task.
    """
    toks = spread(docs.select(key, text, *keep)).select(key, *keep, tokens(F.col(text)).alias("_t"))

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("_t") - (n - 1), F.lit(1)))
        found = F.transform(starts, lambda i: F.array_join(F.slice("_t", i, n), " "))
        return F.when(F.size("_t") >= n, found).otherwise(F.array().cast("array<string>"))

    guarded = [runs(n) for n in lengths]
    grams = toks.select(key, *keep, F.explode(F.array_distinct(F.concat(*guarded))).alias("phrase"))
    return grams.join(phrases.select("phrase").distinct(), "phrase", "left_semi")


def bold_field(df: DataFrame, key: str, field: str, terms: DataFrame) -> DataFrame:
    """Mark the words of `field` that are among `terms`; only a row's own words are compared."""
    words = df.select(key, F.explode(F.array_distinct(tokens(F.col(field)))).alias("term"))
    found = words.join(terms.select("term").distinct(), "term", "left_semi").groupBy(key).agg(
        F.collect_set("term").alias("_hits")
    )
    hits = F.coalesce("_hits", F.array().cast("array<string>"))
    return df.join(found, key, "left").withColumn("marked", bold_matches(F.col(field), hits)).drop("_hits")
