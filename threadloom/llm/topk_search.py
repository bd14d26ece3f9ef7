"""Exact top-k by integer inner product: columnar branch and bound.

Vectors are stored as blocks in vertical layout (one row of the matrix per dimension). A task
holds one block of queries and one of candidates, adds up products dimension block by dimension
block, and after each keeps only candidates whose partial score plus the largest possible rest
(the product of both remaining lengths, by Cauchy-Schwarz) can still reach the query's k-th best.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.llm.common import kept, partitions, ragged

BLOCK = "block long, rows binary, ids binary, matrix binary, n long"
EXACT = 2.0 ** 53
LIMIT = (1 << 63) - 1


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) per component as long; null for a null vector or one with a null or non-finite component."""
    values = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)),
                  F.transform(values, lambda x: F.floor(x * scale).cast("long")))


def vertical_blocks(vectors: DataFrame, size: int = 4096) -> DataFrame:
    """Blocks of at most `size` of the given (row, id, vector array<long>); shorter vectors are filled with zeros."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, k = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(table: pa.Table):
            nonlocal k
            n, vecs = table.num_rows, table.column("vector").to_pylist()
            lengths = np.fromiter(map(len, vecs), np.int64, n)
            matrix = np.zeros((int(lengths.max(initial=0)), n), "<i8")
            matrix[ragged(np.zeros(n, np.int64), lengths), np.repeat(np.arange(n), lengths)] = list(chain.from_iterable(vecs))
            k += 1
            ints = lambda c: table.column(c).to_numpy().astype("<i8").tobytes()
            return pa.RecordBatch.from_pylist([{"block": base + k, "rows": ints("row"), "ids": ints("id"), "matrix": matrix.tobytes(), "n": n}])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= size:
                table = pa.Table.from_batches(held)
                yield flush(table.slice(0, size))
                held, rows = table.slice(size).to_batches(), rows - size
        if rows:
            yield flush(pa.Table.from_batches(held))

    return vectors.select("row", "id", "vector").mapInArrow(build, BLOCK)


class Best:
    """The k best (score, id) per query so far: higher scores first, ties to smaller ids."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = [np.zeros(0, np.int64)] * queries
        self.ids = [np.zeros(0, np.int64)] * queries
        self.floor = np.full(queries, -np.inf)

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.score[q], scores]), np.concatenate([self.ids[q], ids])
        if len(scores) > 4 * self.k:
            reach = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[scores >= reach], ids[scores >= reach]
        order = np.lexsort((ids, -scores))[: self.k]
        self.score[q], self.ids[q] = scores[order], ids[order]
        if len(order) == self.k:
            self.floor[q] = float(scores[order[-1]])


def search_block(best: Best, queries: np.ndarray, query_rows: np.ndarray, cands: np.ndarray, ids: np.ndarray,
                 cand_rows: np.ndarray, step: int = 16) -> None:
    """Offer every candidate that may be among the best. `queries` is (dims, q), `cands` (dims, n).

    A row is no candidate of itself (`*_rows` identify rows).
    """
    dims = max(len(queries), len(cands))
    pad = lambda m: np.vstack([m, np.zeros((dims - len(m), m.shape[1]), m.dtype)])
    queries, cands = pad(queries), pad(cands)
    large = float(np.abs(queries).max(initial=0)) * float(np.abs(cands).max(initial=0)) * max(1, dims)
    if large >= EXACT:  # float64 would round: plain integers, no pruning
        for q in range(queries.shape[1]):
            scores = (queries[:, q].astype(object)[:, None] * cands.astype(object)).sum(axis=0) if dims else np.zeros(len(ids), object)
            own = cand_rows != query_rows[q]
            best.offer(q, np.clip(scores[own], -LIMIT, LIMIT).astype(np.int64), ids[own])
        return
    qs, cs = queries.astype(float), cands.astype(float)
    cuts = list(range(0, dims, step)) or [0]
    rest = lambda m: [np.sqrt((m[c + step:] ** 2).sum(axis=0)) for c in cuts]  # noqa: E731  length beyond each dimension block
    q_rest, c_rest = rest(qs), rest(cs)
    head = qs[:step].T @ cs[:step]
    for q in range(qs.shape[1]):
        if not np.isfinite(best.floor[q]):  # a first floor from a few whole scores
            few = np.flatnonzero(cand_rows[: 4 * best.k] != query_rows[q])
            best.offer(q, np.rint(qs[:, q] @ cs[:, few]).astype(np.int64), ids[few])
            alive = np.arange(len(few) and few[-1] + 1, len(ids))
            partial = head[q, alive]
        else:
            alive, partial = np.arange(len(ids)), head[q]
        for i, c in enumerate(cuts):
            if i:
                partial = partial + qs[c: c + step, q] @ cs[c: c + step, alive]
            if len(cuts) == i + 1:
                break
            # compaction: equal scores may still win by id, so the bound keeps them; 1e-6 covers rounding
            stay = np.flatnonzero(partial + q_rest[i][q] * c_rest[i][alive] * (1 + 1e-9) + 1e-6 >= best.floor[q])
            if len(stay) < len(alive):
                alive, partial = alive[stay], partial[stay]
            if not len(alive):
                break
        stay = (partial >= best.floor[q]) & (cand_rows[alive] != query_rows[q])
        if stay.any():
            best.offer(q, np.rint(partial[stay]).astype(np.int64), ids[alive[stay]])


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, size: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every query row.

    `vectors` has `id` and `vector` (array<long>; rows with a null id or vector take no part). The
    stated query set meets all rows in blocks: each pair of blocks has a key of its own, so work
    spreads evenly and no task holds more than one pair. A task keeps its k best per query over its
    pairs, and these few rows are merged by query. Repeated rows and ids are rows of their own; an
    empty table gives no rows. Scores beyond 64 bits count as the largest (smallest) 64-bit number.
    """
    spark = vectors.sparkSession
    rows = kept(vectors.filter(F.col("id").isNotNull() & F.col("vector").isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), "id", "vector", is_query.alias("is_query")), "rows")
    asked = rows.filter("is_query")
    cands = kept(vertical_blocks(rows, size), "candidates")
    queries = kept(vertical_blocks(asked.repartition(asked.count() // size + 1), size), "queries").select(
        *[F.col(c).alias(f"q{c}") for c in ("block", "rows", "ids", "matrix", "n")])
    pairs = kept(queries.select("qblock").crossJoin(cands.select("block")), "pairs")  # numbers of blocks only
    both = pairs.join(queries, "qblock").join(cands, "block").repartition(partitions(spark), "qblock", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple[Best, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                ints = {c: np.frombuffer(r[c], "<i8") for c in ("qrows", "qids", "qmatrix", "rows", "ids", "matrix")}
                best = state.setdefault(r["qblock"], (Best(r["qn"], k), ints["qids"], ints["qrows"]))[0]
                search_block(best, ints["qmatrix"].reshape(-1, r["qn"]), ints["qrows"],
                             ints["matrix"].reshape(-1, r["n"]), ints["ids"], ints["rows"])
        for best, qids, qrows in state.values():
            n = [len(s) for s in best.score]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(qrows, n)), pa.array(np.repeat(qids, n)), pa.array(np.concatenate(best.ids)),
                 pa.array(np.concatenate(best.score))], ["query_row", "query_id", "vec_id", "score"])

    found = both.select("qblock", "qids", "qrows", "qmatrix", "qn", "block", "ids", "rows", "matrix", "n").mapInArrow(
        search, "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
