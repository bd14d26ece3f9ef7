"""Vector search as batch jobs.

`nearest` scores many query vectors against a whole table. Few queries travel to the data
as one matrix and every task keeps its k best per query, so only k rows per query and task
are shuffled. With many queries and few items the items travel instead and nothing is
shuffled. When both are many, a grid of (query block, item block) tiles is shuffled and each
tile does the same, so no task holds more than a block of each side. All ways are exact and
a task emits its k best, never all pairs it looked at.

`similar_pairs`, `similar_forest`, `neighbour_counts` and `similar_neighbours` are exact self joins
under a similarity threshold, for the pairs themselves, for connectivity, density and neighbourhoods; the last three
stream blocks of rows (`blocks`). A partition by several pivots decides which rows can be near each other at all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

from threadloom.operators.ranking import merged_top_k, top_k_per_group
from threadloom.runtime import fetch_if_small, splits, stored

MATRIX_ROWS = 4096    # queries that may travel as one matrix
BLOCK_ROWS = 16_384   # rows per side of a tile; larger blocks mean fewer copies in the shuffle
CELLS = 4_000_000     # scores held at once inside a task
PAIRS = 200_000       # candidate pairs scored at once inside a task
PIVOTS = 256          # cells of a self join at most
PIVOT_SAMPLE = 4096   # rows from which pivots are chosen
MET = 0.5             # pivots are used where a row meets at most this share of the rows
FEW_BLOCKS = 8        # blocks of a self join without pivots, while blocks may grow: 36 tiles
KEPT = 20_000_000     # best rows a task may hold for all its queries together


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.full_like(m, np.nan), where=n > 0)


def _signs(m: np.ndarray) -> np.ndarray:
    return np.where(m > 0, 1.0, -1.0)


def _prepare(m: np.ndarray, metric: str, query: bool) -> np.ndarray:
    if metric == "cosine":
        return _unit(m)
    if metric == "hamming" or (metric == "signs" and not query):
        return _signs(m)
    return m


def _scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Higher is nearer: cosine, dot, sign-code dot, 1/(1+Hamming) or minus Euclid.

    Rounded to twelve places: a matrix product may differ in the last bits between copies of a
    vector, and copies must tie.
    """
    if metric == "hamming":
        return 1.0 / (1.0 + (x.shape[1] - x @ q.T) / 2.0)
    if metric == "euclid":
        sq = (x * x).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2.0 * (x @ q.T)
        return np.round(-np.sqrt(np.maximum(sq, 0.0)), 12)
    return np.round(x @ q.T, 12)


class Best:
    """Running k best (score desc, id asc) per query."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.ids = [np.empty(0, "int64") for _ in range(n)]
        self.scores = [np.empty(0) for _ in range(n)]
        self.floor = np.full(n, -np.inf)  # what a row must reach; most later rows do not

    def add(self, ids: np.ndarray, scores: np.ndarray, own: np.ndarray | None) -> None:
        """A block of scores, one column per query; NaN is no score."""
        hit = scores >= self.floor
        if own is not None:
            hit &= ids[:, None] != own[None, :]
        for j in np.flatnonzero(hit.any(axis=0)):
            keep = hit[:, j]
            self._merge(j, ids[keep], scores[keep, j])

    def add_pairs(self, ids: np.ndarray, query: np.ndarray, scores: np.ndarray) -> None:
        """Single scored pairs."""
        order = np.argsort(query, kind="stable")
        found, starts = np.unique(query[order], return_index=True)
        for j, part in zip(found, np.split(order, starts[1:])):
            self._merge(j, ids[part], scores[part])

    def _merge(self, j: int, i: np.ndarray, v: np.ndarray) -> None:
        keep = v >= self.floor[j]
        i, v = i[keep], v[keep]
        if not len(v):
            return
        if len(v) > self.k:  # rows under the k-th value of this block cannot win
            floor = np.partition(v, len(v) - self.k)[len(v) - self.k]
            i, v = i[v >= floor], v[v >= floor]
        i, v = np.concatenate([self.ids[j], i]), np.concatenate([self.scores[j], v])
        order = np.lexsort((i, -v))[:self.k]
        self.ids[j], self.scores[j] = i[order], v[order]
        if len(order) == self.k:
            self.floor[j] = self.scores[j][-1]

    def rows(self, qids: np.ndarray) -> pa.RecordBatch:
        counts = [len(i) for i in self.ids]
        return _batch(np.repeat(qids, counts), np.concatenate(self.ids), np.concatenate(self.scores))


def _batch(qids, ids, scores) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(qids, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], ["qid", "id", "score"]
    )


def _matrix(column) -> np.ndarray:
    n = len(column)
    flat = np.asarray(column.flatten(), dtype="float64")
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def _codes(m: np.ndarray) -> np.ndarray:
    return np.packbits(m > 0, axis=1)


def _sharing(x: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, query) positions with a code byte in common, each pair once, in bounded pieces."""
    for band in range(q.shape[1]):
        order = np.argsort(q[:, band], kind="stable")
        starts = np.searchsorted(q[order, band], np.arange(257))
        code = x[:, band].astype("int64")
        count = starts[code + 1] - starts[code]
        r = np.repeat(np.arange(len(x)), count)
        within = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
        c = order[starts[code[r]] + within]
        new = ~(x[r, :band] == q[c, :band]).any(axis=1)
        r, c = r[new], c[new]
        for at in range(0, len(r), PAIRS):
            yield r[at:at + PAIRS], c[at:at + PAIRS]


def _skip_pairs(owners: int, column, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner row, place in `keys`) of an Arrow list column of keys to leave out."""
    count = np.asarray(column.value_lengths().fill_null(0)).astype("int64")
    order = np.argsort(keys, kind="stable")
    value = np.asarray(column.flatten()).astype("int64")
    at = np.minimum(np.searchsorted(keys[order], value), len(keys) - 1)
    known = keys[order[at]] == value
    return np.repeat(np.arange(owners), count)[known], order[at[known]]


def _consume(ids, x, qids, queries, plan, best, skip=None) -> Iterator[pa.RecordBatch]:
    """Score a block of items; keep the best, or emit the pairs above the threshold.

    `skip` has (item row, query row) pairs that must not be found.
    """
    metric, k, threshold, skip_self, coded = plan
    q = _prepare(queries, metric, True)
    q_codes = _codes(queries) if coded else None
    step = max(1, CELLS // max(1, len(qids)))
    for at in range(0, len(ids), step):
        part, raw = ids[at:at + step], x[at:at + step]
        m = _prepare(raw, metric, False)
        if coded:
            for r, c in _sharing(_codes(raw), q_codes):
                if skip_self:
                    other = part[r] != qids[c]
                    r, c = r[other], c[other]
                best.add_pairs(part[r], c, np.round(np.einsum("ij,ij->i", m[r], q[c]), 12))
            continue
        s = _scores(m, q, metric)
        if skip is not None:
            here = (skip[0] >= at) & (skip[0] < at + step)
            s[skip[0][here] - at, skip[1][here]] = np.nan
        if best is not None:
            best.add(part, s, qids if skip_self else None)
        else:
            hit = s > threshold
            if skip_self:
                hit &= part[:, None] != qids[None, :]
            r, c = np.nonzero(hit)
            if len(r):
                yield _batch(qids[c], part[r], s[r, c])


def nearest(
    items: DataFrame, queries: DataFrame, k: int | None = None, threshold: float | None = None,
    metric: str = "cosine", skip_self: bool = False, vector: str = "v", matrix_rows: int = MATRIX_ROWS,
    block_rows: int = BLOCK_ROWS, coded: bool = False, skip: DataFrame | None = None,
) -> DataFrame:
    """(qid, id, score): the k best items per query, or all with score above `threshold`.

    `skip` has (qid, id) pairs that must not be found. They travel with the side that is not
    held whole, so a list is never longer than the side that is.

    `items` has `id` and the vector column, `queries` has `qid` and `v`. With `coded`, only
    items that share a byte of sign code with the query are scored.
    """
    if (k is None) == (threshold is None):
        raise ValueError("give k or a threshold")
    if coded and (k is None or metric != "cosine" or skip is not None):
        raise ValueError("the coded search gives the k best by cosine and skips nothing")
    items = items.select(F.col("id").cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    queries = queries.select(F.col("qid").cast("bigint").alias("qid"), F.col("v").cast("array<double>").alias("v")).filter("v IS NOT NULL")
    queries = queries.dropDuplicates(["qid"])  # a repeated query would fill its places with copies
    schema = "qid bigint, id bigint, score double"
    plan = (metric, k, threshold, skip_self, coded)

    few = fetch_if_small(queries, min(matrix_rows, max(1, KEPT // (k or 1))))
    if few is not None:
        if not few:
            return items.sparkSession.createDataFrame([], schema)
        qids = np.array([r["qid"] for r in few], "int64")
        matrix = np.array([r["v"] for r in few], "float64")

        if skip is not None:
            lists = skip.join(queries.select("qid"), "qid", "left_semi").groupBy("id").agg(F.collect_set("qid").alias("_skip"))
            items = items.join(lists, "id", "left").select("id", "v", "_skip")

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(qids), k) if k else None
            for b in batches:
                if b.num_rows:
                    out = _skip_pairs(b.num_rows, b.column(2), qids) if b.num_columns > 2 else None
                    yield from _consume(np.asarray(b.column(0)), _matrix(b.column(1)), qids, matrix, plan, best, out)
            if best is not None:
                yield best.rows(qids)

        found, tasks = items.mapInArrow(scan, schema), splits(items)
    else:
        few = fetch_if_small(items, matrix_rows)
        if few is not None:
            return _items_travel(few, items, queries, plan, schema, skip)
        found = _tiles(items, queries, plan, schema, block_rows, skip)
        tasks = max(1, splits(items) // 16)  # a tile reads blocks of many splits
    if k is None:
        return found
    return merged_top_k(found, tasks, ["qid"], [F.desc("score"), F.col("id")], k).drop("rn")


def _items_travel(few: list, items: DataFrame, queries: DataFrame, plan, schema: str, skip: DataFrame | None) -> DataFrame:
    """Every task holds all items, so a query's result is complete where the query is."""
    if not few:
        return queries.sparkSession.createDataFrame([], schema)
    ids = np.array([r["id"] for r in few], "int64")
    x = np.array([r["v"] for r in few], "float64")
    some = max(1, KEPT // len(few))
    if skip is not None:
        lists = skip.join(items.select("id"), "id", "left_semi").groupBy("qid").agg(F.collect_set("id").alias("_skip"))
        queries = queries.join(lists, "qid", "left").select("qid", "v", "_skip")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, some) for whole in batches for at in range(0, whole.num_rows, some)):
            qids = np.asarray(b.column(0))
            best = Best(len(qids), plan[1]) if plan[1] else None
            out = _skip_pairs(b.num_rows, b.column(2), ids)[::-1] if b.num_columns > 2 else None
            yield from _consume(ids, x, qids, _matrix(b.column(1)), plan, best, out)
            if best is not None:
                yield best.rows(qids)

    return queries.mapInArrow(scan, schema)


def _tiles(items: DataFrame, queries: DataFrame, plan, schema: str, block_rows: int, skip: DataFrame | None) -> DataFrame:
    n_q = max(1, math.ceil(queries.count() / block_rows))
    n_i = max(1, math.ceil(items.count() / block_rows))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = items.withColumn("_i", block("id", n_i)).withColumn("_q", every(n_q))
    right = queries.withColumn("_q", block("qid", n_q)).withColumn("_i", every(n_i))
    if skip is not None:
        lists = skip.withColumn("_q", block("qid", n_q)).groupBy("id", "_q").agg(F.collect_set("qid").alias("_skip"))
        left = left.join(lists, ["id", "_q"], "left")

    def tile(x: pa.Table, q: pa.Table) -> pa.Table:
        found = [_batch(np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0))]
        if x.num_rows and q.num_rows:
            qids = np.asarray(q.column("qid").combine_chunks())
            best = Best(len(qids), plan[1]) if plan[1] else None
            ids = np.asarray(x.column("id").combine_chunks())
            out = _skip_pairs(len(ids), x.column("_skip").combine_chunks(), qids) if "_skip" in x.column_names else None
            found += _consume(ids, _matrix(x.column("v").combine_chunks()), qids, _matrix(q.column("v").combine_chunks()), plan, best, out)
            if best is not None:
                found.append(best.rows(qids))
        return pa.Table.from_batches(found)

    return left.groupBy("_i", "_q").cogroup(right.groupBy("_i", "_q")).applyInArrow(tile, schema)


def similar_pairs(items: DataFrame, threshold: float, metric: str = "cosine", vector: str = "v", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, score) with a < b: all pairs with cosine >= threshold, or Euclid distance <= threshold."""
    return _pairs(items, threshold, metric, vector, block_rows)


def similar_forest(items: DataFrame, threshold: float, metric: str = "cosine", vector: str = "v", block_rows: int | None = None) -> DataFrame:
    """(a, b): edges that connect the same items as all similar pairs would, but no more than
    one per item and block, so a crowd of near copies is not written out pair by pair."""
    from threadloom.operators import blocks
    from threadloom.operators.cluster import connected_components

    return blocks.forest(_blocks(items, threshold, metric, vector, block_rows), threshold, connected_components)


def neighbour_counts(items: DataFrame, threshold: float, metric: str = "cosine", vector: str = "v", block_rows: int | None = None,
                     enough: int | None = None) -> DataFrame:
    """(id, n): how many others are similar, each counted with its `weight` column; with `enough`, counts from there on are only
    lower bounds."""
    from threadloom.operators import blocks

    parts = blocks.counts(_blocks(items, threshold, metric, vector, block_rows), threshold, enough)
    return parts.groupBy("id").agg(F.sum("n").alias("n"))


def similar_neighbours(items: DataFrame, threshold: float, k: int, metric: str = "cosine", vector: str = "v", block_rows: int | None = None) -> DataFrame:
    """(id, other, score): each item's k nearest others above the threshold (Euclid: minus the distance),
    lowest id on a tie. A task emits k rows per item of its block, so a crowd costs no more than others."""
    from threadloom.operators import blocks

    found = blocks.neighbours(_blocks(items, threshold, metric, vector, block_rows), k, threshold).select("id", "other", "score")
    if items.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return found
    return top_k_per_group(found, ["id"], [F.desc("score"), F.col("other")], k).drop("rn")  # rows of one id share their places


def _blocks(items: DataFrame, threshold: float, metric: str, vector: str, block_rows: int | None):
    from threadloom.operators import blocks

    return blocks.write_blocks(items, _radius(threshold, metric), metric, vector, "weight", "bigint", block_rows or blocks.ROWS)


def collapse_copies(items: DataFrame, vector: str = "v") -> tuple[DataFrame, DataFrame]:
    """Equal vectors become one row: (id, vector, weight) with the lowest id, and (id, rep) links.

    Copies are counted by a partial aggregate. The links come from a join in which every key is
    once on the right, so a vector held by a third of all rows is split by the skew join.
    """
    reps = items.filter(F.col(vector).isNotNull()).groupBy(vector).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
    links = items.select(F.col("id"), vector).join(reps.select(F.col("id").alias("rep"), vector, "weight"), vector)
    return reps.select("id", vector, "weight"), links.select("id", "rep", "weight")


def _union(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the sets of a[i] and b[i]; a label is the lowest place of its set."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        np.minimum.at(labels, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(labels[labels], labels):
            labels = labels[labels]


def _far_apart(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """At most `count` centres of a bounded sample, by a few rounds of k-means from evenly taken rows."""
    centres = np.unique(sample[np.linspace(0, len(sample) - 1, min(count, len(sample))).astype(int)], axis=0)
    for _ in range(rounds if len(centres) > 1 else 0):
        home = _squares(sample, centres).argmin(axis=1)
        used, home = np.unique(home, return_inverse=True)
        sums = np.zeros((len(used), sample.shape[1]))
        np.add.at(sums, home, sample)
        centres = np.unique(sums / np.bincount(home)[:, None], axis=0)
    return centres


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T), 0.0)


def _margins(square: np.ndarray, apart: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each row, and whether the plane between its pivot and another one is within `radius`."""
    home = square.argmin(axis=1)
    own = square[np.arange(len(square)), home]
    # distance to the plane between both pivots, times twice their distance
    near = square - own[:, None] <= 2 * apart[home] * (radius * (1 + 1e-9) + 1e-9)
    near[np.arange(len(square)), home] = False
    return home, near


def _met(sample: np.ndarray, pivots: np.ndarray, radius: float) -> float:
    """About the share of all rows that a row meets with these pivots."""
    if math.isinf(radius) or not len(sample):
        return 1.0
    home, near = _margins(_squares(sample, pivots), np.sqrt(_squares(pivots, pivots)), radius)
    near[np.arange(len(sample)), home] = True
    return float((near @ np.bincount(home, minlength=len(pivots))).mean() / len(sample))


def _pivots(base: DataFrame, n: int, metric: str, radius: float, block_rows: int) -> np.ndarray:
    """Pivots from a bounded sample of the n rows; one alone where several would rule out little."""
    count = min(PIVOTS, n // max(1, block_rows // 4))
    if count <= 1 or math.isinf(radius):
        return np.zeros((1, 1))
    sample = np.array([r["v"] for r in base.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("v").collect()], "float64")
    sample = _unit(sample) if metric == "cosine" else sample
    sample = sample[np.isfinite(sample).all(axis=1)]
    if not len(sample):
        return np.zeros((1, 1))
    pivots = _far_apart(sample, count)
    return pivots[:1] if _met(sample, pivots, radius) > MET else pivots


def _placed(base: DataFrame, pivots: np.ndarray, metric: str, radius: float, extra: str, kind: str) -> DataFrame:
    """(id, v, extra, cell, near) of rows with a finite vector: the cell of the nearest pivot, and the other cells whose plane is
    within the radius."""
    apart = np.sqrt(_squares(pivots, pivots))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column(1))
            m = _unit(m) if metric == "cosine" else m
            fine = np.isfinite(m).all(axis=1)
            m, rest = m[fine], b.filter(pa.array(fine))
            home, near = np.zeros(len(m), "int64"), np.zeros((len(m), len(pivots)), bool)
            if len(pivots) > 1:
                home, near = _margins(_squares(m, pivots), apart, radius)
            rows, cells = np.nonzero(near)
            offsets = np.arange(0, m.size + 1, max(1, m.shape[1]), dtype="int32")
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.ravel()))
            margin = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(len(m) + 1)).astype("int32")), pa.array(cells.astype("int32")))
            yield pa.RecordBatch.from_arrays([rest.column(0), lists, rest.column(2), pa.array(home.astype("int32")), margin],
                                             ["id", "v", extra, "cell", "near"])

    return base.mapInArrow(place, f"id bigint, v array<double>, {extra} {kind}, cell int, near array<int>")


def _metric_tiles(items: DataFrame, radius: float, metric: str, vector: str, block_rows: int, extra: str, kind: str, most_rows: int = 0) -> DataFrame:
    """Rows copied to the tiles (cell, a, other, b) in which they meet all rows within `radius` of them.

    Every row lives in the cell of its nearest pivot. Two rows of different cells that are within the radius
    both lie within it of the plane half way between the two pivots, so a row is copied to the tiles of only those
    cells whose plane is that near: the margin of the cell. A crowded cell is cut into hashed blocks, and
    every pair of blocks is a tile of its own. Pivots come from a bounded sample and never change a result. Where they rule
    out little they only multiply copies: then all rows are one cell, cut into FEW_BLOCKS blocks of up to `most_rows` rows
    and into more only beyond that, so copies of a row do not grow with the table before it has that many rows.
    """
    base = items.select(F.col("id").cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"),
                        (F.col(extra) if extra in items.columns else F.lit(1)).cast(kind).alias(extra)).filter("v IS NOT NULL")
    base = stored(base, "rows")
    n = base.count()
    pivots = _pivots(base, n, metric, radius, block_rows)
    if len(pivots) == 1 and n // max(1, block_rows // 4) > 1 and most_rows > block_rows:
        block_rows = min(most_rows, max(block_rows, math.ceil(n / FEW_BLOCKS)))
    placed = _placed(base, pivots, metric, radius, extra, kind)
    full = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per pivot
    blocks = F.array(*[F.lit(max(1, math.ceil(full.get(k, 0) / block_rows))) for k in range(len(pivots))])
    cell, upto = F.col("cell"), lambda q: F.sequence(F.lit(0), F.get(blocks, q) - 1)
    s = F.pmod(F.xxhash64("id"), F.get(blocks, cell)).cast("int")
    spot = lambda c, a, o, b, right: F.struct(c.alias("cell"), a.alias("a"), o.alias("other"), b.alias("b"), right.alias("right"))
    rows = placed.withColumn("s", s)
    s = F.col("s")
    own = F.transform(upto(cell), lambda j: spot(cell, F.least(s, j), cell, F.greatest(s, j), s > j))
    margin = F.flatten(F.transform("near", lambda q: F.transform(upto(q), lambda j: F.when(
        cell < q, spot(cell, s, q, j, F.lit(False))).otherwise(spot(q, j, cell, s, F.lit(True))))))
    return rows.select("id", "v", extra, F.explode(F.concat(own, margin)).alias("t")).select("id", "v", extra, "t.*")


def _radius(threshold: float, metric: str) -> float:
    return math.sqrt(max(0.0, 2 - 2 * threshold)) if metric == "cosine" else threshold


def compared_share(items: DataFrame, threshold: float, metric: str = "cosine", vector: str = "v", block_rows: int = BLOCK_ROWS) -> float:
    """Share of all pairs of rows that the self joins look at; the rest is ruled out by the pivots."""
    tiles = _metric_tiles(items, _radius(threshold, metric), metric, vector, block_rows, "weight", "bigint")
    each = tiles.groupBy("cell", "a", "other", "b").agg(F.count_if("right").alias("r"), F.count(F.lit(1)).alias("n"))
    whole = (F.col("cell") == F.col("other")) & (F.col("a") == F.col("b"))
    looked = each.agg(F.sum(F.when(whole, F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("r") * (F.col("n") - F.col("r"))))).first()[0]
    n = items.filter(F.col(vector).isNotNull()).count()
    return float(looked or 0) / max(1.0, n * (n - 1) / 2)


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of both sides of a tile, and whether it is a block against itself."""
    right = np.asarray(table.column("right").combine_chunks().cast(pa.int8())).astype(bool)
    first = lambda c: table.column(c)[0].as_py()
    whole = first("cell") == first("other") and first("a") == first("b")
    every = np.arange(table.num_rows)
    return (every, every, True) if whole else (every[~right], every[right], False)


def _pairs(items: DataFrame, threshold: float, metric: str, vector: str, block_rows: int) -> DataFrame:
    """Exact self join under a similarity threshold, in tiles of bounded size (see `_metric_tiles`)."""
    spread = _metric_tiles(items, _radius(threshold, metric), metric, vector, block_rows, "weight", "bigint", 4 * block_rows)

    def tile(table: pa.Table) -> pa.Table:
        column = lambda name: table.column(name).combine_chunks()
        ids, m = np.asarray(column("id")), _matrix(column("v"))
        left, other, whole = _sides(table)
        a, b, v = [], [], []
        step = max(1, CELLS // max(1, len(other)))
        for at in range(0, len(left) if len(other) else 0, step):
            part = left[at:at + step]
            s_ = _scores(m[part], m[other], "dot" if metric == "cosine" else "euclid")
            hit = s_ >= threshold if metric == "cosine" else -s_ <= threshold
            if whole:
                hit &= ids[part][:, None] < ids[other][None, :]
            r, c = np.nonzero(hit)
            x, y = part[r], other[c]
            a.append(np.minimum(ids[x], ids[y])), b.append(np.maximum(ids[x], ids[y])), v.append(np.abs(s_[r, c]) if metric == "euclid" else s_[r, c])
        cat = lambda parts, kind: pa.array(np.concatenate(parts).astype(kind) if parts else np.empty(0, kind))
        return pa.table({"a": cat(a, "int64"), "b": cat(b, "int64"), "score": cat(v, "float64")})

    return spread.groupBy("cell", "a", "other", "b").applyInArrow(tile, "a bigint, b bigint, score double")


def sign_code_candidates(items: DataFrame, queries: DataFrame, k: int = 5000, vector: str = "v", **sizes) -> DataFrame:
    """Approximate nearest neighbours: items sharing at least one byte of sign code with a query,
    scored exactly, k best per query.

    Codes are matched inside the tasks that hold a block of items and the queries, so a code
    shared by a third of all rows is no hot join key and its pairs are never emitted.
    """
    return nearest(items, queries, k=k, vector=vector, coded=True, **sizes)


def pair_scores(pairs: DataFrame, scores: dict[str, tuple[str, str]], best: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Cosines of two vector columns per row, for each `name: (left, right)`; the vectors are dropped.

    `best` does the same for a left column that is a list of vectors, taking the highest cosine
    (null for an empty list). Whole Arrow batches are multiplied at once, which beats
    per-element lambdas when many pairs are scored. A vector without length gives null.
    """
    best = best or {}
    vectors = {c for pair in scores.values() for c in pair} | {right for _, right in best.values()}
    lists = {left for left, _ in best.values()}
    kept = [f for f in pairs.schema.fields if f.name not in vectors | lists]
    schema = T.StructType([*kept, *[T.StructField(n, T.DoubleType()) for n in [*scores, *best]]])

    def highest(column, right: np.ndarray) -> np.ndarray:
        count = np.asarray(column.value_lengths().fill_null(0)).astype("int64")
        inner = column.flatten()
        out = np.full(len(count), np.nan)
        if len(inner):
            row = np.repeat(np.arange(len(count)), count)
            cos = np.einsum("ij,ij->i", _unit(_matrix(inner)), right[row])
            filled = np.flatnonzero(count)
            out[filled] = np.fmax.reduceat(cos, (np.cumsum(count) - count)[filled])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            units = {c: _unit(_matrix(b.column(c))) for c in vectors}
            out = [np.einsum("ij,ij->i", units[x], units[y]) for x, y in scores.values()]
            out += [highest(b.column(x), units[y]) for x, y in best.values()]
            yield pa.RecordBatch.from_arrays(
                [b.column(f.name) for f in kept] + [pa.array(o, mask=np.isnan(o)) for o in out], [f.name for f in schema.fields])

    plain = [F.col(c).cast("array<double>").alias(c) for c in vectors]
    nested = [F.col(c).cast("array<array<double>>").alias(c) for c in lists]
    return pairs.select(*[f.name for f in kept], *plain, *nested).mapInArrow(run, schema)


def label_centroids(items: DataFrame, label: str, vector: str = "v") -> DataFrame:
    """Mean vector per label: one partial aggregate over whole vectors."""
    mean = Summarizer.mean(array_to_vector(F.col(vector)))
    return items.groupBy(label).agg(mean.alias("_m")).select(label, vector_to_array("_m").alias("centroid"))


def column_stats(items: DataFrame, vector: str = "v") -> Column:
    """Struct of arrays (mean, population std, lo, hi), one value per component, as a scalar subquery."""
    x = array_to_vector(F.col(vector))
    metrics = Summarizer.metrics("mean", "variance", "min", "max", "count").summary(x)
    s = items.groupBy(F.lit(True)).agg(metrics.alias("s")).select("s.*")  # no row for an empty table
    n = F.col("count")
    population = F.transform(vector_to_array("variance"), lambda v: F.sqrt(v * (n - 1) / n))
    return s.select(F.struct(
        vector_to_array("mean").alias("mean"), population.alias("std"), vector_to_array("min").alias("lo"), vector_to_array("max").alias("hi"),
    )).scalar()


def _with_stats(items: DataFrame, names: list[str], vector: str, out: str, fn) -> DataFrame:
    """Replace each component x by fn(row), where row has x and the component's statistics."""
    zipped = F.arrays_zip(F.col(vector).alias("x"), *[F.col(f"_st.{n}").alias(n) for n in names])
    return items.withColumn("_st", column_stats(items, vector)).withColumn(out, F.transform(zipped, fn)).drop("_st")


def standardise(items: DataFrame, vector: str = "v", out: str = "z") -> DataFrame:
    """(x - mean) / population std per component; a constant component divides by 1."""
    return _with_stats(items, ["mean", "std"], vector, out,
                       lambda r: (r["x"] - r["mean"]) / F.when(r["std"] > 0, r["std"]).otherwise(1.0))


def scalar_quantise(items: DataFrame, vector: str = "v", out: str = "code") -> DataFrame:
    """Components to 256 buckets between the table's minimum and maximum, as -128..127."""
    def bucket(r):
        step = (r["hi"] - r["lo"]) / 255
        return (F.when(step > 0, F.least(F.lit(255.0), F.floor((r["x"] - r["lo"]) / step))).otherwise(0.0) - 128).cast("int")

    return _with_stats(items, ["lo", "hi"], vector, out, bucket)
