"""Hard negatives by angular triangle filtering.

Every vector's angles to a few reference directions are stored with its length. By the triangle
inequality on the sphere, the angle between two vectors lies between the largest difference and the
smallest sum of their angles to a reference; its cosine times both lengths bounds their product. Only
candidates whose bounds overlap a wanted window of scores are scored, in exact integers.

Candidates and anchors are written to shared storage in blocks, sorted by label and angle. A task reads one
block of anchors and streams its share of the candidate blocks, so nothing large is broadcast, joined
or kept: its memory is two blocks, and a lost task starts again from the files.
"""

from __future__ import annotations

import io
import posixpath
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from threadloom.llm.common import commit_file, kept, make_folder, partitions, ragged, store
from threadloom.llm.topk_search import Best

REFERENCES = 8
CANDIDATES = 16_384  # rows of a candidate block
ANCHORS = 4_096      # rows of an anchor block at most
TILE = 4_096         # candidates bounded at once
SLACK = 1e-6         # radians; arc cosines of rounded products err by less than 1e-7
LIMIT = (1 << 63) - 1
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of rows; those beyond 64 bits become the largest or smallest number that fits."""
    large = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * max(1, a.shape[1])
    if large < 2.0 ** 53:
        return np.rint(a.astype(float) @ x.astype(float).T).astype(np.int64)
    if large < 2.0 ** 62:
        return a.astype(np.int64) @ x.astype(np.int64).T
    exact = a.astype(object) @ x.astype(object).T
    return np.clip(exact, -LIMIT, LIMIT).astype(np.int64)


def angles_to(vectors: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(angles, lengths) of rows; a vector without length has angle 0, which its length makes harmless."""
    v = vectors.astype(float)
    scale = np.abs(v).max(axis=1, initial=0)
    unit = v / np.where(scale > 0, scale, 1)[:, None]
    length = np.sqrt((unit * unit).sum(axis=1))
    cosine = (unit @ references.T) / np.where(length > 0, length, 1)[:, None]
    cosine[length == 0] = 1
    return np.arccos(np.clip(cosine, -1, 1)), length * scale


def score_bounds(angles_a: np.ndarray, length_a: np.ndarray, angles_x: np.ndarray, length_x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest product of every pair of rows, rounded outwards."""
    least = np.zeros((len(angles_a), len(angles_x)))
    most = np.full(least.shape, np.pi)
    for a, x in zip(angles_a.T, angles_x.T):
        np.maximum(least, np.abs(a[:, None] - x), out=least)
        both = a[:, None] + x
        np.minimum(most, np.minimum(both, 2 * np.pi - both), out=most)
    size = length_a[:, None] * length_x
    pad = size * 1e-9 + 1
    return size * np.cos(np.minimum(most + SLACK, np.pi)) - pad, size * np.cos(np.maximum(least - SLACK, 0)) + pad


class Block:
    """Some rows with their vectors, angles and lengths, as one file."""

    FIELDS = ("rows", "ids", "labels", "matrix", "lengths", "angles")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    def save(self, folder: str, file: str) -> None:
        raw = io.BytesIO()
        span = np.array([self.labels.min(), self.labels.max()])
        np.savez(raw, span=span, **{k: v for k, v in self.__dict__.items()})
        commit_file(folder, file, lambda out: out.write(raw.getvalue()))

    @classmethod
    def load(cls, folder: str, file: str, wanted: Callable[[int, int], bool] | None = None) -> Block | None:
        """The block, or None if its range of labels is not wanted (only that is read then)."""
        fs, base = store(folder)
        with fs.open_input_file(posixpath.join(base, file)) as f, np.load(f) as z:
            if wanted is not None and not wanted(*z["span"].tolist()):
                return None
            return cls(**{k: z[k] for k in z.files if k != "span"})


def matrix_of(vectors: pa.Array, dims: int) -> np.ndarray:
    """Rows of integers in the smallest type that holds them; shorter vectors are filled with zeros."""
    n = len(vectors)
    lengths = np.asarray(vectors.value_lengths()).astype(np.int64)
    flat = np.asarray(vectors.flatten()).astype(np.int64)
    out = np.zeros((n, dims), np.int64)
    out[np.repeat(np.arange(n), lengths), ragged(np.zeros(n, np.int64), lengths)] = flat
    low, high = int(flat.min(initial=0)), int(flat.max(initial=0))
    kind = next(k for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return out.astype(kind)


def _vector_angle(rows: DataFrame, references: np.ndarray) -> DataFrame:
    """`rows` with the angle to the first reference, by which blocks are sorted."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                angle = angles_to(matrix_of(b.column("vector"), references.shape[1]), references[:1])[0][:, 0]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(angle)], [*b.schema.names, "angle"])

    return rows.mapInArrow(place, T.StructType([*rows.schema.fields, T.StructField("angle", T.DoubleType())]))


def write_blocks(rows: DataFrame, references: np.ndarray, size: int, windows: bool = False) -> tuple[str, list[str]]:
    """Folder and names of the blocks of (row, id, label, vector, angle), each of at most `size` rows.

    With `windows` the rows have a list of wanted (low, high) scores, kept with the block. Names come from
    the tasks that ended well, so files of a lost attempt are never read.
    """
    spark = rows.sparkSession
    folder = make_folder(spark, "blocks")
    columns = ["row", "id", "label", "vector", *(["windows"] if windows else [])]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> pa.RecordBatch:
            nonlocal k
            column = lambda c: table.column(c).combine_chunks()
            matrix = matrix_of(column("vector"), references.shape[1])
            angles, lengths = angles_to(matrix, references)
            arrays = {"rows": np.asarray(column("row")), "ids": np.asarray(column("id")), "labels": np.asarray(column("label")),
                      "matrix": matrix, "lengths": lengths, "angles": angles}
            if windows:
                lists = column("windows")
                arrays |= {"n_windows": np.asarray(lists.value_lengths()).astype(np.int64),
                           "low": np.asarray(lists.flatten().field("low")), "high": np.asarray(lists.flatten().field("high"))}
            file = f"{part:06d}-{k:06d}.npz"
            k += 1
            Block(**arrays).save(folder, file)
            return pa.RecordBatch.from_pydict({"file": [file]})

        rows_held = 0
        for batch in batches:
            held.append(batch)
            rows_held += batch.num_rows
            while rows_held >= size:
                table = pa.Table.from_batches(held)
                yield flush(table.slice(0, size))
                held, rows_held = table.slice(size).to_batches(), rows_held - size
        if rows_held:
            yield flush(pa.Table.from_batches(held))

    dealt = rows.repartitionByRange(partitions(spark), "label", "angle", "row").sortWithinPartitions("label", "angle", "row")
    files = kept(dealt.select(columns).mapInArrow(build, "file string"), "names")
    return folder, sorted(r["file"] for r in files.collect())  # a name per block of rows


def _grid(spark: SparkSession, anchors: list[str], candidates: list[str]) -> tuple[DataFrame, int]:
    """One row per task: a block of anchors and a share of the candidate blocks, dealt in turn so that a
    label with many rows is spread over all shares."""
    shares = max(1, min(len(candidates), -(-4 * spark.sparkContext.defaultParallelism // max(1, len(anchors)))))
    return spark.range(0, len(anchors) * shares, 1, max(1, len(anchors) * shares)), shares


def search(spark: SparkSession, anchors: tuple[str, list[str]], candidates: tuple[str, list[str]], make: Callable, schema: str) -> DataFrame:
    """Rows that `make(anchor block)` finds; it returns an object with `wanted`, `offer(block)` and `rows()`."""
    grid, shares = _grid(spark, anchors[1], candidates[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in batch.column(0).to_pylist():
                a, share = divmod(item, shares)
                found = make(Block.load(anchors[0], anchors[1][a]))
                for file in candidates[1][share::shares]:
                    block = Block.load(candidates[0], file, found.wanted)
                    if block is not None:
                        found.offer(block)
                yield found.rows()

    return grid.mapInArrow(run, schema)


def _tiles(anchors: Block, block: Block, fits: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple]:
    """(anchor places, candidate slice, low bounds, high bounds, which pairs `fits` allows), in bounded pieces."""
    step = max(1, (1 << 20) // TILE)
    for x in range(0, len(block.ids), TILE):
        cut = slice(x, x + TILE)
        for a in range(0, len(anchors.ids), step):
            at = np.arange(a, min(a + step, len(anchors.ids)))
            pairs = fits(anchors.labels[at][:, None], block.labels[cut]) & (anchors.rows[at][:, None] != block.rows[cut])
            some = pairs.any(axis=1)
            if some.any():
                at = at[some]
                low, high = score_bounds(anchors.angles[at], anchors.lengths[at], block.angles[cut], block.lengths[cut])
                yield at, cut, low, high, pairs[some]


def _scored(anchors: Block, at: np.ndarray, block: Block, cut: slice, pairs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, scores, ids) of the pairs that are left; a dense tile is one matrix product."""
    if pairs.mean() > 0.2:
        scores = products(anchors.matrix[at], block.matrix[cut])
        for k, i in enumerate(at):
            if pairs[k].any():
                yield i, scores[k, pairs[k]], block.ids[cut][pairs[k]]
    else:
        for k, i in enumerate(at):
            few = np.flatnonzero(pairs[k])
            if len(few):
                yield i, products(anchors.matrix[i][None], block.matrix[cut][few])[0], block.ids[cut][few]


class Positives:
    """The k best rows of the same label for each anchor of a block."""

    def __init__(self, anchors: Block, k: int):
        self.anchors, self.best = anchors, Best(len(anchors.ids), k)
        self.labels = np.unique(anchors.labels)

    def wanted(self, low: int, high: int) -> bool:
        return bool(np.searchsorted(self.labels, low) < np.searchsorted(self.labels, high, "right"))

    def offer(self, block: Block) -> None:
        for at, cut, _, high, pairs in _tiles(self.anchors, block, np.equal):
            for i, scores, ids in _scored(self.anchors, at, block, cut, pairs & (high >= self.best.floor[at][:, None])):
                good = scores >= self.best.floor[i]
                if good.any():
                    self.best.offer(i, scores[good], ids[good])

    def rows(self) -> pa.RecordBatch:
        n = [len(s) for s in self.best.score]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.anchors.rows, n)), pa.array(np.concatenate(self.best.ids)), pa.array(np.concatenate(self.best.score))],
            ["row", "positive_id", "positive_score"])


class Negatives:
    """The k best rows of other labels inside each of an anchor's score windows."""

    def __init__(self, anchors: Block, k: int):
        self.anchors = anchors
        self.best = Best(len(anchors.low), k)
        self.first = np.concatenate([[0], np.cumsum(anchors.n_windows)])
        of = lambda f, v: f.reduceat(v, self.first[:-1]) if len(v) else np.zeros(0)  # noqa: E731  every anchor has a window
        self.high = of(np.maximum, anchors.high).astype(float)
        self.reach = anchors.low.astype(float)  # what a score must have to enter each window's best

    def wanted(self, low: int, high: int) -> bool:
        return low != high or bool((self.anchors.labels != low).any())

    def offer(self, block: Block) -> None:
        for at, cut, low, high, pairs in _tiles(self.anchors, block, np.not_equal):
            least = np.array([self.reach[self.first[i]: self.first[i + 1]].min() for i in at])
            pairs = pairs & (high >= least[:, None]) & (low <= self.high[at][:, None])
            for i, scores, ids in _scored(self.anchors, at, block, cut, pairs):
                for w in range(self.first[i], self.first[i + 1]):
                    inside = (scores <= self.anchors.high[w]) & (scores >= self.anchors.low[w]) & (scores >= self.best.floor[w])
                    if inside.any():
                        self.best.offer(w, scores[inside], ids[inside])
                        self.reach[w] = max(self.reach[w], self.best.floor[w])

    def rows(self) -> pa.RecordBatch:
        n = np.array([len(s) for s in self.best.score], np.int64)
        window = np.arange(len(n)) - np.repeat(self.first[:-1], self.anchors.n_windows)
        row = np.repeat(self.anchors.rows, self.anchors.n_windows)
        cat = lambda x: np.concatenate(x) if len(x) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(row, n)), pa.array(np.repeat(window, n)), pa.array(cat(self.best.ids)), pa.array(cat(self.best.score))],
            ["row", "place", "negative_id", "negative_score"])


def reference_directions(rows: DataFrame, count: int = REFERENCES) -> np.ndarray:
    """Unit vectors: the lowest id's vector of each of the most frequent labels. They never change a result."""
    first = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "row", "vector")).alias("v"))
    found = [r["vector"] for r in first.orderBy(F.desc("n"), "label").limit(count).select("v.vector").collect()]
    dims = rows.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0]
    out = np.zeros((len(found), dims))
    for k, v in enumerate(found):
        out[k, : len(v)] = np.array(v, float) / max(1.0, float(max(map(abs, v), default=0)))
    length = np.sqrt((out * out).sum(axis=1))
    out = out[length > 0] / length[length > 0, None]
    return out if len(out) else np.eye(1, dims)


def hard_negatives(vectors: DataFrame, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor row.

    `vectors` has `id`, `label` (whole numbers), `vector` (array<long>) and `is_anchor`. An anchor's positives are
    its best other rows of the same label; for each, the negatives are the best rows of another label with
    low * positive_score <= 100 * score <= high * positive_score. Higher scores first, ties by smaller id.

    Rows with a null id, label or vector take no part; other columns are ignored. Repeated rows and ids are
    rows of their own, shorter vectors are filled with zeros, and scores beyond 64 bits count as the largest
    (smallest) 64-bit number. An empty table, or one without anchors, gives no rows.
    """
    spark = vectors.sparkSession
    rows = kept(vectors.filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").select(
        F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
        F.col("vector").cast("array<long>").alias("vector"), F.coalesce("is_anchor", F.lit(False)).alias("is_anchor")), "vectors")
    n_anchors = rows.filter("is_anchor").count()
    if not n_anchors:
        return spark.createDataFrame([], SCHEMA)
    references = reference_directions(rows)
    placed = _vector_angle(rows, references)
    candidates = write_blocks(placed, references, CANDIDATES)
    per_block = max(1, min(ANCHORS, -(-n_anchors // partitions(spark))))
    anchors = write_blocks(placed.filter("is_anchor"), references, per_block)
    found = search(spark, anchors, candidates, lambda block: Positives(block, n_positives), "row long, positive_id long, positive_score long")
    order = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    positives = kept(found.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < n_positives), "positives")

    wide = F.col("positive_score").cast("decimal(20,0)")
    edge = lambda share, up: F.call_function("ceil" if up else "floor", wide * F.lit(share) / F.lit(100).cast("decimal(3,0)")).cast("long")
    windows = positives.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
        "place", edge(low, True).alias("low"), edge(high, False).alias("high")))).alias("windows"))  # n_positives entries
    asked = placed.filter("is_anchor").join(windows, "row")
    anchors = write_blocks(asked, references, per_block, windows=True)
    found = search(spark, anchors, candidates, lambda block: Negatives(block, n_negatives), "row long, place long, negative_id long, negative_score long")
    order = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_negatives)
    named = positives.join(rows.filter("is_anchor").select("row", F.col("id").alias("anchor_id")), "row")
    return best.join(named, ["row", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
