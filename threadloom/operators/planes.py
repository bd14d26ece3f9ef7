"""Approximate nearest neighbours by random hyperplanes (Charikar 2002) with multi-probe.

The index is a stored band table: in each of several tables a row's code tells on which side of
some hyperplanes its unit vector lies, and the table is sorted by (table, code), so a search reads only
the bands its queries probe. A query probes its own code and those that differ in its least certain
bits. Hot bands are cut into blocks; a task scores one block against the queries that probe it, exactly,
and emits its k best per query.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadloom.operators.nearest import BLOCK_ROWS, Best, _batch, _matrix, _scores, _unit
from threadloom.operators.ranking import top_k_per_group
from threadloom.runtime import stored

SAMPLE = 4096  # rows whose medians place the hyperplanes


def _rows(codes: np.ndarray, batch: pa.RecordBatch, m: np.ndarray, name: str) -> pa.RecordBatch:
    """One row per (row, table, code); `codes` is (rows, tables, codes per table)."""
    n, tables, each = codes.shape
    row = np.repeat(np.arange(n), tables * each)
    table = np.tile(np.repeat(np.arange(tables), each), n)
    v = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, max(1, m.shape[1]), dtype="int32")), pa.array(m.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(table.astype("int32")), pa.array(codes.ravel()), batch.column(0).take(pa.array(row)),
                                       v.take(pa.array(row))], ["table", "code", name, "v"])


@dataclass
class PlaneIndex:
    """`bands` has (table, code, id, v) with unit vectors, `sizes` the rows of each band."""

    planes: np.ndarray   # (tables * bits, dims)
    cuts: np.ndarray     # where each plane lies
    tables: int
    bits: int
    bands: DataFrame
    sizes: DataFrame
    block_rows: int

    def _probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """(table, code, qid, v): the `probes` most likely codes of each query in each table."""
        planes, cuts, tables, bits = self.planes, self.cuts, self.tables, self.bits
        flips = [f for n in range(min(3, bits) + 1) for f in itertools.combinations(range(bits), n)]
        flips = flips[: max(probes, 1 + bits + bits * (bits - 1) // 2)]
        member = np.zeros((len(flips), bits))
        for k, f in enumerate(flips):
            member[k, list(f)] = 1
        change = (member @ (1 << np.arange(bits))).astype(np.int64)

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = _unit(_matrix(b.column(1))) if b.num_rows else np.zeros((0, 0))
                fine = ~np.isnan(m).any(axis=1)
                m, b = m[fine], b.filter(pa.array(fine))
                if not len(m) or m.shape[1] != planes.shape[1]:  # an empty index has no dimensions
                    continue
                side = (m @ planes.T - cuts).reshape(len(m), tables, bits)
                own = ((side > 0) * (1 << np.arange(bits))).sum(axis=2)
                cost = np.abs(side) @ member.T  # how far the query would have to move
                best = np.argsort(cost, axis=2, kind="stable")[:, :, :probes]
                yield _rows(own[:, :, None] ^ change[best], b, m, "qid")

        asked = queries.select(F.col("qid").cast("bigint"), F.col("v").cast("array<double>")).filter("v IS NOT NULL").dropDuplicates(["qid"])
        return asked.mapInArrow(probe, "table int, code bigint, qid bigint, v array<double>")

    def search(self, queries: DataFrame, k: int, probes: int = 32) -> DataFrame:
        """(qid, id, score): the k best of the probed bands per query by exact cosine, lowest id on a tie."""
        probed = stored(self._probed(queries, probes), "probed")
        wanted = stored(probed.select("table", "code").distinct().join(self.sizes, ["table", "code"]), "wanted")
        blocks = F.ceil(F.col("n") / F.lit(self.block_rows)).cast("int")
        left = self.bands.join(wanted, ["table", "code"]).select("table", "code", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), "id", "v")
        right = probed.join(wanted, ["table", "code"]).select("table", "code", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "qid", "v")

        def score(x: pa.Table, q: pa.Table) -> pa.Table:
            found = [_batch(np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0))]
            if x.num_rows and q.num_rows:
                ids, m = np.asarray(x.column("id").combine_chunks()), _matrix(x.column("v").combine_chunks())
                qids, asked = np.asarray(q.column("qid").combine_chunks()), _matrix(q.column("v").combine_chunks())
                step = max(1, 4_000_000 // len(ids))
                for at in range(0, len(qids), step):  # bounded pieces, however many queries probe a band
                    best = Best(len(qids[at:at + step]), k)
                    best.add(ids, _scores(m, asked[at:at + step], "cosine"), None)
                    found.append(best.rows(qids[at:at + step]))
            return pa.Table.from_batches(found)

        keys = ("table", "code", "block")
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, "qid bigint, id bigint, score double")
        return top_k_per_group(found.groupBy("qid", "id").agg(F.max("score").alias("score")), ["qid"], [F.desc("score"), F.col("id")], k).drop("rn")

    def share_read(self, queries: DataFrame, probes: int = 32) -> float:
        """Mean share of all items that a query is scored against."""
        met = self._probed(queries, probes).join(self.bands.select("table", "code", "id"), ["table", "code"]).select("qid", "id").distinct()
        each = met.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n")).first()[0] or 0
        n = self.bands.filter("table = 0").count()
        return each / max(1, n * queries.select("qid").distinct().count())


def plane_index(items: DataFrame, tables: int = 8, bits: int = 8, vector: str = "v", seed: int = 1, block_rows: int = BLOCK_ROWS) -> PlaneIndex:
    """Index every row with a vector that has a length.

    Plane directions are random; each lies at the median of a hashed sample of SAMPLE rows, so that bands stay
    even when all vectors point much the same way. More bits make bands smaller, more tables and probes find more.
    """
    base = items.select(F.col("id").cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    rows = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    sample = _unit(np.array([r["v"] for r in rows], "float64").reshape(len(rows), -1)) if rows else np.zeros((0, 0))
    sample = sample[~np.isnan(sample).any(axis=1)]
    planes = np.random.default_rng(seed).standard_normal((tables * bits, sample.shape[1]))
    cuts = np.median(sample @ planes.T, axis=0) if len(sample) else np.zeros(tables * bits)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _unit(_matrix(b.column(1))) if b.num_rows else np.zeros((0, 0))
            fine = ~np.isnan(m).any(axis=1)
            m, b = m[fine], b.filter(pa.array(fine))
            if len(m):
                side = (m @ planes.T - cuts).reshape(len(m), tables, bits)
                yield _rows(((side > 0) * (1 << np.arange(bits))).sum(axis=2)[:, :, None], b, m, "id")

    coded = base.mapInArrow(encode, "table int, code bigint, id bigint, v array<double>")
    bands = stored(coded.repartitionByRange("table", "code", "id").sortWithinPartitions("table", "code"), "bands")
    sizes = stored(bands.groupBy("table", "code").agg(F.count(F.lit(1)).alias("n")), "sizes")
    return PlaneIndex(planes, cuts, tables, bits, bands, sizes, block_rows)


def ann_candidates(items: DataFrame, queries: DataFrame, k: int = 5000, vector: str = "v", probes: int = 32, **index) -> DataFrame:
    """(qid, id, score): approximate nearest neighbours from an index built for this search."""
    return plane_index(items, vector=vector, **index).search(queries, k, probes)
