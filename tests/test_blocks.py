"""Self joins over blocks that tasks stream, against brute force."""

import numpy as np
import pytest

from threadloom.operators import blocks as B, nearest as NN


def frame(spark, m, weight=None):
    w = np.ones(len(m), int) if weight is None else weight
    return spark.createDataFrame([(i, [float(x) for x in r], int(k)) for i, (r, k) in enumerate(zip(m, w))], "id bigint, v array<double>, weight bigint").repartition(3)


def groups(seed, sizes, dims=6, spread=0.3, apart=4.0):
    rng = np.random.default_rng(seed)
    return np.vstack([apart * rng.standard_normal(dims) + spread * rng.standard_normal((n, dims)) for n in sizes])


def parts(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        x, y = label[a], label[b]
        label = [min(x, y) if k in (x, y) else k for k in label]
    return label


@pytest.mark.parametrize("block,seed,eps", [(16, 1, 0.7), (40, 2, 9.0)])
def test_streamed_self_joins_equal_brute_force(spark, monkeypatch, block, seed, eps):
    monkeypatch.setattr(B, "FEW_ROWS", 8)
    m = np.vstack([groups(seed, [60, 30, 45, 5]), 12 * np.random.default_rng(seed).standard_normal((20, 6))])
    w = np.random.default_rng(seed).integers(1, 4, len(m))
    d = np.round(np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1)), 12)
    np.fill_diagonal(d, np.inf)
    df = frame(spark, m, w).cache()
    n = {r["id"]: r["n"] for r in NN.neighbour_counts(df, eps, "euclid", block_rows=block).collect()}
    want = ((d <= eps) * w).sum(axis=1)
    assert n == {i: k for i, k in enumerate(want.tolist()) if k}
    some = {r["id"]: r["n"] for r in NN.neighbour_counts(df, eps, "euclid", block_rows=block, enough=5).collect()}
    assert set(some) == set(n) and all(min(5, some[i]) == min(5, n[i]) and some[i] <= n[i] for i in n)
    edges = [(r["a"], r["b"]) for r in NN.similar_forest(df, eps, "euclid", block_rows=block).collect()]
    assert parts(len(m), edges) == parts(len(m), np.argwhere(d <= eps).tolist())
    near = {(r["id"], r["other"]) for r in NN.similar_neighbours(df, eps, 4, "euclid", block_rows=block).collect()}
    assert near == {(i, j) for i in range(len(m)) for _, j in sorted((d[i, j], j) for j in range(len(m)) if d[i, j] <= eps)[:4]}


def test_a_row_is_written_once_whatever_blocks_it_meets(spark, monkeypatch):
    """Random directions, which no pivot tells apart: 40 blocks hold every row once and meet one another."""
    monkeypatch.setattr(B, "FEW_ROWS", 8)
    df = frame(spark, np.random.default_rng(5).standard_normal((1000, 16)))
    kept = B.write_blocks(df, float("inf"), "euclid", "v", "weight", "bigint", 25)
    assert len(kept.names) == 40 and kept.rows.sum() == 1000
    assert sorted(kept.met(3)) == list(range(40))
    ring = [(i, j) for i in range(40) for j in kept.met(i, range(0, 21))]
    assert len({frozenset(p) for p in ring}) == len(ring) == 40 * 41 // 2
    ids = np.sort(np.concatenate([kept.load(j).ids for j in range(40)]))
    assert np.array_equal(ids, np.arange(1000))


def test_vectors_that_32_bits_cannot_tell_apart(spark):
    """Differences far below the precision of the products, and lengths beyond 32 bits: the limits are still exact."""
    base = np.full((6, 3), 1000.0)
    base[:, 0] += np.array([0, 1e-7, 2e-7, 4e-7, 8e-7, 1.6e-6])
    got = {(r["id"], r["other"]) for r in NN.similar_neighbours(frame(spark, base), 1.05e-7, 5, "euclid").collect()}
    assert got == {(0, 1), (1, 0), (1, 2), (2, 1)}
    huge = np.array([[1e30, 0.0], [1e30, 1e28], [0.0, 1e30]])
    assert {r["id"]: r["n"] for r in NN.neighbour_counts(frame(spark, huge), 2e28, "euclid").collect()} == {0: 1, 1: 1}
