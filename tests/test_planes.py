"""The hyperplane index: recall against the exact search, hot bands, awkward rows."""

import duckdb
import numpy as np
import pytest

from threadloom.operators import nearest as NN, planes


def frame(spark, m, name="id"):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], f"{name} bigint, v array<double>")


def given():
    return np.array([r[0] for r in duckdb.sql("SELECT embedding FROM '/root/testdata/sf0.01/embeddings.parquet' ORDER BY vec_id").fetchall()], float)


def skewed():
    """Vectors that all point much the same way."""
    rng = np.random.default_rng(2)
    return 0.7 * given() + 0.3 * rng.standard_normal(64)


def hot():
    """A third of all rows is one crowd, in one band of every table."""
    rng = np.random.default_rng(3)
    return np.vstack([given()[:400], given()[0] + 0.001 * rng.standard_normal((200, 64))])


@pytest.mark.parametrize("make", [given, skewed, hot])
def test_recall_and_share_read(spark, make):
    m = make()
    items, queries = frame(spark, m).cache(), frame(spark, m[::7], "qid").cache()
    index = planes.plane_index(items)
    exact = {(r["qid"], r["id"]) for r in NN.nearest(items, queries, k=10).collect()}
    got = index.search(queries, 10).collect()
    assert len({(r["qid"], r["id"]) for r in got} & exact) / len(exact) >= 0.9
    assert index.share_read(queries) < 0.7
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    assert all(abs(r["score"] - unit[r["qid"] * 7] @ unit[r["id"]]) < 1e-9 for r in got)


def test_blocks_of_a_hot_band_give_the_same_rows(spark):
    m = hot()
    queries = frame(spark, m[:9], "qid")
    want = sorted(map(tuple, planes.ann_candidates(frame(spark, m), queries, k=30).collect()))
    assert sorted(map(tuple, planes.ann_candidates(frame(spark, m), queries, k=30, block_rows=16).collect())) == want


def test_clustered_vectors_are_found_with_few_bands(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((20, 64))
    m = np.repeat(centres, 20, axis=0) + 0.2 * rng.standard_normal((400, 64))
    items, queries = frame(spark, m), frame(spark, centres, "qid")
    index = planes.plane_index(items, tables=6, bits=10)
    exact = {(r["qid"], r["id"]) for r in NN.nearest(items, queries, k=10).collect()}
    assert len({(r["qid"], r["id"]) for r in index.search(queries, 10, probes=8).collect()} & exact) / len(exact) > 0.95
    assert index.share_read(queries, 8) < 0.3


def test_awkward_rows(spark):
    schema = "id bigint, v array<double>"
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0]), (5, [-1.0, 0.5])]
    items = spark.createDataFrame(rows, schema)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (1, [1.0, 0.0])], "qid bigint, v array<double>")
    got = planes.ann_candidates(items, queries, k=2, probes=256).collect()
    assert sorted((r["qid"], r["id"]) for r in got) == [(1, 1), (1, 4)]
    assert planes.ann_candidates(items.limit(0), queries, k=2).collect() == []
