"""Grouping and trained factors against definitions written out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import cluster as CL, recs


def plain_average_linkage(vectors, cut, euclid):
    """Merge the nearest pair of groups until none is within the cut; groups by smallest member."""
    far = (lambda a, b: ((a - b) ** 2).sum()) if euclid else (lambda a, b: 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    groups = [[i] for i in range(len(vectors))]
    while len(groups) > 1:
        mean = lambda g, h: np.mean([far(vectors[i], vectors[j]) for i in g for j in h])
        d, a, b = min((mean(g, h), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
        if (np.sqrt(d) if euclid else d) > cut:
            break
        groups[a] += groups.pop(b)
    return {i: min(g) for g in groups for i in g}


@pytest.mark.parametrize("euclid", [False, True])
def test_average_linkage(spark, euclid):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 5)) * 2
    vectors = [centres[i % 4] + rng.normal(size=5) * 0.8 for i in range(18)]
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "cluster bigint, v array<double>")
    cut = 3.0 if euclid else 0.3
    got = {r.cluster: r.group for r in CL.merge_average_linkage(frame, cut, euclid=euclid).collect()}
    want = plain_average_linkage(vectors, cut, euclid)
    assert got == want and 1 < len(set(want.values())) < 18


def test_chains_are_not_one_group(spark):
    """A is near B and B near C, but A is far from C."""
    angles = [0.0, 0.6, 1.25]
    frame = spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles)], "cluster bigint, v array<double>")
    got = {r.cluster: r.group for r in CL.merge_average_linkage(frame, 0.25).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_factors_beat_chance(spark):
    """Two tastes: users click items of their own half."""
    rng = np.random.default_rng(5)
    rows = []
    for day in (1, 2):
        for user in range(40):
            for item in rng.choice(60, 12, replace=False):
                own = (user % 2) == (item % 2)
                rows.append((f"{user}-{day}", user, int(item), int(own and rng.random() < 0.8), day))
    log = spark.createDataFrame(rows, "imp_id string, user_id bigint, item bigint, label bigint, day int")
    users, items = recs.train_factors(log.filter("day = 1"), rank=4, seed=7)
    scored = recs.score_impressions(log.filter("day = 2"), users, items).fillna(0.0, ["score"])
    assert recs.evaluate(scored).first().auc > 0.8


def test_cold_users_and_items_are_scored(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id bigint, v array<double>")
    users = spark.createDataFrame([(7, [1.0, 0.0])], "id bigint, v array<double>")
    pairs = spark.createDataFrame([(7, 1, 1), (7, 2, 0)] * 5, "user_id bigint, item bigint, label int")
    model, featurise = recs.train_content_model(pairs, users, items, iterations=3)
    asked = spark.createDataFrame([(7, 1), (8, 1), (7, 3), (8, 3)], "user_id bigint, item bigint")
    assert model.transform(featurise(asked)).filter(F.col("probability").isNotNull()).count() == 4
