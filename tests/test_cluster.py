"""Affinity propagation, the density hierarchy and the pivot partition against written-out versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import affinity, cluster as CL, hierarchy, nearest as NN


def frame(spark, m, parts=3):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id bigint, v array<double>").repartition(parts)


def blobs(rng, centres, per, spread):
    return np.vstack([c + s * rng.standard_normal((n, len(c))) for c, n, s in zip(centres, per, spread)])


# --- affinity propagation -------------------------------------------------------------------------------

def dense_affinity(s, damping=0.5, patience=15, rounds=200):
    """Frey and Dueck's updates on a dense matrix with -inf for pairs that are no edge; one component."""
    n = len(s)
    r, a = np.zeros((n, n)), np.zeros((n, n))
    last, still = np.zeros(n, bool), 0
    for _ in range(rounds):
        for i in range(n):
            for_k = r[i].copy()
            for k in range(n):
                if np.isfinite(s[i, k]):
                    others = [a[i, j] + s[i, j] for j in range(n) if j != k and np.isfinite(s[i, j])]
                    for_k[k] = damping * r[i, k] + (1 - damping) * (s[i, k] - max(others))
            r[i] = for_k
        plus = np.where(np.isfinite(s), np.maximum(r, 0), 0)
        np.fill_diagonal(plus, 0)
        for k in range(n):
            total = plus[:, k].sum()
            for i in range(n):
                if np.isfinite(s[i, k]):
                    new = total if i == k else min(0, r[k, k] + total - plus[i, k])
                    a[i, k] = damping * a[i, k] + (1 - damping) * new
        now = np.diag(a) + np.diag(r) > 0
        still = still + 1 if (now == last).all() and now.any() else 0
        last = now
        if still >= patience:
            break
    return last


@pytest.fixture(scope="module")
def three_hundred(spark):
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((14, 8))
    m = np.vstack([blobs(rng, centres, [20] * 14, [0.12, 0.3] * 7), rng.standard_normal((20, 8))])
    m[37], m[38] = m[36], m[36]  # copies
    return m, frame(spark, m)


@pytest.mark.parametrize("local", [affinity.LOCAL_EDGES, 200])
def test_exemplars_equal_the_dense_algorithm(spark, three_hundred, local):
    """300 vectors; with a small limit the larger components go through the message tables."""
    m, df = three_hundred
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    reps, _ = NN.collapse_copies(df)
    reps = reps.cache()
    weight = {r["id"]: r["weight"] for r in reps.select("id", "weight").collect()}
    edges = affinity.similarities(reps, 0.8, 12).cache()
    rows = edges.collect()
    near = {i: sorted(((round(-float(unit[i] @ unit[j]), 12), j) for j in weight if j != i and round(float(unit[i] @ unit[j]), 12) >= 0.8))[:12] for i in weight}
    assert {(r["i"], r["k"]) for r in rows if r["i"] != r["k"]} == {(i, j) for i, found in near.items() for _, j in found}
    for r in rows:
        want = -0.4 if r["i"] == r["k"] else weight[r["i"]] * (2 * unit[r["i"]] @ unit[r["k"]] - 2)
        assert abs(r["s"] - want) < 2e-7
    parts = CL.connected_components(edges.filter("i <> k").select(F.col("i").alias("a"), F.col("k").alias("b"))).cache()
    got = {r["i"]: r["k"] for r in affinity.affinity_exemplars(edges, parts, local_edges=local).collect()}
    of = {r["id"]: r["component"] for r in parts.collect()}
    assert len(set(of.values())) > 3
    for component in set(of.values()):
        ids = sorted(i for i, c in of.items() if c == component)
        s = np.full((len(ids), len(ids)), -np.inf)
        at = {i: p for p, i in enumerate(ids)}
        for r in rows:
            if r["i"] in at:
                s[at[r["i"]], at[r["k"]]] = r["s"]
        chosen = dense_affinity(s)
        for i in ids:
            reach = [(-s[at[i], p], ids[p]) for p in range(len(ids)) if chosen[p] and np.isfinite(s[at[i], p])]
            want = i if chosen[at[i]] else min(reach)[1] if reach else None
            assert got.get(i) == want


def test_far_members_and_single_ones_go_to_misc(spark, three_hundred):
    m, df = three_hundred
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = {r["id"]: (r["cluster"], r["distance"]) for r in CL.exemplar_clusters(df, 0.8, max_distance=0.15).collect()}
    assert set(got) == set(range(300)) and got[36] == got[37] == got[38]
    sizes = {}
    for i, (c, d) in got.items():
        if c == CL.MISC:
            assert d is None
        else:
            assert d <= 0.15 + 1e-9 and abs(d - (1 - unit[i] @ unit[c])) < 1e-9 and got[c][0] == c
            sizes[c] = sizes.get(c, 0) + 1
    assert len(sizes) > 5 and min(sizes.values()) > 1


def test_a_crowd_of_copies_is_one_item_and_near_copies_stay_linear(spark):
    rng = np.random.default_rng(3)
    m = np.vstack([np.tile([1.0, 0, 0, 0], (500, 1)), np.tile([0, 1.0, 0, 0], (1, 1)), [[0.0] * 4],
                   [0, 0, 1.0, 0] + 0.001 * rng.standard_normal((400, 4))])
    df = frame(spark, m)
    reps, _ = NN.collapse_copies(df.filter("id <> 501"))
    assert affinity.similarities(reps, 0.85, 8).count() <= 9 * 402  # not 400 * 400
    got = {r["id"]: r["cluster"] for r in CL.exemplar_clusters(df, neighbours=8).collect()}
    assert {got[i] for i in range(500)} == {0} and got[500] == got[501] == CL.MISC
    assert CL.MISC not in {got[i] for i in range(502, 902)}


# --- density hierarchy ----------------------------------------------------------------------------------

def brute_hierarchy(z, weight, min_size, min_samples, radius=None):
    """Single linkage over all pairs under mutual reachability, condensed from the root, excess of mass."""
    n = len(z)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    core = []
    for i in range(n):
        others = sorted((d[i, j], j) for j in range(n) if j != i)
        have, value = weight[i] - 1, 0.0
        if have < min_samples:
            for dist, j in others:
                have += weight[j]
                value = dist
                if have >= min_samples:
                    break
        core.append(value)
    floor = lambda w: max(round(w, 9), 1e-9)
    edges = [(floor(core[i]), 0, i, i) for i in range(n) if weight[i] > 1]
    edges += [(floor(max(d[i, j], core[i], core[j])), 1, i, j) for i, j in itertools.combinations(range(n), 2)
              if radius is None or floor(max(d[i, j], core[i], core[j])) <= radius]
    nodes = {i: ("point", i) for i in range(n)}  # component -> its dendrogram node
    size = {("point", i): 1 for i in range(n)}
    of = list(range(n))
    kids = {}
    for e in sorted(edges):
        w, kind, a, b = e
        ca, cb = of[a], of[b]
        if kind == 0:
            node = ("copies", a)
            kids[node], size[node] = (1 / w, [nodes[ca]]), weight[a]
            nodes[ca] = node
        elif ca != cb:
            node = ("join", e)
            kids[node] = (1 / w, [nodes[ca], nodes[cb]])
            size[node] = size[nodes[ca]] + size[nodes[cb]]
            of = [ca if c == cb else c for c in of]
            nodes[ca] = node
    points = lambda node: [node[1]] if node[0] == "point" else [p for k in kids[node][1] for p in points(k)]
    clusters = {}  # name -> [birth, sum of densities, points, children]

    def descend(node, name):
        """Follow cluster `name` down from this node until it splits or dissolves."""
        while True:
            if node[0] == "point":
                return
            density, below = kids[node]
            big = [k for k in below if size[k] >= min_size]
            c = clusters[name]
            if node[0] == "copies" or not big:
                c[1] += density * size[node]
                return
            if len(big) == 2:
                c[1] += density * size[node]
                for k in big:
                    clusters[k] = [density, 0.0, points(k), []]
                    c[3].append(k)
                    descend(k, k)
                return
            c[1] += density * sum(size[k] for k in below if k is not big[0])
            node = big[0]

    tops = [nodes[c] for c in set(of) if size[nodes[c]] >= min_size]
    for t in tops:
        clusters[t] = [0.0 if radius is None else 1 / radius, 0.0, points(t), []]
        descend(t, t)
    weight_of = lambda pts: sum(weight[p] for p in pts)
    chosen = {}

    def best(name):
        birth, gone, pts, children = clusters[name]
        own, inside = round(gone - birth * weight_of(pts), 9), sum(best(k) for k in children)
        chosen[name] = own >= inside
        return max(own, inside)

    label = [-1] * n

    def mark(name):
        if chosen[name]:
            for p in clusters[name][2]:
                label[p] = min(clusters[name][2])
        else:
            for k in clusters[name][3]:
                mark(k)

    for t in tops:
        if radius is None:  # the root is no cluster
            for k in clusters[t][3]:
                best(k), mark(k)
        else:
            best(t), mark(t)
    return label


def labels_of(spark, z, weight, min_size, min_samples, radius=None, **sizes):
    df = spark.createDataFrame([(i, [float(x) for x in r], int(w)) for i, (r, w) in enumerate(zip(z, weight))], "id bigint, z array<double>, weight bigint")
    points = hierarchy.core_distances(df.repartition(3), min_samples).cache()
    tree = hierarchy.minimum_spanning_tree(points, radius, **sizes)
    found = hierarchy.condensed_clusters(points, tree, min_size, radius, **{k: v for k, v in sizes.items() if k == "edges"})
    got = {r["id"]: r["cluster"] for r in found.collect()}
    return [got.get(i, -1) for i in range(len(z))]


@pytest.fixture(scope="module")
def densities():
    """Groups whose densities differ by a factor of 20, one of them with two dense cores, and noise."""
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0, 0], [1.2, 0, 0], [30, 0, 0], [0, 40, 0], [5.0, 5, 60]])
    z = np.vstack([blobs(rng, centres, [30, 25, 40, 35, 12], [0.1, 0.12, 2.0, 2.5, 0.3]), rng.uniform(-20, 60, (25, 3))])
    return z, np.ones(len(z), int)


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 16}, {"block_rows": 32, "edges": 40}])
def test_hierarchy_equals_the_written_out_one(spark, densities, sizes):
    z, weight = densities
    assert labels_of(spark, z, weight, 5, 3, **sizes) == brute_hierarchy(z, weight, 5, 3)


def test_groups_of_several_densities_where_one_cut_fails(spark, densities):
    z, weight = densities
    truth = np.repeat(np.arange(5), [30, 25, 40, 35, 12])
    labels = labels_of(spark, z, weight, 5, 3)
    for g in range(5):  # most of a group carries one label, and no two groups share it
        own = [labels[i] for i in np.flatnonzero(truth == g)]
        top = max(set(own), key=own.count)
        assert top != -1 and own.count(top) > 0.7 * len(own)
        assert all(labels[i] != top for i in range(len(truth)) if truth[i] != g)
    df = frame(spark, z)
    for eps in (0.05, 0.1, 0.3, 1.0):
        cut = {r["id"]: r["cluster"] for r in CL.dense_components(df, eps).collect()}
        good = 0
        for g in range(5):
            own = [cut[i] for i in np.flatnonzero(truth == g)]
            top = max(set(own), key=own.count)
            good += top != -1 and own.count(top) > 0.7 * len(own) and all(cut[i] != top for i in range(len(truth)) if truth[i] != g)
        assert good < 5


@pytest.mark.parametrize("seed,min_size,min_samples,radius", [(1, 4, 2, None), (2, 2, 1, None), (3, 6, 4, 1.5), (4, 3, 1, 0.8)])
def test_hierarchy_random_with_copies(spark, seed, min_size, min_samples, radius):
    rng = np.random.default_rng(seed)
    z = np.vstack([blobs(rng, rng.normal(0, 3, (6, 2)), [12] * 6, rng.uniform(0.05, 0.8, 6)), rng.uniform(-6, 6, (15, 2))])
    weight = np.where(rng.random(len(z)) < 0.15, rng.integers(2, 9, len(z)), 1)
    got = labels_of(spark, z, weight, min_size, min_samples, radius, block_rows=16)
    assert got == brute_hierarchy(z, weight.tolist(), min_size, min_samples, radius)


def test_density_clusters_of_awkward_tables(spark):
    assert CL.density_clusters(spark.createDataFrame([], "id bigint, v array<double>")).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id bigint, v array<double>")
    assert {tuple(r) for r in CL.density_clusters(one).collect()} == {(1, -1, None), (2, -1, None)}
    rng = np.random.default_rng(0)
    rows = np.vstack([np.tile([0.0, 0.0], (40, 1)), rng.normal(5, 0.2, (20, 2)), rng.normal(-5, 0.3, (20, 2))])
    got = [r["cluster"] for r in CL.density_clusters(frame(spark, rows)).orderBy("id").collect()]
    assert set(got[:40]) == {0} and len(set(got[40:60]) - {-1}) == 1 and len(set(got[60:]) - {-1}) == 1


# --- pivots -----------------------------------------------------------------------------------------------

def test_neighbours_equal_brute_force_in_every_cut_of_the_table(spark):
    rng = np.random.default_rng(6)
    m = blobs(rng, rng.standard_normal((7, 10)), [30] * 7, [0.2] * 7)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 12)
    want = {(i, j) for i in range(210) for _, j in sorted((-s[i, j], j) for j in range(210) if j != i and s[i, j] >= 0.7)[:5]}
    for block in (16, 64, 4096):
        got = NN.similar_neighbours(frame(spark, m), 0.7, 5, block_rows=block).collect()
        assert {(r["id"], r["other"]) for r in got} == want and len(got) == len(want)


def test_pivots_rule_out_most_pairs_of_separate_groups(spark):
    rng = np.random.default_rng(7)
    m = blobs(rng, 3 * rng.standard_normal((12, 16)), [40] * 12, [0.2] * 12)
    df = frame(spark, m).cache()
    high, low = (NN.compared_share(df, t, block_rows=64) for t in (0.95, -1.0))
    assert high < 0.35 and abs(low - 1) < 1e-9
    want = {(r["a"], r["b"]) for r in NN.similar_pairs(df, 0.95, block_rows=4096).select("a", "b").collect()}
    assert {(r["a"], r["b"]) for r in NN.similar_pairs(df, 0.95, block_rows=32).select("a", "b").collect()} == want


def test_large_components_move_sums_not_edges(spark):
    """One component over several blocks gives the exemplars of the solver inside a task, and a round writes no edges."""
    rng = np.random.default_rng(5)
    m = rng.standard_normal((500, 6))
    ids = spark.createDataFrame([(i, i * 7 - 900) for i in range(500)], "id bigint, new bigint")
    df = frame(spark, m).join(ids, "id").select(F.col("new").alias("id"), "v")
    reps = NN.collapse_copies(df)[0].cache()
    edges = affinity.similarities(reps, 0.5, 24).cache()
    parts = CL.connected_components(edges.filter("i <> k").select(F.col("i").alias("a"), F.col("k").alias("b"))).cache()
    want = sorted(map(tuple, affinity.affinity_exemplars(edges, parts).select("i", "k").collect()))
    got = sorted(map(tuple, affinity.affinity_exemplars(edges, parts, local_edges=10, block_edges=700).select("i", "k").collect()))
    assert got == want and 1 < len({k for _, k in want}) < 250
    block = affinity.Block(*(np.array(c) for c in zip(*[(1, 1, -1.0, 1), (1, 2, -0.1, 1), (1, 3, -0.2, 1)])), 1, 0.5).respond()
    assert [len(total) for _, (_, total) in block.sums(0)] == [3]  # a number per item, whatever the edges


def test_pivots_that_rule_out_little_are_not_used(spark):
    """Random directions: a row is copied to the few blocks of one cell, not to every cell."""
    m = np.random.default_rng(6).standard_normal((3000, 24))
    df = frame(spark, m).withColumn("weight", F.lit(1))
    tiles = NN._metric_tiles(df, NN._radius(0.3, "cosine"), "cosine", "v", 256, "weight", "bigint", 1024)
    assert tiles.count() <= 3000 * NN.FEW_BLOCKS and tiles.filter("cell > 0").isEmpty()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.6, 1))
    assert {(r["a"], r["b"]) for r in NN.similar_pairs(df, 0.6, block_rows=64).collect()} == set(zip(a.tolist(), b.tolist()))
