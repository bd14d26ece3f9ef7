"""Density clusters from a whole hierarchy (Campello, Moulavi and Sander 2013).

Boruvka rounds find the minimum spanning tree under mutual reachability. A point's nearest neighbours are listed
once, which also gives its core distance; a component whose least listed edge is shorter than what its points' lists leave out needs no
other pair. For the others tasks stream blocks of all points, and only pairs of different components that are nearer than the
component's least edge so far are measured. No pair and no copy of a point is ever written.
The tree's edges are then merged by weight in bands: a task takes one band of bounded size with the
components it touches, so the hierarchy never stands in one place. Clusters are those of greatest
stability, leaves and inner ones alike, so groups of several densities are found at once.

All orders are total (weight rounded to nine places, then both ids), so there is one tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from threadloom.operators import blocks as B
from threadloom.operators.nearest import _union
from threadloom.operators.ranking import with_row_index
from threadloom.runtime import stored

LISTED = 8               # nearest neighbours listed of a point, at least
EDGES = 2_000_000        # edges that one task may hold
NEAREST = 1e-9           # the smallest weight; copies are this far apart
PLACES = 9
PAD = 1e-8               # more than weights lose by their rounding


def listed_neighbours(reps: DataFrame, least: int, vector: str = "z") -> DataFrame:
    """(id, other, score, raw): each point's nearest others, at least `least` and LISTED of them where there are so many."""
    kept = B.write_blocks(reps, float("inf"), "euclid", vector, "weight", "bigint")
    return stored(B.neighbours(kept, max(least, LISTED), float("inf")), "listed")


def core_distances(reps: DataFrame, min_samples: int, vector: str = "z", near: DataFrame | None = None) -> DataFrame:
    """(id, z, weight, core): the distance to the `min_samples`-th other item, copies counted; with fewer others
    than that, to the farthest of the nearest ones. `near` is the result of `listed_neighbours`, if known."""
    near = listed_neighbours(reps, min_samples, vector) if near is None else near
    near = near.select(F.col("id").alias("qid"), F.col("other").alias("id"), "score")
    near = near.join(reps.select("id", F.col("weight").alias("w")), "id")
    upto = Window.partitionBy("qid").orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0)  # a few rows
    steps = near.withColumn("n", F.sum("w").over(upto)).join(reps.select(F.col("id").alias("qid"), (F.col("weight") - 1).alias("own")), "qid")
    reached = F.col("n") + F.col("own") >= min_samples
    core = steps.groupBy("qid").agg(F.coalesce(F.min(F.when(reached, -F.col("score"))), F.max(-F.col("score"))).alias("core"))
    joined = reps.join(core.withColumnRenamed("qid", "id"), "id", "left")
    return joined.select("id", F.col(vector).alias("z"), "weight",
                         F.when(F.col("weight") > min_samples, 0.0).otherwise(F.coalesce("core", F.lit(0.0))).alias("core"))


def _weights(d: np.ndarray, core: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Mutual reachability; every way to a pair's weight is this one, so that it is the same wherever the pair is met."""
    return np.maximum(np.round(np.maximum(np.maximum(d, core), other), PLACES), NEAREST)


def minimum_spanning_tree(points: DataFrame, radius: float | None = None, block_rows: int = B.ROWS, edges: int = EDGES,
                          near: DataFrame | None = None) -> DataFrame:
    """(a, b, w): the minimum spanning tree of (id, z, core) under mutual reachability, a < b.

    Without a `radius` every pair counts; with one, edges beyond it are left out (a forest), and the pivots
    rule out most blocks. `near` is the result of `listed_neighbours`, if known.
    """
    points = points.select("id", "z", "core")
    kept = B.write_blocks(points, float("inf") if radius is None else radius, "euclid", "z", "core", "double", block_rows)
    near = listed_neighbours(points, LISTED) if near is None else near
    left, bounds = _listed_edges(points, near, radius)
    labels = points.select("id", F.col("id").alias("comp"))
    tree, left, bounds, labels = _contracted(left, bounds, labels, edges)
    while True:
        ends = left.select(F.col("x").alias("comp"), "w").unionByName(left.select(F.col("y").alias("comp"), "w"))
        floors = ends.groupBy("comp").agg(F.min("w").alias("floor"))
        limit = F.lit(float("inf") if radius is None else float(radius))
        held = stored(labels.join(floors, "comp", "left").select("id", F.col("comp").alias("label"), F.coalesce("floor", limit).alias("floor")), "labels")
        if held.select("label").distinct().count() < 2:
            break
        found = _leaving(kept, B.write_labels(kept, held, {"label": "int64", "floor": "float64"}), radius)
        order = F.struct("w", "a", "b", "x", "y")
        picked = stored(found.groupBy("c").agg(F.min(order).alias("e")).select("e.*").distinct(), "picked")
        if picked.isEmpty():
            break
        tree = tree.unionByName(picked.select("a", "b", "w"))
        left, bounds, labels = _merged(picked, left, bounds, labels, edges)
    return stored(tree, "tree")


def _listed_edges(points: DataFrame, near: DataFrame, radius: float | None) -> tuple[DataFrame, DataFrame]:
    """Listed edges (a, b, w, x, y) between components x and y, points at first, and for each component (c, bound) what the
    edges of its points that are not listed weigh at least."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, j, d, core, other = (np.asarray(c) for c in b.columns)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.minimum(i, j), np.maximum(i, j), _weights(d, core, other), i, np.round(d, PLACES))],
                                             ["a", "b", "w", "id", "d"])

    both = near.join(points.select("id", "core"), "id").join(points.select(F.col("id").alias("other"), F.col("core").alias("_core")), "other")
    weighed = stored(both.select("id", "other", "raw", "core", "_core").mapInArrow(weigh, "a bigint, b bigint, w double, id bigint, d double"), "weighed")
    left = weighed.select("a", "b", "w", F.col("a").alias("x"), F.col("b").alias("y")).distinct()
    left = stored(left if radius is None else left.filter(F.col("w") <= radius), "left")
    ends = weighed.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d"))
    most = F.lit(ends.agg(F.max("n")).first()[0] or 0)  # a shorter list holds all others
    whole = F.lit(float("inf"))
    bounds = points.select("id").join(ends, "id", "left").select(F.col("id").alias("c"), F.when(F.col("n") == most, F.col("d")).otherwise(whole).alias("bound"))
    return left, stored(bounds, "bounds")


def _union_of(table: pa.Table) -> pa.Table:
    names, at = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
    n = table.num_rows
    return pa.table({"id": names, "component": names[_union(np.arange(len(names)), at[:n], at[n:])]})


def _components(links: DataFrame, edges: int) -> DataFrame:
    """(id, component) of links (a, b): in one task when there are few, by rounds otherwise."""
    from threadloom.operators.cluster import connected_components

    if links.count() > edges:
        return connected_components(links)
    return links.groupBy(F.lit(0).alias("g")).applyInArrow(_union_of, "id bigint, component bigint")


def _merged(picked: DataFrame, left: DataFrame, bounds: DataFrame, labels: DataFrame, edges: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Listed edges, bounds and labels after the components of the picked edges are one."""
    to = stored(_components(picked.select(F.col("x").alias("a"), F.col("y").alias("b")), edges), "merged")
    return _moved(to, left, bounds, labels)


def _moved(to: DataFrame, left: DataFrame, bounds: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    def renamed(df: DataFrame, name: str) -> DataFrame:
        moved = df.join(to.select(F.col("id").alias(name), F.col("component").alias("_to")), name, "left")
        return moved.withColumn(name, F.coalesce("_to", name)).drop("_to")

    left = renamed(renamed(left, "x"), "y").filter("x <> y").select("a", "b", "w", "x", "y")
    bounds = renamed(bounds, "c").groupBy("c").agg(F.min("bound").alias("bound"))
    return stored(left, "left"), stored(bounds, "bounds"), stored(renamed(labels, "comp").select("id", "comp"), "labels")


def _certain(left: pa.Table, bounds: pa.Table) -> pa.Table:
    """All rounds of certain picks over edges that one task holds: picked edges (kind 0: a, b, w) and merged components (kind 1: a into b)."""
    a, b, w, x, y = (left.column(c).to_numpy() for c in ("a", "b", "w", "x", "y"))
    names, at = np.unique(np.concatenate([bounds.column("c").to_numpy(), x, y]), return_inverse=True)
    n, m = bounds.num_rows, len(x)
    own = np.full(len(names), np.inf)
    own[at[:n]] = bounds.column("bound").to_numpy()
    order = np.lexsort((b, a, w))
    x, y, w_ = at[n:n + m][order], at[n + m:][order], w[order]
    label, rank, chosen = np.arange(len(names)), np.arange(m), []
    while len(rank):
        u, v = label[x[rank]], label[y[rank]]
        open_ = u != v
        rank, u, v = rank[open_], u[open_], v[open_]
        first, bound = np.full(len(names), m), np.full(len(names), np.inf)
        np.minimum.at(first, u, rank)
        np.minimum.at(first, v, rank)
        np.minimum.at(bound, label, own)
        some = np.flatnonzero(first < m)
        pick = np.unique(first[some[w_[first[some]] < bound[some]]])
        if not len(pick):
            break
        chosen.append(pick)
        label = _union(label, x[pick], y[pick])
    pick = order[np.unique(np.concatenate(chosen))] if chosen else np.empty(0, "int64")
    hung = np.flatnonzero(label != np.arange(len(names)))
    return pa.table({"kind": np.repeat([0, 1], [len(pick), len(hung)]), "a": np.concatenate([a[pick], names[hung]]),
                     "b": np.concatenate([b[pick], names[label[hung]]]), "w": np.concatenate([w[pick], np.zeros(len(hung))])})


def _contracted(left: DataFrame, bounds: DataFrame, labels: DataFrame, edges: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The tree's edges that the lists alone prove, and listed edges, bounds and labels of the components they leave.

    A component's least listed edge is its least edge of all if it is lighter than its bound. Rounds over the tables go on while more
    than `edges` edges are left; one task does the rest.
    """
    tree = left.select("a", "b", "w").limit(0)
    n = left.count()
    while n > edges:
        order = F.struct("w", "a", "b", "x", "y")
        ends = left.select(F.col("x").alias("c"), order.alias("e")).unionByName(left.select(F.col("y").alias("c"), order.alias("e")))
        least = ends.groupBy("c").agg(F.min("e").alias("e")).join(bounds, "c").filter(F.col("e.w") < F.col("bound"))
        picked = stored(least.select("e.*").distinct(), "picked")
        if picked.isEmpty():
            return tree, left, bounds, labels
        tree = tree.unionByName(picked.select("a", "b", "w"))
        left, bounds, labels = _merged(picked, left, bounds, labels, edges)
        n = left.count()
    if bounds.count() > edges:
        return tree, left, bounds, labels
    one = F.lit(0).alias("g")
    done = stored(left.groupBy(one).cogroup(bounds.groupBy(one)).applyInArrow(_certain, "kind bigint, a bigint, b bigint, w double"), "certain")
    tree = tree.unionByName(done.filter("kind = 0").select("a", "b", "w"))
    left, bounds, labels = _moved(done.filter("kind = 1").select(F.col("a").alias("id"), F.col("b").alias("component")), left, bounds, labels)
    return tree, left, bounds, labels


def _leaving(kept: B.Blocks, folder: str, radius: float | None) -> DataFrame:
    """(c, w, a, b, x, y): per task the least edge (w, a, b) from each component c it met to another; x and y are the components of a and b.

    `folder` has the components of all points and, for each, the weight of an edge that leaves it (a limit for what is measured).
    """
    limit = np.inf if radius is None else radius

    def solve(i: int) -> Iterator[pa.RecordBatch]:
        a, one = kept.load(i), B.read_labels(folder, i)
        mine, floor = one["label"], one["floor"]
        out: list[tuple[np.ndarray, ...]] = []
        for j in kept.met(i, range(0, kept.half() + 1)):
            two = one if j == i else B.read_labels(folder, j)
            theirs = two["label"]
            if len(mine) and (mine == mine[0]).all() and (theirs == mine[0]).all():
                continue
            b = a if j == i else kept.load(j)
            kind, err = B._kind(a, b)
            names, at = np.unique(np.concatenate([mine, theirs]), return_inverse=True)
            p, q = at[: len(mine)], at[len(mine):]
            least = np.full(len(names), limit)
            np.minimum.at(least, p, floor)
            np.minimum.at(least, q, two["floor"])
            left, right = a.left(kind), b.right(kind)
            rows, columns = np.flatnonzero(a.near_to(kept.cell[j])), np.flatnonzero(b.near_to(kept.cell[i]))
            start, size = 0, B.FEW_ROWS
            while start < len(columns):  # pieces grow, as the first ones lower the limits
                piece = columns[start:start + size]
                for r, c in B.apart(mine[rows], theirs[piece]) if len(rows) else []:
                    r, c = rows[r], piece[c]

                    def low(part: slice) -> np.ndarray:
                        return np.minimum(B.lowest(-least[p[r[part]]], "euclid")[:, None], B.lowest(-least[q[c]], "euclid")[None, :]) - err

                    for x, y, product in B._hits(left[r], right[:, c], low):
                        x, y = r[x], c[y]
                        keep = (p[x] != q[y])
                        x, y, product = x[keep], y[keep], product[keep]
                        if len(x) > B.PAIRS:  # the nearest pair of each component gives a limit for the others
                            for ends in (p[x], q[y]):
                                order = np.lexsort((-product, ends))
                                top = order[np.flatnonzero(np.r_[True, np.diff(ends[order]) != 0])]
                                w = _weights(B.measured(a, x[top], b, y[top]), a.w[x[top]], b.w[y[top]])
                                np.minimum.at(least, ends[top], w)
                            far = np.maximum(least[p[x]], least[q[y]])
                            keep = (product >= B.lowest(-far, "euclid") - err) & (a.w[x] <= far + PAD) & (b.w[y] <= far + PAD)
                            x, y = x[keep], y[keep]
                        w = _weights(B.measured(a, x, b, y), a.w[x], b.w[y])
                        keep = (w <= np.maximum(least[p[x]], least[q[y]]))
                        x, y, w = x[keep], y[keep], w[keep]
                        if len(x):
                            i_, j_ = a.ids[x], b.ids[y]
                            swap = i_ > j_
                            edge = (w, np.where(swap, j_, i_), np.where(swap, i_, j_), np.where(swap, theirs[y], mine[x]), np.where(swap, mine[x], theirs[y]))
                            ends = np.concatenate([p[x], q[y]])
                            some = _least(ends, *(np.tile(v, 2) for v in edge))
                            some = tuple(v[some[1] <= least[some[0]]] for v in some)
                            np.minimum.at(least, some[0], some[1])
                            out.append((names[some[0]], *some[1:]))
                start, size = start + size, min(B.ROWS, 4 * size)
            floor = least[p]
            if sum(len(o[0]) for o in out) > B.CELLS // 4:
                out = [_least(*(np.concatenate(v) for v in zip(*out)))]
        if out:
            some = _least(*(np.concatenate(v) for v in zip(*out)))
            yield from B._batches(dict(zip(("c", "w", "a", "b", "x", "y"), some)))

    return kept.run(solve, "c bigint, w double, a bigint, b bigint, x bigint, y bigint")


def _least(c: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """The least edge (w, a, b) of each c."""
    order = np.lexsort((b, a, w, c))
    first = order[np.flatnonzero(np.r_[True, np.diff(c[order]) != 0])] if len(c) else order
    return tuple(v[first] for v in (c, w, a, b, x, y))


class Merger:
    """Merges components in the order of the edges and keeps, for each, what the condensed tree needs.

    A component below `least` points has only a size. One that reaches it is a cluster, named by the rank of
    that edge: `gone` sums 1/w over its points, w being the weight at which a point leaves it when one looks
    down from the root; `inner` is the best stability of the clusters inside it. A small component's
    points belong to the first cluster that takes it up, their home.
    """

    def __init__(self, least: int, states: dict[int, tuple[int, int | None, float, float]]):
        self.least = least
        self.size = {c: s[0] for c, s in states.items()}
        self.cluster = {c: s[1] for c, s in states.items() if s[1] is not None}
        self.gone = {c: s[2] for c, s in states.items() if s[1] is not None}
        self.inner = {c: s[3] for c, s in states.items() if s[1] is not None}
        self.up: dict[int, int] = {}
        self.homeless = {c: [c] for c in states if c not in self.cluster}
        self.home: dict[int, int] = {}
        self.ended: list[tuple[int, int | None, bool]] = []  # (cluster, parent, at least as stable as its inside)

    def find(self, x: int) -> int:
        root = x
        while root in self.up:
            root = self.up[root]
        while x != root:
            self.up[x], x = root, self.up[x]
        return root

    def _settle(self, c: int, cluster: int) -> None:
        for x in self.homeless.pop(c, ()):
            self.home[x] = cluster

    def end(self, c: int, density: float, parent: int | None) -> float:
        """The cluster of component c stops being one of its own at this density."""
        stability = round(self.gone.pop(c) - self.size[c] * density, PLACES)
        inner = self.inner.pop(c)
        self.ended.append((self.cluster.pop(c), parent, stability >= inner))
        return max(stability, inner)

    def _born(self, c: int, name: int, gone: float, inner: float) -> None:
        self.cluster[c], self.gone[c], self.inner[c] = name, gone, inner

    def copies(self, name: int, c: int, n: int, w: float) -> None:
        """A point that stands for n copies, which are that close to each other."""
        c = self.find(c)
        self.size[c] = n
        if n >= self.least:
            self._born(c, name, n / w, 0.0)
            self._settle(c, name)

    def merge(self, name: int, a: int, b: int, w: float) -> None:
        a, b = sorted((self.find(a), self.find(b)))
        density, size = 1 / w, self.size[a] + self.size[b]
        large = [c for c in (a, b) if c in self.cluster]
        if len(large) == 2:
            inner = self.end(a, density, name) + self.end(b, density, name)
            self._born(a, name, size * density, inner)
        elif large:
            c, small = large[0], b if large[0] == a else a
            self._settle(small, self.cluster[c])
            gone = self.gone.pop(c) + self.size[small] * density
            self._born(a, self.cluster.pop(c), gone, self.inner.pop(c))
        elif size >= self.least:
            self._born(a, name, size * density, 0.0)
            self._settle(a, name), self._settle(b, name)
        else:
            self.homeless[a] += self.homeless.pop(b)
        self.size[a] = size
        del self.size[b]
        self.up[b] = a


BAND = "kind string, x bigint, y bigint, size bigint, gone double, inner double, good boolean"


def _band(least: int, radius: float | None, last: bool):
    """Solves one band: component states and edges in, changes out, as rows of `BAND`."""
    def solve(states: pa.Table, edges: pa.Table) -> pa.Table:
        rows = {r["comp"]: (r["size"], r["cluster"], r["gone"], r["inner"]) for r in states.to_pylist()}
        m = Merger(least, rows)
        for r in edges.sort_by("rn").to_pylist():
            if r["copies"] is not None:
                m.copies(r["rn"], r["a"], r["copies"], r["w"])
            else:
                m.merge(r["rn"], r["a"], r["b"], r["w"])
        if last and radius is not None:  # trees are apart by more than the radius
            for c in list(m.cluster):
                m.end(c, 1 / radius, None)
        out = [("comp", c, m.find(c), None, None, None, None) for c in rows]
        out += [("state", c, m.cluster.get(c), n, m.gone.get(c), m.inner.get(c), None) for c, n in m.size.items()]
        out += [("home", c, h, None, None, None, None) for c, h in m.home.items()]
        out += [("ended", c, p, None, None, None, good) for c, p, good in m.ended]
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
        return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(zip(("kind", "x", "y", "size", "gone", "inner", "good"), types))})

    return solve


def condensed_clusters(points: DataFrame, tree: DataFrame, min_size: int, radius: float | None = None, edges: int = EDGES) -> DataFrame:
    """(id, cluster) of the points (id, weight, core) that belong to a cluster of greatest stability; a cluster
    is named by its smallest id.

    The root is no cluster of its own; with a `radius` the trees of the forest hang on a common root at that
    distance. Edges are merged by rank, a band of at most `edges` at a time.
    """
    copies = points.filter("weight > 1").select(F.greatest(F.round("core", PLACES), F.lit(NEAREST)).alias("w"), F.lit(0).alias("kind"),
                                                F.col("id").alias("a"), F.col("id").alias("b"), F.col("weight").alias("copies"))
    joins = tree.select("w", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("bigint").alias("copies"))
    ranked = stored(with_row_index(copies.unionByName(joins), [F.col(c) for c in ("w", "kind", "a", "b")], "rn", start=0), "ranked")
    bands = max(1, -(-ranked.count() // edges))
    places = points.select("id", F.col("id").alias("comp"), F.lit(None).cast("bigint").alias("home"))
    states = points.select(F.col("id").alias("comp"), F.lit(1).cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("cluster"),
                           F.lit(None).cast("double").alias("gone"), F.lit(None).cast("double").alias("inner"))
    ended = None
    for k in range(bands):
        places, states = stored(places, "places"), stored(states, "states")
        band = ranked.filter((F.col("rn") >= k * edges) & (F.col("rn") < (k + 1) * edges))
        for end in ("a", "b"):
            band = band.join(places.select(F.col("id").alias(end), F.col("comp").alias("_c")), end).withColumn(end, F.col("_c")).drop("_c")
        last = k == bands - 1
        touched = states
        if not (last and radius is not None):  # the end of a forest concerns every component
            met = band.select(F.col("a").alias("comp")).unionByName(band.select(F.col("b").alias("comp"))).distinct()
            touched = states.join(met, "comp", "left_semi")
        one = F.lit(0).alias("g")
        done = stored(touched.groupBy(one).cogroup(band.select("rn", "w", "a", "b", "copies").groupBy(one)).applyInArrow(
            _band(min_size, radius, last), BAND), "band")
        comp = done.filter("kind = 'comp'").select(F.col("x").alias("comp"), F.col("y").alias("_to"))
        home = done.filter("kind = 'home'").select(F.col("x").alias("comp"), F.col("y").alias("_home"))
        places = places.join(home, "comp", "left").join(comp, "comp", "left").select(
            "id", F.coalesce("_to", "comp").alias("comp"), F.coalesce("home", "_home").alias("home"))
        new = done.filter("kind = 'state'").select(F.col("x").alias("comp"), "size", F.col("y").alias("cluster"), "gone", "inner")
        states = states.join(comp, "comp", "left_anti").unionByName(new)
        part = done.filter("kind = 'ended'").select(F.col("x").alias("cluster"), F.col("y").alias("parent"), "good")
        ended = part if ended is None else ended.unionByName(part)
    top = F.when(F.col("good"), F.col("cluster"))
    chain = stored(ended.select("cluster", top.alias("top"), F.col("parent").alias("up")), "chain")
    while not chain.filter("up IS NOT NULL").isEmpty():  # pointer doubling: the topmost good cluster wins
        above = chain.select(F.col("cluster").alias("up"), F.col("top").alias("_top"), F.col("up").alias("_up"))
        chain = stored(chain.join(above, "up", "left").select("cluster", F.coalesce("_top", "top").alias("top"), F.col("_up").alias("up")), "chain")
    chain = chain.filter("top IS NOT NULL").select(F.col("cluster").alias("home"), "top")
    members = stored(places.join(chain, "home").select("id", "top"), "members")
    names = stored(members.groupBy("top").agg(F.min("id").alias("cluster")), "names")
    return members.join(names, "top").select("id", "cluster")
