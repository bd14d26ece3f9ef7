"""Grouping of similar items. Edges come from an exact similarity join, groups from components.

`exemplar_clusters` takes its exemplars from sparse affinity propagation, `density_clusters` its
groups from a density hierarchy; `component_clusters` and `dense_components` are the cheaper cuts of
the same graphs: connected components with the same rules about distances and sizes. Equal vectors are
handled once, and only as many edges are written as each method needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threadloom.functions import vectors as V
from threadloom.operators import affinity, hierarchy
from threadloom.operators.nearest import collapse_copies, label_centroids, nearest, neighbour_counts, similar_forest, standardise
from threadloom.runtime import durable, stored

MISC = -1  # cluster of items that belong nowhere


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in `edges` (a, b); the component is its smallest id.

    Alternating large-star and small-star steps (Kiveris et al. 2014) end after a number of
    rounds that grows with the logarithm of the longest path. A hub is a hot key of the joins; the
    one row per key on their other side is stored first, so that the adaptive skew join can split
    the hub. Each round is checkpointed; the driver only learns whether another is needed.
    """
    e = durable(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )

    def stars_only(df: DataFrame) -> bool:
        """Every id is either a centre or hangs on exactly one centre."""
        ends = df.select(F.col("u").alias("id"), F.lit(1).alias("hangs"), F.lit(0).alias("centre")).unionByName(
            df.select(F.col("v").alias("id"), F.lit(0).alias("hangs"), F.lit(1).alias("centre")))
        roles = ends.groupBy("id").agg(F.sum("hangs").alias("h"), F.max("centre").alias("c"))
        return roles.filter("h > 1 OR (h = 1 AND c = 1)").isEmpty()

    while not stars_only(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low2 = stored(large.groupBy("u").agg(F.min("v").alias("m")), "low2")
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = durable(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct())
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _groups_of(links: DataFrame, components: DataFrame) -> DataFrame:
    """(id, component) for all items from the components of their representatives; a
    representative without neighbours is a group when it stands for several copies."""
    return links.join(components.withColumnRenamed("id", "rep"), "rep", "left").filter(
        "component IS NOT NULL OR weight > 1").select("id", F.coalesce("component", "rep").alias("component"))


def exemplars(members: DataFrame, group: str, vector: str = "v", euclid: bool = False) -> DataFrame:
    """(group, exemplar, exemplar vector): the member nearest to all others, lowest id on a tie.

    With unit vectors the mean similarity to all members is the product with their mean, so no
    pair of members is formed. `euclid` takes the member nearest to the mean instead.
    """
    mean = F.col("centroid")
    far = V.euclidean(F.col(vector), mean) if euclid else -V.dot(F.col(vector), mean)
    ranked = members.join(stored(label_centroids(members, group, vector), "centroids"), group).select(group, F.round(far, 9).alias("_far"), "id", vector)
    best = ranked.groupBy(group).agg(F.min(F.struct("_far", "id", vector)).alias("_b"))
    return best.select(group, F.col("_b.id").alias("exemplar"), F.col(f"_b.{vector}").alias("_ev"))


def assign_exemplar_distance(members: DataFrame, group: str, vector: str = "v", euclid: bool = False) -> DataFrame:
    """Members with their exemplar and the distance to it (1 - similarity, or Euclid)."""
    joined = members.join(stored(exemplars(members, group, vector, euclid), "exemplars"), group)
    d = V.euclidean(F.col(vector), F.col("_ev")) if euclid else 1 - V.cosine(F.col(vector), F.col("_ev"))
    return joined.withColumn("distance", F.when(F.col("id") == F.col("exemplar"), F.lit(0.0)).otherwise(d)).drop("_ev")


def _leave_misc(items: DataFrame, placed: DataFrame, cut: float) -> DataFrame:
    """(id, cluster, distance) of all items: those of `placed` (id, exemplar, distance) within `cut`, if their
    exemplar keeps more than one; all others are misc."""
    near = placed.filter(F.col("distance") <= cut + 1e-9)
    full = near.groupBy("exemplar").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("exemplar")
    kept = near.join(stored(full, "full"), "exemplar").select("id", F.col("exemplar").alias("cluster"), "distance")
    return items.select("id").join(kept, "id", "left").select(
        "id", F.coalesce("cluster", F.lit(MISC)).alias("cluster"), "distance")


def exemplar_clusters(items: DataFrame, threshold: float = 0.85, max_distance: float | None = None, vector: str = "v",
                      neighbours: int = 64, preference: float | None = None, damping: float = 0.5, **solver) -> DataFrame:
    """(id, cluster, distance): every item at its exemplar by affinity propagation, distance 1 - cosine.

    Messages go along edges to an item's `neighbours` nearest others with cosine >= `threshold`, copies counting
    as one item of their weight; then every item takes the most similar exemplar that reaches the threshold. Items further than `max_distance` (default 1 - threshold) from their
    exemplar go to misc, as do clusters that are left with one member, items without a vector and those
    whose vector has no length.
    """
    cut = (1 - threshold) if max_distance is None else max_distance
    reps, links = collapse_copies(items.select("id", F.col(vector).alias("v")).filter(V.norm(F.col("v")) > 0))
    reps = stored(reps, "reps")
    edges = stored(affinity.similarities(reps, threshold, neighbours, preference), "similarities")
    components = connected_components(edges.filter("i <> k").select(F.col("i").alias("a"), F.col("k").alias("b")))
    found = stored(affinity.affinity_exemplars(edges, components, damping, **solver).withColumnRenamed("i", "rep"), "found")
    orphans = stored(reps.join(edges.select(F.col("i").alias("id")).distinct(), "id", "left_semi").join(
        found.select(F.col("rep").alias("id")), "id", "left_anti").select(F.col("id").alias("qid"), "v"), "orphans")
    if not orphans.isEmpty():  # none of its neighbours is an exemplar: the nearest exemplar of the table
        chosen = reps.join(found.filter("rep = k").select(F.col("rep").alias("id")), "id", "left_semi")
        near = nearest(chosen, orphans, k=1).filter(F.col("score") >= threshold)
        found = found.unionByName(near.select(F.col("qid").alias("rep"), F.col("id").alias("k"), "score"))
    placed = links.join(found, "rep", "left").select("id", F.coalesce("k", "rep").alias("exemplar"),
                                                     F.coalesce(1 - F.col("score"), F.lit(0.0)).alias("distance"))
    return _leave_misc(items, placed, cut)


def component_clusters(items: DataFrame, threshold: float = 0.85, max_distance: float | None = None, vector: str = "v") -> DataFrame:
    """(id, cluster, distance): groups of items at least `threshold` similar in a chain.

    Items further than `max_distance` (default 1 - threshold) from their exemplar go to misc, as
    do clusters that are left with one member.
    """
    cut = (1 - threshold) if max_distance is None else max_distance
    reps, links = collapse_copies(items.select("id", F.col(vector).alias("v")))
    groups = _groups_of(links, connected_components(similar_forest(reps, threshold)))
    unit = items.select("id", V.l2_normalise(F.col(vector)).alias("v")).join(groups, "id")
    return _leave_misc(items, assign_exemplar_distance(unit, "component").select("id", "exemplar", "distance"), cut)


def density_clusters(items: DataFrame, min_size: int = 5, min_samples: int = 3, radius: float | None = None, vector: str = "v",
                     **sizes) -> DataFrame:
    """(id, cluster, distance): the most stable groups of a density hierarchy, after standardising; noise is -1.

    A group has `min_size` items at least and is dense by the distance to the `min_samples`-th other item.
    Groups of different densities are found side by side; the distance is that to the group's exemplar, the
    member nearest to its mean. With a `radius` no group reaches over a wider gap, and rows that are far
    apart never meet. The defaults hold at every size of the table.
    """
    z = durable(standardise(items.select("id", F.col(vector).alias("v")).filter("v IS NOT NULL")).select("id", "z"))
    reps, links = collapse_copies(z, "z")
    reps = stored(reps, "reps")
    near = hierarchy.listed_neighbours(reps, min_samples)
    points = stored(hierarchy.core_distances(reps, min_samples, near=near), "points")
    edges = {k: v for k, v in sizes.items() if k == "edges"}
    tree = hierarchy.minimum_spanning_tree(points, radius, **sizes, near=near)
    found = stored(hierarchy.condensed_clusters(points, tree, min_size, radius, **edges).withColumnRenamed("id", "rep"), "found")
    members = z.join(links.join(found, "rep").select("id", "cluster"), "id")
    placed = assign_exemplar_distance(members, "cluster", "z", euclid=True).select("id", "cluster", "distance")
    return items.select("id").join(placed, "id", "left").select("id", F.coalesce("cluster", F.lit(MISC)).alias("cluster"), "distance")


def dense_components(items: DataFrame, eps: float, min_size: int = 5, min_samples: int = 3, vector: str = "v") -> DataFrame:
    """(id, cluster, distance): one cut of the hierarchy, components of dense items after standardising; noise is -1.

    An item is dense when at least `min_samples` others are within `eps`; dense items within
    `eps` of each other share a cluster (the cut at `eps` of a mutual-reachability hierarchy).
    The defaults hold at every size of the table; a caller may pass others.
    """
    z = durable(standardise(items.select("id", F.col(vector).alias("v"))).select("id", "z"))
    reps, links = collapse_copies(z, "z")
    seen = neighbour_counts(reps, eps, "euclid", "z", enough=min_samples)
    near = F.coalesce("n", F.lit(0)) + F.col("weight") - 1  # other items, copies included
    dense = reps.join(seen, "id", "left").filter(near >= min_samples).select("id", "z", "weight")
    found = _groups_of(links.join(dense.select(F.col("id").alias("rep")), "rep", "left_semi"),
                       connected_components(similar_forest(dense, eps, "euclid", "z")))
    full = found.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_size).select("component")
    members = z.join(found.join(stored(full, "full"), "component", "left_semi"), "id")
    placed = assign_exemplar_distance(members, "component", "z", euclid=True).select("id", F.col("component").alias("cluster"), "distance")
    return items.select("id").join(placed, "id", "left").select("id", F.coalesce("cluster", F.lit(MISC)).alias("cluster"), "distance")


def merge_average_linkage(clusters: DataFrame, max_distance: float, key: str = "cluster", vector: str = "v", euclid: bool = False) -> DataFrame:
    """(key, group): average-linkage groups cut at `max_distance`; a group is named by its smallest key.

    The mean similarity of two groups of unit vectors is the product of their mean vectors, so a group is
    one row: its sum vector and its size. Every round finds each group's nearest other group and merges
    those that name each other; average linkage is reducible, so this gives the groups of merging the
    nearest pair one by one. Ties go to the smaller key. `euclid` takes the mean squared Euclid
    distance of two groups, which follows from sizes, means and mean squared lengths, and its root.
    """
    unit = clusters.select(F.col(key).alias("id"), (F.col(vector) if euclid else V.l2_normalise(F.col(vector))).alias("s"), F.lit(1.0).alias("n"))
    groups = stored(unit.withColumn("q", V.dot(F.col("s"), F.col("s"))), "groups")
    of = stored(unit.select("id", F.col("id").alias("group")), "of")
    while True:
        # one vector per group whose inner product orders the others: its mean, with the mean square beside it
        mean = F.transform("s", lambda x: x / F.col("n"))
        square = F.array(F.col("q") / F.col("n")) if euclid else F.array().cast("array<double>")
        items = groups.select("id", F.concat(mean, square).alias("v"))
        asked = F.concat(F.transform(mean, lambda x: 2 * x), F.array(F.lit(-1.0))) if euclid else mean
        near = nearest(items, groups.select(F.col("id").alias("qid"), asked.alias("v")), k=1, metric="dot", skip_self=True)
        if euclid:  # mean squared distance: mean squares of both minus twice the product of means
            near = near.join(groups.select(F.col("id").alias("qid"), (F.col("q") / F.col("n")).alias("_q")), "qid").withColumn(
                "distance", F.sqrt(F.greatest(F.col("_q") - F.col("score"), F.lit(0.0))))
        else:
            near = near.withColumn("distance", 1 - F.col("score"))
        near = stored(near.filter(F.col("distance") <= max_distance + 1e-9).select("qid", "id"), "near")
        mutual = near.join(near.select(F.col("qid").alias("id"), F.col("id").alias("qid")), ["qid", "id"], "left_semi").filter("qid < id")
        mutual = stored(mutual.select(F.col("qid").alias("into"), F.col("id").alias("gone")), "mutual")
        if mutual.isEmpty():
            return of.select(F.col("id").alias(key), "group")
        named = groups.join(mutual, F.col("id") == F.col("gone"), "left").withColumn("id", F.coalesce("into", "id"))
        two = named.groupBy("id").agg(F.collect_list("s").alias("_s"), F.sum("n").alias("n"), F.sum("q").alias("q"))  # two rows at most
        total = F.when(F.size("_s") == 2, F.zip_with(F.col("_s")[0], F.get("_s", F.lit(1)), lambda a, b: a + b)).otherwise(F.col("_s")[0])
        groups = stored(two.select("id", total.alias("s"), "n", "q"), "groups")
        of = stored(of.join(mutual, F.col("group") == F.col("gone"), "left").select("id", F.coalesce("into", "group").alias("group")), "of")


def merge_near_components(clusters: DataFrame, max_distance: float, key: str = "cluster", vector: str = "v") -> DataFrame:
    """(key, group): representatives within `max_distance` (1 - cosine) in a chain share a group."""
    reps = clusters.select(F.col(key).alias("id"), vector)
    groups = connected_components(similar_forest(reps, 1 - max_distance, vector=vector))
    return clusters.select(key).join(groups.withColumnRenamed("id", key), key, "left").select(
        key, F.coalesce("component", F.col(key)).alias("group"))
