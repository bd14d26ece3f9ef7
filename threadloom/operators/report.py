"""Shares, merges, paged members and report tables of clusters.

Clusters are kept as two tables: `clusters` (one row each, with the representative's
fields) and `members` (one row per item). Members are only nested at the very end and in
pages of bounded size, so a cluster with a third of all items is never one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.constants import SITE_BASE
from threadloom.operators.ranking import top_k, top_k_per_group, with_group_position


def enrich_from_source(items: DataFrame, source: DataFrame, id_col: str) -> DataFrame:
    """Add link, score and day of the source document; items with an unknown id are left out."""
    s = source.select(
        F.col("id").alias("_sid"), F.concat(F.lit(SITE_BASE), "permalink").alias("link"), "score",
        F.date_format(F.timestamp_seconds("created_utc"), "yyyy-MM-dd").alias("day"),
    )
    return items.join(s, F.col(id_col) == F.col("_sid")).drop("_sid")


def cluster_sizes(members: DataFrame, cluster: str = "cluster") -> DataFrame:
    return members.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_items"))


def cluster_share(members: DataFrame, rejected: DataFrame | None = None, cluster: str = "cluster") -> DataFrame:
    """(cluster, n_items, percentage). Rejected clusters count in the total but have no row."""
    sizes = cluster_sizes(members, cluster)
    total = members.agg(F.count(F.lit(1)).alias("n")).scalar()
    kept = sizes if rejected is None else sizes.join(rejected.select(cluster), cluster, "left_anti")
    return kept.select(cluster, "n_items", (100.0 * F.col("n_items") / total).alias("percentage"))


def renormalise_share(clusters: DataFrame, share: str = "percentage", title: str = "cluster", keep: int | None = None) -> DataFrame:
    """Shares scaled to a total of 100 (one cluster alone keeps its own); all, or the best `keep` of them."""
    total = clusters.agg(F.sum(share).alias("s")).scalar()
    n = clusters.agg(F.count(F.lit(1)).alias("n")).scalar()
    scaled = clusters.withColumn(share, F.when(n > 1, 100.0 * F.col(share) / total).otherwise(F.col(share)))
    return scaled if keep is None else top_k(scaled, [F.desc(share), F.col(title)], keep)


def merge_groups(clusters: DataFrame, members: DataFrame, group: str, cluster: str = "cluster", share: str = "percentage"):
    """Merge clusters with the same `group`: fields of the largest share, shares summed, members relabelled."""
    fields = [c for c in clusters.columns if c not in (group, share)]
    first = [cluster] + [c for c in fields if c != cluster]
    lead = F.min(F.struct((-F.col(share)).alias("_s"), *first))
    merged = clusters.groupBy(group).agg(lead.alias("_l"), F.sum(share).alias(share)).select(
        group, share, *[F.col(f"_l.{c}").alias(c) for c in fields])
    moved = members.join(clusters.select(cluster, group), cluster).drop(cluster).join(
        merged.select(group, cluster), group).drop(group)
    return merged, moved


def collect_items(members: DataFrame, cluster: str, order: list[Column], fields: list[str], page_size: int = 1000) -> DataFrame:
    """Nested member lists in pages: (cluster, page, n_items, items)."""
    placed = with_group_position(members, [cluster], order, "_pos", size="n_items")
    items = F.array_sort(F.collect_list(F.struct("_pos", *fields)))
    return placed.withColumn("page", F.floor((F.col("_pos") - 1) / page_size).cast("bigint")).groupBy(
        cluster, "page", "n_items").agg(items.alias("_i")).select(
        cluster, "page", "n_items", F.transform("_i", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("items"))


def persona_counts(items: DataFrame, personas: DataFrame | None = None) -> DataFrame:
    """(persona, cluster, n, persona_total); items of unknown personas do not count."""
    if personas is not None:
        items = items.join(personas.select("persona"), "persona", "left_semi")
    pairs = items.groupBy("persona", "cluster").agg(F.count(F.lit(1)).alias("n"))
    totals = pairs.groupBy("persona").agg(F.sum("n").alias("persona_total"))
    return pairs.join(totals, "persona")


def top_clusters_per_persona(counts: DataFrame, k: int = 3) -> DataFrame:
    best = top_k_per_group(counts, ["persona"], [F.desc("n"), F.col("cluster")], k, "place")
    return best.withColumn("percentage", 100.0 * F.col("n") / F.col("persona_total"))


def top_items(items: DataFrame, k: int = 5) -> DataFrame:
    return top_k_per_group(items, ["persona", "cluster"], [F.desc("score"), F.col("item")], k, "item_place")


def persona_report(items: DataFrame, personas: DataFrame | None = None, n_clusters: int = 3, n_items: int = 5) -> DataFrame:
    """One row per persona with its top clusters, each with its best items (both lists are short)."""
    tops = top_clusters_per_persona(persona_counts(items, personas), n_clusters)
    # the few kept (persona, cluster) pairs cut the items before they are ranked
    kept = items.join(tops.select("persona", "cluster"), ["persona", "cluster"], "left_semi")
    best = top_items(kept, n_items).groupBy("persona", "cluster").agg(
        F.array_sort(F.collect_list(F.struct("item_place", "item", "score"))).alias("items"))
    # fixed value: wording of the description
    text = F.concat(F.lit("Common issue found in "), F.col("n").cast("string"), F.lit(" out of "),
                    F.col("persona_total").cast("string"), F.lit(" pain points for "), "persona")
    rows = tops.join(best, ["persona", "cluster"]).withColumn("description", text)
    return rows.groupBy("persona").agg(F.array_sort(F.collect_list(
        F.struct("place", "cluster", "n", "percentage", "description", "items"))).alias("top_pain_points"))


def titles_first(clusters: DataFrame, title: str, order: str) -> DataFrame:
    """One cluster per title, the first one."""
    others = [c for c in clusters.columns if c not in (title, order)]
    best = clusters.groupBy(title).agg(F.min(F.struct(order, *others)).alias("_b"))
    return best.select(title, F.col(f"_b.{order}").alias(order), *[F.col(f"_b.{c}").alias(c) for c in others])


def cluster_sample(members: DataFrame, arrival: str, distance: str, key: str, n: int = 10, nearest: bool = False,
                   cluster: str = "cluster") -> DataFrame:
    """At most n members per cluster shown by distance: the first n that came, or the n nearest."""
    pick = [F.col(distance), F.col(key)] if nearest else [F.col(arrival), F.col(key)]
    chosen = top_k_per_group(members, [cluster], pick, n, "_rn").drop("_rn")
    # only n rows per cluster are left to sort
    return top_k_per_group(chosen, [cluster], [F.col(distance), F.col(key)], n, "place")


def cluster_report(members: DataFrame, verdicts: DataFrame, source: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Accepted clusters with title, quote, link, score, day, size and share.

    `verdicts` has (cluster, title, quote, quote_id); a null title is a rejected cluster. Only
    rejected clusters are taken out, so their members still count in the total.
    """
    rejected = verdicts.filter(F.col("title").isNull())
    shares = cluster_share(members, rejected, cluster)
    accepted = verdicts.filter(F.col("title").isNotNull())
    return enrich_from_source(accepted, source, "quote_id").join(shares, cluster)


def insight_report(insights: DataFrame) -> DataFrame:
    """Insights where a source and a quote are used once only, the first use by `insight_id`."""
    fields = [c for c in insights.columns if c not in ("insight_id",)]

    def first_per(df: DataFrame, key: str) -> DataFrame:
        rest = [c for c in fields if c != key]
        best = df.groupBy(key).agg(F.min(F.struct("insight_id", *rest)).alias("_b"))
        return best.select(key, "_b.insight_id", *[F.col(f"_b.{c}").alias(c) for c in rest])

    return first_per(first_per(insights, "source"), "quote").select("insight_id", *fields)


def report_tables(space: str, clusters: DataFrame, members: DataFrame, insights: DataFrame, name: str | None = None) -> dict[str, DataFrame]:
    """The seven linked tables of a report, with ids computed from content, not counted.

    `clusters` has (persona, description), `members` (persona, description of a pain point),
    `insights` (insight_id, kind, insight, source, quote, day).
    """
    rid = F.xxhash64(F.lit("report"), F.lit(space))
    spark = clusters.sparkSession
    pid = lambda p: F.xxhash64(F.lit("persona"), F.lit(space), p)
    one = spark.range(1)
    iid = F.xxhash64(F.lit("insight"), F.lit(space))
    reports = one.select(rid.alias("id"), F.lit(space).alias("space"), F.lit(name).alias("name"),
                         F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("objective"),
                         F.lit(None).cast("string").alias("perspective"), F.lit("processing").alias("status"))
    personas = clusters.select("persona").distinct().select(pid(F.col("persona")).alias("id"), F.col("persona").alias("name"), rid.alias("report_id"))
    points = members.select(F.xxhash64(F.lit("pain"), "persona", "description").alias("id"), "description",
                            pid(F.col("persona")).alias("persona_id"), rid.alias("report_id"))
    heads = one.select(iid.alias("id"), F.lit(space).alias("query"), F.lit("").alias("conclusion"), rid.alias("report_id"))
    rows = lambda kind: insights.filter(F.col("kind") == kind).select(
        F.xxhash64(F.lit(kind), "insight_id").alias("id"), "insight", "source", "quote", F.col("day").alias("date"), iid.alias("insight_id"))
    segments = clusters.select("persona", "description").distinct().select(
        F.xxhash64(F.lit("segment"), "persona", "description").alias("id"), F.col("persona").alias("segment"), "description", iid.alias("insight_id"))
    return {"reports": reports, "personas": personas, "pain_points": points, "insights": heads,
            "attitudinal_insights": rows("attitudinal"), "behavioral_insights": rows("behavioral"), "user_segments": segments}


def report_lines(pain_points: DataFrame, personas: DataFrame, ids: DataFrame, page_size: int = 1000) -> DataFrame:
    """The result as JSON lines: one per pain point, one per persona, ids in pages.

    Reading the lines in `part`, `no` order and nesting them gives the one document
    `{"Pain Points": [...], "Personas": [...], "Ids": [...]}`, without building it in one task.
    """
    def lines(df: DataFrame, part: str, order: list[Column]) -> DataFrame:
        from threadloom.operators.ranking import with_row_index
        return with_row_index(df, order, "_no").select(
            F.lit(part).alias("part"), F.col("_no").alias("no"), F.to_json(F.struct(*df.columns)).alias("value"))

    pages = collect_items(ids.select(F.lit(1).alias("_all"), "id"), "_all", [F.col("id")], ["id"], page_size)
    id_lines = pages.select(F.lit("Ids").alias("part"), (F.col("page") + 1).alias("no"), F.to_json(F.col("items.id")).alias("value"))
    return lines(pain_points, "Pain Points", [F.desc("percentage"), F.col("cluster")]).unionByName(
        lines(personas, "Personas", [F.col("persona")])).unionByName(id_lines)
