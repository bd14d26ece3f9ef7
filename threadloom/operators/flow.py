"""A report request as one restartable flow: search, rerank, extraction, clusters, shares, result document.

Every stage is written under the run's folder and read back; a stage counts as done when its write committed.
A run that starts again on the same folder goes on after its last whole stage, and inside the
extraction stage after its last answered list.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threadloom.operators import cluster as CL, infer, report, search
from threadloom.operators.extract import pain_point_filter, pain_points_of, persona_filter, personas_of
from threadloom.runtime import exists


@dataclass
class StagedRun:
    """Named stages under one folder on shared storage."""

    spark: SparkSession
    path: str
    ran: list[str] = field(default_factory=list)  # stages that this start had to run

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        target = f"{self.path}/{name}"
        if not exists(self.spark, f"{target}/_SUCCESS"):  # an unfinished write has no mark and is replaced
            make().write.mode("overwrite").parquet(target)
            self.ran.append(name)
        return self.spark.read.parquet(target)


def _with_id(rows: DataFrame, *parts: str) -> DataFrame:
    """One row per content, named by its hash; stages after this one may run again on the same ids."""
    return rows.withColumn("item_id", F.xxhash64(*parts)).dropDuplicates(["item_id"])


def _members(run: StagedRun, name: str, rows: DataFrame, text: Column, embed, clusters: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows with their cluster (a string) and the distance to its exemplar; what belongs nowhere is left out."""
    vectors = run.stage(f"{name}_vectors", lambda: infer.embed_column(rows.select("item_id", text.alias("_text")), "_text", **embed).select(
        F.col("item_id").alias("id"), "v"))
    placed = run.stage(f"{name}_clusters", lambda: clusters(vectors))
    return rows.join(placed.filter(F.col("cluster") != CL.MISC), rows.item_id == placed.id).select(
        rows["*"], placed.cluster.cast("string").alias("cluster"), "distance")


def report_request(
    run: StagedRun, docs: DataFrame, queries: DataFrame, query_vectors: DataFrame, terms: DataFrame, scorer, extract,
    cut: float = 0.25, keep: int | None = None, threshold: float = 0.85, hits: int = search.HITS, page_size: int = 1000,
    embed: dict | None = None, **density,
) -> DataFrame:
    """Runs what is missing of the flow and returns the lines of the result document (part, no, value).

    `docs` are search documents with vectors, `queries` (qid, query) the texts for the reranker, `scorer` and `extract`
    batched functions. Stages: candidates (all queries), reranked, answers, pain_points, personas, their vectors and
    clusters, shares, persona_report, result.
    """
    embed = embed or {}
    candidates = run.stage("candidates", lambda: search.best_query_per_doc(
        search.weighted_closeness(docs, query_vectors, terms, hits=hits).select("qid", "id", "score")))
    text = F.concat_ws(" ", "title", "body").alias("text")
    chosen = docs.join(candidates.select("id"), "id", "left_semi")
    reranked = run.stage("reranked", lambda: search.rerank_top(search.rerank_best_query(chosen.select("id", text), queries, "text", scorer), cut, keep))
    asked = chosen.join(reranked.select("id"), "id", "left_semi").select("id", text)
    answers = run.stage("answers", lambda: infer.infer_with_ledger(asked, "id", "text", extract, f"{run.path}/ledger"))
    known = candidates.select(F.col("id").cast("string").alias("post_id"))
    points = run.stage("pain_points", lambda: _with_id(
        pain_point_filter(pain_points_of(answers, "result", ["id"]), known), "post_id", "title", "description", "quote", "persona"))
    personas = run.stage("personas", lambda: _with_id(
        persona_filter(personas_of(answers, "result", ["id"]), known), "post_id", "title", "description", "quote"))

    about = F.concat_ws(" ", "title", "description")
    point_members = _members(run, "pain_point", points, about, embed, lambda v: CL.exemplar_clusters(v, threshold))
    persona_members = _members(run, "persona", personas, about, embed, lambda v: CL.density_clusters(v, **density))
    shares = run.stage("shares", lambda: report.renormalise_share(report.cluster_share(point_members.select("cluster"))))
    items = point_members.select("persona", "cluster", F.col("title").alias("item"), (-F.col("distance")).alias("score"))
    tops = run.stage("persona_report", lambda: report.persona_report(items))
    names = run.stage("persona_names", lambda: persona_members.groupBy(F.col("cluster")).agg(
        F.min_by("title", F.struct("distance", "item_id")).alias("persona"), F.count(F.lit(1)).alias("n_items")))
    named = names.join(tops, "persona", "left").select("persona", "n_items", "top_pain_points")
    return run.stage("result", lambda: report.report_lines(shares, named, reranked.select("id"), page_size))
