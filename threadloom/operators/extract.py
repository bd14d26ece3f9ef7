"""Turning model answers (JSON text) into typed rows and keeping the trustworthy ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from threadloom import schemas
from threadloom.functions.text import emotion_polarity, json_or_empty


def judgement_filter(rows: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Rows whose two verdicts are both present and true; a missing verdict drops the row."""
    both = F.coalesce("space_match", F.lit(False)) & F.coalesce("perspective_match", F.lit(False))
    return rows.join(verdicts.filter(both).select(key), key, "left_semi")


def parse_judgements(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    j = json_or_empty(F.col(text), schemas.JUDGEMENT)
    return df.select(*keep, j.alias("_j")).select(*keep, "_j.space_match", "_j.perspective_match")


def _records(df: DataFrame, text: str, field: str, element: T.StructType, keep: list[str]) -> DataFrame:
    wrapper = T.StructType([T.StructField(field, T.ArrayType(element))])
    parsed = json_or_empty(F.col(text), wrapper)
    return df.select(*keep, F.explode(parsed[field]).alias("_r")).select(*keep, "_r.*")


def pain_points_of(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per extracted pain point; a topic given as a plain string stays text, not an object."""
    rows = _records(df, text, "pain_points", schemas.PAIN_POINT, keep)
    topic = F.from_json("issue_topic", schemas.TOPIC)
    is_object = F.col("issue_topic").startswith("{")
    return rows.withColumn("topic", F.when(is_object, topic)).drop("issue_topic")


def personas_of(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    return _records(df, text, "personas", schemas.PERSONA, keep)


def pain_point_filter(points: DataFrame, known: DataFrame, id_col: str = "post_id", cut: float = -0.4) -> DataFrame:
    """Negative enough, about the space, quote fits the pain, quote relevant, id known."""
    flag = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    kept = points.filter(
        F.col("topic").isNotNull()
        & (emotion_polarity(F.coalesce("issue_emotion", F.lit(""))) < cut)
        & flag("topic.match_space_topic", False)
        & flag("topic.match_quote_pain", True)
        & flag("is_quote_relevant", False)
    )
    return kept.join(known.select(id_col), id_col, "left_semi")


def persona_filter(personas: DataFrame, known: DataFrame, id_col: str = "post_id") -> DataFrame:
    kept = personas.filter(F.coalesce("is_quote_relevant", F.lit(False)))
    return kept.join(known.select(id_col), id_col, "left_semi")
