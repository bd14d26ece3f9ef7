"""Queries over the given tables, each with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from threadloom.plans.views import SQL_VIEWS, Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _with_views(sql: str, views: list[str]) -> str:
    """Put the shared views before the twin's own WITH clause."""
    if not views:
        return sql
    shared = ", ".join(SQL_VIEWS[v].strip() for v in views)
    for head in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(head):
            return f"{head}{shared}, {sql[len(head):]}"
    return f"WITH {shared} {sql}"


def query(key: str, sql: str | None = None, views: str = ""):
    """Register a query; `views` names the shared SQL views its twin uses."""

    def add(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = _with_views(sql.strip(), views.split())
        return fn

    return add


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))
        return run

    return {k: bind(fn) for k, fn in QUERIES.items()}
