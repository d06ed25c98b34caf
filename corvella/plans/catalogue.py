"""All registered queries outside the llm subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvella.plans import admin, corpus, details, graph, parsing, people, storage, streams, subjects, texts

PARTS = (graph, corpus, subjects, texts, people, streams, parsing, admin, storage, details)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in PARTS for name, f in part.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.R.sql.items()}
