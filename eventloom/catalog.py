"""Every query of the library outside the llm subpackage, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventloom.plans import analysis, checks, extraction, inference, joins, relational, studies, texts, timeline

FLAGSHIP = "S-01_run_blocks"
PLANS = (timeline, joins, relational, analysis, studies, texts, inference, extraction, checks)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for plan in PLANS for name, (f, _) in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, (_, sql) in plan.QUERIES.items() if sql}
