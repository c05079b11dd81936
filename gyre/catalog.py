"""All queries of the library outside its optional parts, and their SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gyre.plans import judging, oracles, reports, studies, trees, whole
from gyre.plans import queries as plans


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return plans.queries() | reports.queries() | judging.queries() | studies.queries() | trees.queries() | whole.queries()


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql() | reports.oracle_sql() | judging.oracle_sql() | studies.oracle_sql() | trees.oracle_sql() | whole.oracle_sql()
