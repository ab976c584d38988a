"""All registered queries outside the corpus operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import data_tests
from . import corpus, relational, surface

FLAGSHIP = "pricing_summary"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return relational.queries() | surface.queries() | data_tests.queries() | corpus.queries()


def oracle_sql() -> dict[str, str]:
    return relational.oracle_sql() | surface.oracle_sql() | data_tests.oracle_sql() | corpus.oracle_sql()
