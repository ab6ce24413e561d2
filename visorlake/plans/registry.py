"""Named queries over the given tables and, where SQL can say the same, their check text."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from visorlake.plans.fixtures import Fixtures, check_sql
from visorlake.session import ship

QUERIES: dict[str, Callable[[Fixtures], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check_sql(check)
        return fn
    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from visorlake.plans import columns, curation, flows, relations, summaries  # noqa: F401

    def bound(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(Fixtures(spark, folder))
        return run

    return {name: bound(fn) for name, fn in QUERIES.items()}


def all_checks() -> dict[str, str]:
    all_queries()
    return dict(CHECKS)
