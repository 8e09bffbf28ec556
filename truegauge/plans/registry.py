"""Named queries and, where SQL can say the same, their comparison text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from truegauge.plans.history import Inputs, with_views
from truegauge.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(inputs)`` under a name; ``sql`` may use base and derived tables."""

    def register(build: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"Query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Inputs(prepare(spark), folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return register
