"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nilas.sources.views import PRELUDE, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of Views under a name, with SQL over the same views (which may begin with CTEs of its own)."""

    def add(build: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
        if sql:
            body = sql.strip()
            ORACLES[name] = PRELUDE + (", " + body[5:] if body.startswith("WITH ") else body)
        return build

    return add
