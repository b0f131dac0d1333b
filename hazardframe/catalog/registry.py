"""Query registry: each entry is a Spark callable and, where SQL can say it, a twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hazardframe.operators.common import size_files_as_rows
from hazardframe.testviews import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(v)`` under ``name``; ``v`` gives the input frames of a data folder."""

    def wrap(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise KeyError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            size_files_as_rows(spark)
            return fn(Views(spark, sf_dir))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return wrap
