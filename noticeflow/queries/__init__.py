"""Registered queries: every operator on the shared tables, with the same result stated as plain SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    """Register a query; without an oracle its rows are only counted."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from noticeflow.queries import (items, linkage, messages, personal_data, registration,  # noqa: F401
                                    shaping, streams)
    return QUERIES, ORACLES
