"""Query keys and the jobs behind them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(key: str):
    def add(job: Callable[[SparkSession, str], DataFrame]):
        QUERIES[key] = job
        return job

    return add
