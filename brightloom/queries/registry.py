"""Queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """``t.lineitem`` reads a table of a directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Register a function of ``Tables``; without SQL it is tested otherwise."""

    def register(work: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or work.__name__
        QUERIES[key] = lambda spark, sf_dir: work(Tables(spark, sf_dir))
        if sql:
            ORACLES[key] = sql
        return work

    return register
