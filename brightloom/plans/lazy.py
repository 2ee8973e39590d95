"""Deferred chains of verbs. Spark plans are lazy already; this keeps the
verbs inspectable before a source is opened."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession

from ..sources import files


@dataclass(frozen=True)
class LazyFrame:
    source: Callable[[], DataFrame]
    nodes: tuple[tuple[str, object], ...] = field(default=())

    def filter(self, predicate: Column | str) -> LazyFrame:
        return LazyFrame(self.source, (*self.nodes, ("filter", predicate)))

    def select(self, *names: str) -> LazyFrame:
        return LazyFrame(self.source, (*self.nodes, ("select", names)))

    def plan(self) -> DataFrame:
        df = self.source()
        for kind, what in self.nodes:
            df = df.where(what) if kind == "filter" else df.select(*what)
        return df

    def collect(self) -> list:
        return self.plan().collect()

    def explain(self) -> None:
        self.plan().explain("formatted")


def lazy(df: DataFrame) -> LazyFrame:
    return LazyFrame(lambda: df)


def lazy_csv(spark: SparkSession, path: str, **options) -> LazyFrame:
    return LazyFrame(lambda: files.read_csv(spark, path, **options))


def lazy_feather(spark: SparkSession, path: str) -> LazyFrame:
    return LazyFrame(lambda: files.read_feather(spark, path))
