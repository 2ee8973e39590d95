"""Streams of files: the same verbs, incrementally."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_csv(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1, header: bool = True) -> DataFrame:
    """One schema for all chunks."""
    return spark.readStream.schema(schema).option("header", header).option("maxFilesPerTrigger", files_per_batch).csv(path)


def stream_json(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def stream_parquet(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def each_chunk(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``work`` on each micro-batch until the source is read."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def group_stream(stream: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """A running aggregation; write it in complete or update mode."""
    return stream.groupBy(*keys).agg(*[v.alias(k) for k, v in aggregates.items()])


def tumbling(stream: DataFrame, time: str, width: str, late: str, keys: Sequence[str] = (), **aggregates: Column) -> DataFrame:
    """Windowed aggregation of event time with a watermark. Works on batches
    too. Timestamps without a zone are taken as UTC."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = rows.groupBy(F.window(time, width), *keys).agg(*[v.alias(k) for k, v in aggregates.items()])
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggregates)


def run_to_table(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drain an available source into an in-memory table (small results)."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
