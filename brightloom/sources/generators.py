"""Seeded synthetic datasets, made by the executors from row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *salt: object) -> Column:
    """A number in [0, 1) that depends on the row's id and the seed only."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(seed), *[F.lit(s) for s in salt]), F.lit(1 << 53)) / float(1 << 53)


def gauss(seed: int, *salt: object) -> Column:
    u, v = F.greatest(uniform(seed, *salt, "u"), F.lit(1e-12)), uniform(seed, *salt, "v")
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def make_classification(spark: SparkSession, n: int, features: int = 4, classes: int = 2, gap: float = 2.0, seed: int = 42) -> DataFrame:
    rows = spark.range(n).withColumn("label", F.pmod("id", F.lit(classes)).cast("int"))
    return rows.select("id", *[(gauss(seed, j) + F.col("label") * gap * (1 if j % 2 == 0 else -0.5)).alias(f"f{j}") for j in range(features)], "label")


def make_regression(spark: SparkSession, n: int, features: int = 4, noise: float = 0.1, seed: int = 42) -> DataFrame:
    rows = spark.range(n).withColumns({f"f{j}": gauss(seed, j) for j in range(features)})
    return rows.withColumn("target", sum((F.col(f"f{j}") * (j + 1) for j in range(features)), F.lit(0.0)) + gauss(seed, "noise") * noise)


def make_moons(spark: SparkSession, n: int, noise: float = 0.05, seed: int = 42) -> DataFrame:
    t, upper = uniform(seed, "t") * math.pi, F.col("label") == 0
    rows = spark.range(n).withColumn("label", F.pmod("id", F.lit(2)).cast("int"))
    x, y = F.when(upper, F.cos(t)).otherwise(1 - F.cos(t)), F.when(upper, F.sin(t)).otherwise(0.5 - F.sin(t))
    return rows.select("id", (x + gauss(seed, "x") * noise).alias("x"), (y + gauss(seed, "y") * noise).alias("y"), "label")


def make_clusters(spark: SparkSession, n: int, k: int = 3, features: int = 2, spread: float = 0.5, seed: int = 42) -> DataFrame:
    rows = spark.range(n).withColumn("label", F.pmod("id", F.lit(k)).cast("int"))
    center = lambda j: 10 * F.sin(F.col("label") * (j + 1.7) + seed)
    return rows.select("id", *[(center(j) + gauss(seed, j) * spread).alias(f"f{j}") for j in range(features)], "label")


def make_circles(spark: SparkSession, n: int, factor: float = 0.5, noise: float = 0.05, seed: int = 42) -> DataFrame:
    rows = spark.range(n).withColumn("label", F.pmod("id", F.lit(2)).cast("int"))
    r, t = F.when(F.col("label") == 0, 1.0).otherwise(factor), uniform(seed, "t") * 2 * math.pi
    return rows.select("id", (r * F.cos(t) + gauss(seed, "x") * noise).alias("x"), (r * F.sin(t) + gauss(seed, "y") * noise).alias("y"), "label")
