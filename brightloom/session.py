"""Session factory with the settings that the toolkit is tested under."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def get_session(app: str = "brightloom", master: str | None = None, **conf: str) -> SparkSession:
    """An existing session, or a new one: adaptive execution on, UTC, Arrow for
    Python functions. Sizes of shuffles are left to adaptive execution, which
    coalesces; set ``spark.sql.shuffle.partitions`` for the cluster at hand."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def show_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it,
    also if it's neither installed nor in their working folder."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    there = env.get("PYTHONPATH", "")
    if root not in there.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, there) if x)
