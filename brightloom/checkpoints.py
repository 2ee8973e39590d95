"""Reliable checkpoints in the folder that the cluster's processes share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in ``spark.checkpoint.dir``: partition
    numbers and ranges stay what they were, also after the loss of an executor.
    Only where no folder is set and all threads are this machine's, as in tests,
    a temporary one takes its place."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not re.fullmatch(r"local(\[[^-]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(path or "file://" + tempfile.mkdtemp(prefix="brightloom-"))
    return df.checkpoint()


def held(df: DataFrame, few: int) -> DataFrame:
    """``df`` computed once: kept by the driver if it is ``few`` rows at most (so
    rows must be of bounded size), else settled."""
    some = df.limit(few + 1).collect()
    return df.sparkSession.createDataFrame(some, df.schema) if len(some) <= few else settle(df)
