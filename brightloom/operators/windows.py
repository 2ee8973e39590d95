"""Rolling, expanding, exponentially weighted and rank columns."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import settle
from ..errors import InvalidParameter
from ..functions.statistics import prefix_sums, ranked
from .frame import need, ordered, over_rows, with_row_id


def sample_std(value: Column, over: WindowSpec) -> Column:
    """Sample standard deviation; 0 for a single value, null for none."""
    return F.when(F.count(value).over(over) == 1, F.lit(0.0)).otherwise(F.stddev_samp(value).over(over))


def rolling_mean(df: DataFrame, column: str, window: int, order_by: str | Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Mean of the last ``window`` rows; nulls don't count."""
    need(df, column)
    if window < 1:
        raise InvalidParameter("window must be positive")
    return over_rows(df, order_by, partition_by, lambda over, _: {f"{column}_rolling_mean_{window}": F.avg(column).over(over.rowsBetween(1 - window, 0))}, window - 1)


def rolling_std(df: DataFrame, column: str, window: int, order_by: str | Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    need(df, column)
    if window < 1:
        raise InvalidParameter("window must be positive")
    return over_rows(df, order_by, partition_by, lambda over, _: {f"{column}_rolling_std_{window}": sample_std(F.col(column), over.rowsBetween(1 - window, 0))}, window - 1)


def expanding(df: DataFrame, column: str, order_by: str | Sequence[str], partition_by: Sequence[str] = (), min_periods: int = 1) -> DataFrame:
    """Cumulative mean and standard deviation; NaN before ``min_periods``."""
    need(df, column)
    if not partition_by:
        return _expanding_series(df, column, order_by, min_periods)
    over = W.partitionBy(*partition_by).orderBy(*ordered(order_by)).rowsBetween(W.unboundedPreceding, 0)
    enough = F.count(column).over(over) >= min_periods
    made = {"mean": F.avg(column).over(over), "std": sample_std(F.col(column), over)}
    return df.withColumns({f"{column}_expanding_{k}": F.when(enough, v).otherwise(F.lit(float("nan"))) for k, v in made.items()})


def _expanding_series(df: DataFrame, column: str, order_by: str | Sequence[str], min_periods: int) -> DataFrame:
    """Of one series: cumulative sums of the values less their mean, which
    keeps the squares small, from ranges of rows and the ranges' totals."""
    mean = df.agg(F.avg(column)).first()[0] or 0.0
    gap = F.coalesce(F.col(column) - F.lit(float(mean)), F.lit(0.0))
    rows = prefix_sums(with_row_id(df, order_by, "__row"), "__row", {"__n": F.col(column).isNotNull().cast("long"), "__s": gap, "__q": gap * gap})
    n, s, q = F.col("__n"), F.col("__s"), F.col("__q")
    made = {
        "mean": F.when(n > 0, s / n + F.lit(float(mean))),
        "std": F.when(n == 1, F.lit(0.0)).when(n > 1, F.sqrt(F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1))),
    }
    return rows.withColumns({f"{column}_expanding_{k}": F.when(n >= min_periods, v).otherwise(F.lit(float("nan"))) for k, v in made.items()}).drop("__row", "__n", "__s", "__q")


def full_moving_average(df: DataFrame, column: str, period: int, order_by: str | Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Moving average of full windows only: rows before the first one go."""
    made = over_rows(df, order_by, partition_by, lambda over, n: {"moving_average": F.avg(column).over(over.rowsBetween(1 - period, 0)), "_n": n}, period - 1)
    return made.where(F.col("_n") >= period).drop("_n")


def lag_features(df: DataFrame, column: str, lags: Sequence[int], order_by: str | Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """``lag_k`` columns; rows without all of them go."""
    made = over_rows(df, order_by, partition_by, lambda over, n: {f"lag_{k}": F.lag(column, k).over(over) for k in lags} | {"_n": n}, max(lags))
    return made.where(F.col("_n") > max(lags)).drop("_n")


def ewma(df: DataFrame, column: str, alpha: float, order_by: str | Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Exponentially weighted mean, seeded by the first value; rows with a null
    get null and don't move it.

    A scan: rows are dealt by ranges of (groups, order), so neither a group nor the
    one series without groups is ever in one task. Over a range the mean's state
    goes from s to decay * s + total, which composes; each range reports those
    two for the group it ends in, one pass over these gives every range the state
    it starts with, and the ranges then run on their own."""
    need(df, column, *partition_by)
    if not 0 < alpha <= 1:
        raise InvalidParameter("alpha must lie in (0, 1]")
    target, keys = f"{column}_ewma_{alpha:.2f}", list(partition_by)
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    by = [*[F.col(f"`{c}`") for c in keys], *ordered(names)]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    rows = settle(rows.withColumn("__range", F.spark_partition_id()))  # ranges are sampled: they must not be drawn twice
    slim = rows.select("__range", *[F.col(f"`{c}`").alias(f"__g{k}") for k, c in enumerate(keys)], F.col(f"`{column}`").cast("double").alias("__x"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = first = last = None
        lead, state, whole = None, (1.0, 0.0), True  # first value, decay and total of the last group; is it all
        for batch in batches:
            for s, e, key in _groups(batch, range(1, 1 + len(keys))):
                if number is None:
                    number, first = batch.column(0)[s].as_py(), key
                elif key != last:
                    whole, lead, state = False, None, (1.0, 0.0)
                last = key
                x = batch.column(batch.num_columns - 1).slice(s, e - s).drop_null().to_numpy()
                if len(x):
                    lead = float(x[0]) if lead is None else lead
                    decay = (1 - alpha) ** len(x)
                    state = (state[0] * decay, state[1] * decay + float(alpha * (x * (1 - alpha) ** np.arange(len(x) - 1, -1, -1.0)).sum()))
        if number is not None:
            yield pa.RecordBatch.from_pylist([{"range": number, "first": pickle.dumps(first), "last": pickle.dumps(last), "whole": whole, "lead": lead, "decay": state[0], "total": state[1]}])

    found = slim.mapInArrow(ends, "range long, first binary, last binary, whole boolean, lead double, decay double, total double").orderBy("range").collect()  # a row for each range
    starts, carried, before = {}, None, None
    for r in found:
        first, last = pickle.loads(r["first"]), pickle.loads(r["last"])
        start = carried if before == (first,) else None
        starts[r["range"]] = start
        inside = start if r["whole"] and start is not None else r["lead"]
        carried = r["decay"] * inside + r["total"] if inside is not None else None
        before = (last,)

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(target, T.DoubleType())])
    places = [rows.columns.index(c) for c in keys]
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, begun = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if not begun:
                state, begun = starts[batch.column(batch.num_columns - 1)[0].as_py()], True
                last = _key(batch, places, 0)
            x = batch.column(at).cast(pa.float64()).to_numpy(zero_copy_only=False)
            x = np.where(np.asarray(batch.column(at).is_valid()), x, np.nan)
            groups = list(_groups(batch, places))
            code = np.repeat(np.arange(len(groups)), [e - s for s, e, _ in groups])
            state = state if groups[0][2] == last else None
            # the state so far is a value before the first group's
            series = pd.Series(np.append(np.nan if state is None else state, x)).groupby(np.append(0, code))
            mean = series.ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy()[1:]
            last = groups[-1][2]
            # a run of nulls keeps the mean, so the last one is the state
            state = None if np.isnan(mean[-1]) else float(mean[-1])
            mean = np.where(np.isnan(x), np.nan, mean)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(mean, from_pandas=True)], names=schema.names)

    return rows.mapInArrow(run, schema)


def _key(batch: pa.RecordBatch, places: Sequence[int], row: int) -> tuple:
    return tuple(batch.column(c)[row].as_py() for c in places)


def _groups(batch: pa.RecordBatch, places: Sequence[int]) -> Iterator[tuple[int, int, tuple]]:
    """(start, end, key) of the runs of equal keys, in the columns ``places``."""
    if not batch.num_rows:
        return
    change = np.zeros(batch.num_rows, bool)
    for c in places:
        a, b = batch.column(c)[1:], batch.column(c)[:-1]
        change[1:] |= np.asarray(pc.fill_null(pc.not_equal(a, b), False)) | np.asarray(pc.xor(pc.is_null(a), pc.is_null(b)))
    edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
    for s, e in zip(edges, edges[1:], strict=False):
        yield s, e, _key(batch, places, s)


def average_rank(df: DataFrame, column: str, name: str = "rank", partition_by: Sequence[str] = ()) -> DataFrame:
    """1-based rank, ties sharing their mean; nulls come first."""
    if not partition_by:
        nulls = df.where(F.col(column).isNull()).count()
        ranks = ranked(df, column, "__rank").withColumnRenamed(column, "__value")
        joined = df.join(ranks, F.col(column) == F.col("__value"), "left").drop("__value")
        rank = F.when(F.col(column).isNull(), F.lit((nulls + 1) / 2)).otherwise(F.col("__rank") + nulls)
        return joined.withColumn(name, rank).drop("__rank")
    over = W.partitionBy(*partition_by).orderBy(F.col(column))
    peers = F.count(F.lit(1)).over(W.partitionBy(*partition_by, column))
    return df.withColumn(name, F.rank().over(over) + (peers - 1) / 2)
