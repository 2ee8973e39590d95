"""Projection, row and ordering verbs: functions from DataFrame to DataFrame.

Rows of a Spark DataFrame have no order, so every verb that needs one takes
``order_by`` (and a partition where that makes sense). Nulls sort last in both
directions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import settle
from ..errors import CastFailed, ColumnNotFound, DuplicateColumn, InvalidParameter, PartialCastFailure

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
CHUNK = 65_536


def need(df: DataFrame, *names: str) -> None:
    for name in names:
        if name not in df.columns:
            raise ColumnNotFound(f"{name!r} is not among {df.columns}")


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NUMERIC)


def numeric_columns(df: DataFrame, besides: Sequence[str] = ()) -> list[str]:
    return [c for c in df.columns if c not in besides and is_numeric(df, c)]


def select(df: DataFrame, *names: str) -> DataFrame:
    need(df, *names)
    if len(set(names)) < len(names):
        raise DuplicateColumn(f"repeated in {names}")
    return df.select(*names)


def drop(df: DataFrame, *names: str) -> DataFrame:
    need(df, *names)
    return df.drop(*names)


def with_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Replace in place, or append."""
    return df.withColumn(name, value)


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    need(df, old)
    if new != old and new in df.columns:
        raise DuplicateColumn(new)
    return df.withColumnRenamed(old, new)


def add_column(df: DataFrame, name: str, value: Column | Callable, kind: str | None = None) -> DataFrame:
    """A column from an expression, or (slow path) from a Python function of
    the row's columns as pandas Series."""
    if isinstance(value, Column):
        return df.withColumn(name, value)
    return df.withColumn(name, F.pandas_udf(value, kind)(*[F.col(c) for c in df.columns]))


def map_column(df: DataFrame, name: str, transform: Callable[[Column], Column]) -> DataFrame:
    """Replace a column by an expression of itself; nulls reach it too."""
    need(df, name)
    return df.withColumn(name, transform(F.col(name)))


def cast_column(df: DataFrame, name: str, kind: str, strict: bool = True) -> DataFrame:
    """Cast through text. ``strict`` runs one aggregation and raises if any
    value that isn't null can't be cast; otherwise such values become null."""
    need(df, name)
    made = F.expr(f"try_cast(trim(cast(`{name}` as string)) as {kind})")
    if strict:
        n, failed = df.agg(F.count(name), F.count_if(F.col(name).isNotNull() & made.isNull())).first()
        if failed:
            raise (CastFailed if failed == n else PartialCastFailure)(f"{failed} of {n} values of {name!r} are no {kind}")
    return df.withColumn(name, made)


def ordered(order_by: str | Sequence[str], ascending: bool = True) -> list[Column]:
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    return [F.col(n).asc_nulls_last() if ascending else F.col(n).desc_nulls_last() for n in names]


def sort_by(df: DataFrame, *names: str, ascending: bool = True) -> DataFrame:
    need(df, *names)
    return df.orderBy(*ordered(names, ascending))


def head(df: DataFrame, n: int = 5, order_by: str | Sequence[str] = ()) -> DataFrame:
    return df.orderBy(*ordered(order_by)).limit(n) if order_by else df.limit(n)


def tail(df: DataFrame, n: int, order_by: str | Sequence[str]) -> DataFrame:
    """The last n rows, in order: a bounded top-n from the other end."""
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*[F.col(c).desc_nulls_first() for c in names]).limit(n).orderBy(*ordered(names))


def with_lag(df: DataFrame, column: str, by: int, name: str, order_by: str | Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """by > 0 looks back, by < 0 ahead, 0 copies."""
    need(df, column)
    if not by:
        return df.withColumn(name, F.col(column))
    value = F.lag(column, by) if by > 0 else F.lead(column, -by)
    return over_rows(df, order_by, partition_by, lambda over, _: {name: value.over(over)}, max(by, 0), max(-by, 0))


def over_rows(
    df: DataFrame,
    order_by: str | Sequence[str],
    partition_by: Sequence[str],
    made: Callable[[WindowSpec, Column], dict[str, Column]],
    before: int,
    after: int = 0,
) -> DataFrame:
    """``df`` with the columns that ``made`` gives for a window and the row's
    number from 1; they may look at ``before`` rows back and ``after`` ahead.
    Without ``partition_by`` the one series is cut into chunks of numbered rows,
    and the rows at a chunk's ends are sent to the next one too, so that no
    task sorts the whole series."""
    if partition_by:
        over = W.partitionBy(*partition_by).orderBy(*ordered(order_by))
        return df.withColumns(made(over, F.row_number().over(over)))
    size = max(CHUNK, before, after)
    at, row = F.floor(F.col("__row") / size), F.col("__row") % size
    chunks = F.array_compact(F.array(at, F.when(row >= size - before, at + 1), F.when((row < after) & (at > 0), at - 1)))
    rows = with_row_id(df, order_by, "__row").withColumn("__own", at).withColumn("__chunk", F.explode(chunks))
    rows = rows.withColumns(made(W.partitionBy("__chunk").orderBy("__row"), F.col("__row") + 1))
    return rows.where("__own = __chunk").drop("__row", "__own", "__chunk")


def with_row_id(df: DataFrame, order_by: str | Sequence[str], name: str = "row_id", partitions: int | None = None) -> DataFrame:
    """Consecutive numbers from 0 in the given (total) order, without one
    global window: rows are dealt by ranges, numbered within them, and the
    ranges' sizes (one number each) shift them."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *ordered(order_by)).sortWithinPartitions(*ordered(order_by)).withColumn("__at", F.monotonically_increasing_id())
    dealt = settle(dealt).withColumn("__range", F.shiftright("__at", 33))  # ranges are sampled: they must not be drawn twice
    sizes = {r["__range"]: r["n"] for r in dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for k in sorted(sizes):
        before[k], total = total, total + sizes[k]
    shift = F.lit(0).cast("long")
    if before:
        shift = F.element_at(F.create_map(*[F.lit(int(x)).cast("long") for kv in before.items() for x in kv]), F.col("__range"))
    return dealt.withColumn(name, F.col("__at") - F.shiftleft("__range", 33) + shift).drop("__at", "__range")


def row_at(df: DataFrame, index: int, order_by: str | Sequence[str]) -> dict | None:
    """The row at a position from 0, as a dict; only that row leaves the executors."""
    row = with_row_id(df, order_by, "__row").where(F.col("__row") == index).drop("__row").first()
    return row.asDict() if row else None


def gather(df: DataFrame, positions: Sequence[int], order_by: str | Sequence[str]) -> DataFrame:
    """Rows at the given positions, in their order, repeats included."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(k, int(p)) for k, p in enumerate(positions)], "_nth long, _row long")
    rows = with_row_id(df, order_by, "_row")
    return rows.join(F.broadcast(wanted), "_row").orderBy("_nth").drop("_row", "_nth")


def filter_positions(df: DataFrame, keep: Callable[[Column], Column], order_by: str | Sequence[str]) -> DataFrame:
    """Rows whose position from 0 satisfies a predicate expression."""
    return with_row_id(df, order_by, "_row").where(keep(F.col("_row"))).drop("_row")


def sample_n(df: DataFrame, n: int, key: str | Sequence[str], seed: int = 0) -> DataFrame:
    """Exactly n rows without replacement (all, if fewer): the first by a
    seeded hash of the key, which doesn't depend on partitioning."""
    if n < 0:
        raise InvalidParameter("n must not be negative")
    names = [key] if isinstance(key, str) else list(key)
    return df.orderBy(F.xxhash64(F.lit(seed), *names), *names).limit(n)


def train_test_split(df: DataFrame, key: str | Sequence[str], test_size: float = 0.25, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Disjoint (train, test); test has exactly floor(n * test_size) rows: the
    last by a seeded hash of the key. The threshold is found by a quantile of
    hashes, so no global sort of rows takes place."""
    if not 0 < test_size < 1:
        raise InvalidParameter("test_size must lie between 0 and 1")
    marked = with_row_id(df.withColumn("_h", F.xxhash64(F.lit(seed), *([key] if isinstance(key, str) else key))), "_h", "_row")
    n = df.count()
    first = n - int(n * test_size)
    return marked.where(F.col("_row") < first).drop("_h", "_row"), marked.where(F.col("_row") >= first).drop("_h", "_row")


def distinct_rows(df: DataFrame, order_by: str | Sequence[str] | None = None, subset: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows; with ``order_by``, the first of each by that order."""
    if order_by is None:
        return df.dropDuplicates(list(subset)) if subset else df.distinct()
    names = list(subset or df.columns)
    first = F.min_by(F.struct(*df.columns), F.struct(*([order_by] if isinstance(order_by, str) else order_by)))
    return df.groupBy(*[F.col(n).alias(f"_k{i}") for i, n in enumerate(names)]).agg(first.alias("_row")).select("_row.*")


def unique_values(df: DataFrame, name: str) -> DataFrame:
    need(df, name)
    return df.select(name).distinct()


def drop_nulls(df: DataFrame, *names: str) -> DataFrame:
    need(df, *names)
    return df.dropna(subset=list(names) or None)


def fill_null(df: DataFrame, name: str, value: object) -> DataFrame:
    need(df, name)
    return df.withColumn(name, F.coalesce(F.col(name), F.lit(value).cast(df.schema[name].dataType)))


def feature_array(df: DataFrame, names: Sequence[str], name: str = "features", missing: float = float("nan")) -> DataFrame:
    """Numeric and boolean columns as one array of doubles; nulls as ``missing``."""
    need(df, *names)
    return df.withColumn(name, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(missing)) for c in names]))


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def snapshot_diff(old: DataFrame, new: DataFrame) -> dict[str, list[str]]:
    """Columns added and removed between two frames."""
    return {"added": [c for c in new.columns if c not in old.columns], "removed": [c for c in old.columns if c not in new.columns]}
