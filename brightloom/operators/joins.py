"""Joins whose keys may be hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A broadcast side has at most so many rows and bytes, both measured.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20
#: Keys of at least this part of all rows are heavy; so there are no more.
HEAVY = 4096


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most so many rows and bytes, found by reading no more."""
    width = F.lit(8 * len(df.columns)).cast("long")
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            width = width + F.octet_length(F.to_json(F.struct(F.col(f"`{name}`"))))
    got = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return got["n"] <= rows and got["b"] <= size


def join_counted(left: DataFrame, right: DataFrame, on: Sequence[str], count: str) -> DataFrame:
    """Inner join with the one row of ``right`` for each key, whose column
    ``count`` says how many rows of ``left`` have it. All of ``right`` is broadcast
    if it is small; else the keys that hold a part of 1 in ``HEAVY`` of all rows,
    of which there are few, and the others meet by a shuffle."""
    if small(right):
        return left.join(F.broadcast(right), list(on))
    total = right.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first()["n"]
    heavy = F.col(count) * HEAVY >= F.lit(max(total, 1))
    most = right.where(heavy)
    if not small(most):
        return left.join(right, list(on))
    rest = left.join(F.broadcast(most.select(*on)), list(on), "left_anti").join(right.where(~heavy), list(on))
    return left.join(F.broadcast(most), list(on)).unionByName(rest)


def join_hot(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """``join_counted`` where nothing is known of the keys: heavy ones are looked for
    by a sketch of bounded size over ``left``. A key that it misses is shuffled like
    any other, so it steers the work and not the result."""
    if small(right):
        return left.join(F.broadcast(right), on)
    found = left.where(F.col(on).isNotNull()).agg(F.expr(f"approx_top_k(`{on}`, 64, 4096)").alias("top"), F.count(F.lit(1)).alias("n")).first()
    keys = [r[0] for r in found["top"] or () if r[1] * 256 >= found["n"]]
    if not keys:
        return left.join(right, on)
    hot = F.col(on).isin(keys)
    few = right.where(hot)
    if not small(few):
        return left.join(right, on)
    return left.where(hot).join(F.broadcast(few), on).unionByName(left.where(~hot | F.col(on).isNull()).join(right.where(~hot), on))
