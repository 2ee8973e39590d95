"""Joins, grouping, reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidParameter, TypeMismatch
from .frame import is_numeric, need, numeric_columns

JOINS = {"inner": "inner", "left": "left", "right": "right", "outer": "full_outer", "semi": "left_semi", "anti": "left_anti"}


def join(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Equi-join on columns of the same name. Other columns that both sides
    have get suffixes; the key is coalesced. Null keys never match. Which side
    is broadcast, if any, is left to the optimizer's size estimates."""
    keys = [on] if isinstance(on, str) else list(on)
    need(left, *keys)
    need(right, *keys)
    if how not in JOINS:
        raise InvalidParameter(f"how must be one of {list(JOINS)}")
    if how not in ("semi", "anti"):
        clash = [c for c in left.columns if c in right.columns and c not in keys]
        left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
        right = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    return left.join(right, keys, JOINS[how])


AGGREGATIONS = ("sum", "mean", "min", "max", "count", "first", "last")


def aggregate(name: str, how: str, order_by: str | None = None) -> Column:
    """One aggregation; sums, means and extremes as doubles, count of values
    that aren't null, first and last of those by ``order_by``."""
    value = F.col(name).cast("double")
    if how in ("first", "last"):
        if order_by is None:
            raise InvalidParameter("first and last need order_by")
        pick = F.min_by if how == "first" else F.max_by
        return pick(F.col(name), F.when(F.col(name).isNotNull(), F.col(order_by)))
    made = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}
    if how == "count":
        return F.count(name)
    if how not in made:
        raise InvalidParameter(f"aggregation must be one of {AGGREGATIONS}")
    return made[how](value)


class Grouped:
    """``group_by(df, keys)``: aggregations over groups; null is a key."""

    def __init__(self, df: DataFrame, *keys: str):
        need(df, *keys)
        self.df, self.keys = df, list(keys)

    def _each(self, how: str) -> DataFrame:
        columns = numeric_columns(self.df, self.keys)
        return self.df.groupBy(*self.keys).agg(*[aggregate(c, how).alias(c) for c in columns])

    def count(self) -> DataFrame:
        """The number of rows, in every numeric column or else in ``count``."""
        columns = numeric_columns(self.df, self.keys) or ["count"]
        return self.df.groupBy(*self.keys).agg(*[F.count(F.lit(1)).alias(c) for c in columns])

    def sum(self) -> DataFrame:
        return self._each("sum")

    def mean(self) -> DataFrame:
        return self._each("mean")

    def min(self) -> DataFrame:
        return self._each("min")

    def max(self) -> DataFrame:
        return self._each("max")

    def agg(self, how: Mapping[str, str | Sequence[str]], order_by: str | None = None) -> DataFrame:
        """{column: aggregation(s)} -> columns named ``column_aggregation``."""
        made = []
        for c, names in how.items():
            need(self.df, c)
            for one in [names] if isinstance(names, str) else names:
                if one in ("sum", "mean") and not is_numeric(self.df, c):
                    raise TypeMismatch(f"{one} needs a number, not {c!r}")
                made.append(aggregate(c, one, order_by).alias(f"{c}_{one}"))
        return self.df.groupBy(*self.keys).agg(*made)

    def transform(self, how: Mapping[str, str]) -> DataFrame:
        """Each row with its group's value as ``column_group_aggregation``."""
        over = W.partitionBy(*self.keys)
        return self.df.withColumns({f"{c}_group_{one}": aggregate(c, one).over(over) for c, one in how.items()})


def group_by(df: DataFrame, *keys: str) -> Grouped:
    return Grouped(df, *keys)


def pivot(df: DataFrame, index: str, columns: str, values: str, how: str = "mean", order_by: str | None = None, names: Sequence[object] | None = None) -> DataFrame:
    """One row for each index value, one column for each value of ``columns``;
    give ``names`` to save the job that finds them. A null key becomes "null"."""
    need(df, index, columns, values)
    df = df.withColumn(columns, F.coalesce(F.col(columns).cast("string"), F.lit("null")))
    grouped = df.groupBy(index).pivot(columns, list(names) if names is not None else None)
    return grouped.agg(aggregate(values, how, order_by))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str] = (), var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """Long form; without ``values`` all other columns."""
    values = list(values) or [c for c in df.columns if c not in ids]
    need(df, *ids, *values)
    return df.unpivot(list(ids), values, var_name, value_name)
