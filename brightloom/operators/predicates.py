"""Filter conditions as Column expressions, so that they reach the scan.

Comparisons with null are false (also !=). NaN compares as in IEEE 754: every
comparison but != is false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidParameter, TypeMismatch
from .frame import NUMERIC, need

OPERATORS = {
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
}
NAMES = {"equals": "==", "notEquals": "!=", "greaterThan": ">", "lessThan": "<", "greaterOrEqual": ">=", "lessOrEqual": "<=", "=": "=="}


def condition(df: DataFrame, name: str, op: str, value: object = None) -> Column:
    """op: a comparison, isNull, isNotNull or contains."""
    need(df, name)
    kind, column, op = df.schema[name].dataType, F.col(name), NAMES.get(op, op)
    if op.lower() == "isnull":
        return column.isNull()
    if op.lower() == "isnotnull":
        return column.isNotNull()
    text = isinstance(kind, (T.StringType, T.CharType, T.VarcharType))
    if op == "contains":
        if not text or not isinstance(value, str):
            raise TypeMismatch(f"contains needs text, {name!r} is {kind.simpleString()}")
        return column.contains(value)
    if op not in OPERATORS:
        raise InvalidParameter(f"unknown operator {op!r}")
    if isinstance(value, bool) != isinstance(kind, T.BooleanType) or isinstance(value, str) and isinstance(kind, NUMERIC) or text and not isinstance(value, str):
        raise TypeMismatch(f"{value!r} can't be compared with {name!r} of type {kind.simpleString()}")
    made = OPERATORS[op](column, F.lit(value))
    if isinstance(kind, (T.FloatType, T.DoubleType)) and op in (">", ">=", "==", "<", "<="):
        made = made & ~F.isnan(column)
    return made


def filter_where(df: DataFrame, name: str, op: str, value: object = None) -> DataFrame:
    return df.where(condition(df, name, op, value))


def filter_expr(df: DataFrame, predicate: Column | str) -> DataFrame:
    return df.where(predicate)
