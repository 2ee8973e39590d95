"""A one-line command language over DataFrames; ``|`` chains commands.

    filter price >= 10 | groupby city mean price | head 5
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ParseError
from ..operators import frame, predicates, relational

Step = Callable[[DataFrame], DataFrame]


def _value(text: str) -> object:
    try:
        return float(text)
    except ValueError:
        return text.strip().strip("'\"")


def _count(rest: str, default: int = 5) -> int:
    m = re.fullmatch(r"(?:n\s*=\s*)?(\d+)?", rest)
    if not m:
        raise ParseError(f"a number was expected, not {rest!r}")
    return int(m[1] or default)


def _names(rest: str) -> list[str]:
    return [x.strip() for x in rest.split(",") if x.strip()]


def _filter(rest: str) -> Step:
    if m := re.fullmatch(r"(\S+)\s+(isnotnull|isnull)", rest, re.I):
        return lambda df: predicates.filter_where(df, m[1], m[2])
    m = re.fullmatch(r"(.+?)\s*(>=|<=|==|!=|=|>|<)\s*(.+)", rest)
    if not m:
        raise ParseError(f"no condition: {rest!r}")
    return lambda df: predicates.filter_where(df, m[1].strip(), m[2], _value(m[3]))


def _rename(rest: str) -> Step:
    m = re.fullmatch(r"(\S+)\s+to\s+(\S+)", rest, re.I)
    if not m:
        raise ParseError("rename a to b")
    return lambda df: frame.rename(df, m[1], m[2])


def _fill(rest: str) -> Step:
    parts = rest.split(None, 1)
    if len(parts) != 2:
        raise ParseError("fillnulls column value")
    return lambda df: frame.fill_null(df, parts[0], _value(parts[1]))


def _group(rest: str) -> Step:
    parts = rest.split()
    if len(parts) not in (2, 3):
        raise ParseError("groupby key aggregation [target]")
    key, how = parts[0], parts[1].lower()
    if len(parts) == 2 and how in ("first", "last"):
        raise ParseError(f"{how} needs a target")

    def run(df: DataFrame) -> DataFrame:
        grouped = relational.group_by(df, key)
        if len(parts) == 3:
            return grouped.agg({parts[2]: how}, order_by=parts[2] if how in ("first", "last") else None)
        return getattr(grouped, how)()

    if how not in relational.AGGREGATIONS:
        raise ParseError(f"unknown aggregation {how!r}")
    return run


VERBS: dict[str, Callable[[str], Step]] = {
    "filter": _filter,
    "sample": lambda rest: lambda df, n=_count(rest): frame.sample_n(df, n, df.columns),
    "select": lambda rest: lambda df: frame.select(df, *_names(rest)),
    "head": lambda rest: lambda df, n=_count(rest): frame.head(df, n),
    "tail": lambda rest: lambda df, n=_count(rest): frame.tail(df, n, df.columns),
    "rename": _rename,
    "dropnulls": lambda rest: lambda df: frame.drop_nulls(df, *_names(rest)),
    "fillnulls": _fill,
    "groupby": _group,
}


def parse(command: str) -> list[Step]:
    steps = []
    for part in command.split("|"):
        words = part.strip().split(None, 1)
        if not words or words[0].lower() not in VERBS:
            raise ParseError(f"can't parse {part.strip()!r}")
        steps.append(VERBS[words[0].lower()](words[1].strip() if len(words) > 1 else ""))
    return steps


def evaluate(df: DataFrame, command: str) -> DataFrame:
    for step in parse(command):
        df = step(df)
    return df


def summary(df: DataFrame) -> str:
    """A profile in Markdown: one aggregation over all columns."""
    numeric = frame.numeric_columns(df)
    row = df.agg(F.count(F.lit(1)).alias("~n"), *[F.count_if(F.col(c).isNull()).alias(f"{c}~null") for c in df.columns], *[f(F.col(c)).alias(f"{c}~{k}") for c in numeric for k, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]).first()
    lines = [f"# {row['~n']} rows, {len(df.columns)} columns", "", "| column | type | nulls | mean | min | max |", "|---|---|---|---|---|---|"]
    for name, kind in df.dtypes:
        stats = [row[f"{name}~{k}"] if name in numeric else "" for k in ("mean", "min", "max")]
        lines.append(f"| {name} | {kind} | {row[f'{name}~null']} | " + " | ".join(f"{s:.4g}" if isinstance(s, float) else str(s) for s in stats) + " |")
    return "\n".join(lines)
