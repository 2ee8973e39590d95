"""Exact quantiles of any number of values, by distributed selection.

Groups (or columns) of at most ``LIMIT`` different values, by a sketch that
counts them, are Spark's own exact percentile: its buffer holds the different
values. For the others the ranks that the quantiles need are narrowed down, all
groups, columns and ranks in the same passes:

1. Each open rank has an interval of values that holds it, at first all of them.
   A bounded quantile sketch of each different interval proposes cuts on both
   sides of the rank.
2. Exact counts of the values below and at each cut: a cut that the rank falls on
   is the answer; otherwise the interval shrinks to that between two cuts.
   The sketch only steers: whatever it proposes, counts decide.
3. Intervals of at most ``LIMIT`` values are gathered, sorted, and answer.

A pass leaves about one part in ``GRID`` / 3 of an interval, so three of them
take 10^12 values below the limit. Only counts, sketches and those last values
move; no task or buffer holds more than ``LIMIT`` values.

Nulls don't count; NaN is the largest value; interpolation between neighbours is
linear; groups without values have null; null keys are a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import held
from ..errors import InvalidParameter

#: Values of a group, or of an interval, that one buffer may hold.
LIMIT = 1 << 17
#: Evenly spaced proposals of a sketch; a few next to the rank become cuts.
GRID = 256
#: A table of ranks of so many rows at most is kept by the driver.
FEW = 1000


def _held(df: DataFrame) -> DataFrame:
    return held(df, FEW)


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    on = F.lit(True)
    for c in names:
        on = on & left[c].eqNullSafe(right[f"r_{c}"])
    return on


def _apart(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(f"r_{c}") for c in df.columns])


def _inside(rows: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows (keys, x) within each open interval (keys, lo, hi, ...)."""
    spans = _apart(spans)
    over = F.col("r_lo").isNull() | (F.col("x") > F.col("r_lo"))
    under = F.col("r_hi").isNull() | (F.col("x") < F.col("r_hi"))
    return rows.join(spans, _same(rows, spans, keys) & over & under)


def _narrowed(rows: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``state`` (keys, rank, lo, hi, below, inside, answer) after one round over
    the intervals that are too large to gather."""
    large = state.where(F.col("answer").isNull() & (F.col("inside") > LIMIT))
    span = [*keys, "lo", "hi"]
    r_span = [f"r_{c}" for c in span]
    grid = [k / GRID for k in range(GRID + 1)]
    sketch = F.percentile_approx("x", F.array(*[F.lit(g) for g in grid]), F.lit(10 * GRID))
    proposed = _inside(rows, large.select(*span).distinct(), keys).groupBy(*r_span).agg(sketch.alias("grid"))
    # of each rank, the proposals around its place in the interval
    at = F.floor((F.col("rank") - F.col("below") + 0.5) / F.col("inside") * GRID).cast("int")
    near = F.array(*[F.get("grid", F.least(F.lit(GRID), F.greatest(F.lit(0), at + k))) for k in (-1, 0, 1, 2)])
    cuts = large.join(proposed, _same(large, proposed, span)).select(*span, F.explode(near).alias("cut"))
    cuts = cuts.groupBy(*span).agg(F.array_sort(F.collect_set("cut")).alias("cuts"))
    cuts = _held(cuts)
    # place 2j is between cuts j - 1 and j, place 2j + 1 is cut j
    place = 2 * F.size(F.filter("r_cuts", lambda c: c < F.col("x"))) + F.array_contains("r_cuts", F.col("x")).cast("int")
    counted = _inside(rows, cuts, keys).groupBy(*r_span, "r_cuts", place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    counted = counted.groupBy(*r_span, "r_cuts").agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("n"))
    counted = _held(counted)
    joined = state.join(counted, _same(state, counted, span), "left").select(*state.columns, "r_cuts", "n")
    return joined.mapInArrow(_shrunk, state.schema)


def _shrunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``state`` with the counts at the cuts of their interval, if any."""
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            cuts, counts, at = r.pop("r_cuts"), dict(r.pop("n") or ()), r["rank"] - r["below"]
            upto, start, end = 0, 0, r["inside"]
            for j, cut in enumerate(cuts or ()):
                less = upto + counts.get(2 * j, 0)
                upto = less + counts.get(2 * j + 1, 0)
                if upto <= at:
                    r["lo"], start = cut, upto
                elif less <= at:
                    r["answer"] = cut if r["answer"] is None else r["answer"]
                if less > at:
                    r["hi"], end = cut, less
                    break
            r["below"], r["inside"] = r["below"] + start, end - start
        yield pa.RecordBatch.from_pylist(rows, pa.schema([batch.schema.field(c) for c in batch.schema.names if c not in ("r_cuts", "n")]))


def _selected(rows: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, rank, answer) for each rank of ``state``."""
    while state.where(F.col("answer").isNull() & (F.col("inside") > LIMIT)).limit(1).count():
        state = _held(_narrowed(rows, state, keys))
    span = [*keys, "lo", "hi"]
    left = state.where(F.col("answer").isNull()).select(*span).distinct()
    values = _inside(rows, left, keys).groupBy(*[f"r_{c}" for c in span]).agg(F.array_sort(F.collect_list("x")).alias("values"))
    joined = state.join(values, _same(state, values, span), "left")
    return joined.select(*keys, "rank", F.coalesce("answer", F.get("values", (F.col("rank") - F.col("below")).cast("int"))).alias("answer"))


def grouped(df: DataFrame, keys: Sequence[str], column: Column | str, quantiles: Sequence[float]) -> DataFrame:
    """A row of ``keys`` and ``values`` (an array, in the order of ``quantiles``)
    for each group."""
    if not all(0 <= q <= 1 for q in quantiles):
        raise InvalidParameter(f"quantiles {list(quantiles)}")
    x = (F.col(column) if isinstance(column, str) else column).cast("double")
    own = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keys, own, strict=True)], x.alias("x"))
    wanted = [float(q) for q in quantiles]
    per = rows.groupBy(*own).agg(F.count("x").alias("n"), F.approx_count_distinct("x").alias("different"))
    large = _held(per.where(F.col("different") > LIMIT).select(*own, "n"))
    at_once = lambda r: r.groupBy(*own).agg(F.percentile("x", F.array(*[F.lit(q) for q in wanted])).alias("values"))
    back = [F.col(k).alias(c) for c, k in zip(keys, own, strict=True)]
    if large.isEmpty():
        return at_once(rows).select(*back, "values")
    apart = _apart(large)
    few = at_once(rows.join(apart, _same(rows, apart, own), "left_anti"))
    many = rows.where("x is not null").join(apart, _same(rows, apart, own), "left_semi")
    # the two ranks next to each quantile
    place = [F.lit(q) * (F.col("n") - 1) for q in wanted]
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in place for f in (F.floor, F.ceil)]))
    none, zero = F.lit(None).cast("double"), F.lit(0).cast("long")
    state = large.select(*own, F.explode(ranks).alias("rank"), none.alias("lo"), none.alias("hi"), zero.alias("below"), F.col("n").alias("inside"), none.alias("answer"))
    found = _selected(many, _held(state), own)
    found = found.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("rank", "answer"))).alias("at"))
    joined = found.join(apart, _same(found, apart, own))
    here = [F.lit(q) * (F.col("r_n") - 1) for q in wanted]
    value = lambda p: F.element_at("at", p.cast("long"))
    mixed = [F.when(F.floor(p) == F.ceil(p), value(F.floor(p))).otherwise((F.ceil(p) - p) * value(F.floor(p)) + (p - F.floor(p)) * value(F.ceil(p))) for p in here]
    return few.unionByName(joined.select(*own, F.array(*mixed).alias("values"))).select(*back, "values")


def of_columns(df: DataFrame, columns: Mapping[str, Column], quantiles: Sequence[float]) -> dict[str, list[float | None]]:
    """The quantiles of each column (a name and an expression)."""
    names = list(columns)
    cells = F.array(*[F.struct(F.lit(k).alias("k"), x.cast("double").alias("x")) for k, x in enumerate(columns.values())])
    rows = df.select(F.explode(cells).alias("cell")).select("cell.k", "cell.x")
    found = {r["k"]: r["values"] for r in grouped(rows, ["k"], "x", quantiles).collect()}  # a row for each column
    return {c: list(found.get(k) or [None] * len(quantiles)) for k, c in enumerate(names)}
