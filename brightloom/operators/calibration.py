"""Isotonic curves of any number of scores.

Scores are totalled and dealt by ranges; each range pools adjacent violators into
blocks of rising means. Between ranges only the blocks at their ends can still
violate: ranges are joined one after the other, where the last block so far and
the next range's first one pool for as long as they must, taking further blocks
off either side. The driver sees ``EDGE`` blocks of each end of a range, and more
of a range only where pooling runs through these; all other blocks stay where
they are. Calibration sends scores and curve to the same ranges; a few
numbers for each range give it the curve's last point before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import settle
from .frame import need, over_rows

EDGE, FETCH = 64, 4096
BLOCK = "range int, at int, low double, upto double, total double, weight double"


class _Stack:
    """Blocks in order: stretches (range, first, end) of ranges' own blocks, and
    pooled ones (low, upto, total, weight)."""

    def __init__(self, local: DataFrame, sizes: dict[int, int]):
        self.local, self.sizes, self.parts = local, sizes, []
        size = F.create_map(*[F.lit(int(v)) for kv in sizes.items() for v in kv])
        ends = local.where((F.col("at") < EDGE) | (F.col("at") >= F.element_at(size, F.col("range")) - EDGE))
        self.known = {(r["range"], r["at"]): (r["low"], r["upto"], r["total"], r["weight"]) for r in ends.collect()}

    def block(self, number: int, at: int, ahead: bool) -> tuple:
        if (number, at) not in self.known:
            low, high = (at, at + FETCH) if ahead else (at - FETCH + 1, at + 1)
            some = self.local.where((F.col("range") == number) & (F.col("at") >= low) & (F.col("at") < high))
            self.known |= {(r["range"], r["at"]): (r["low"], r["upto"], r["total"], r["weight"]) for r in some.collect()}
        return self.known[(number, at)]

    def top(self) -> tuple:
        last = self.parts[-1]
        return last if len(last) == 4 else self.block(last[0], last[2] - 1, False)

    def pop(self) -> None:
        last = self.parts.pop()
        if len(last) == 3 and last[2] - 1 > last[1]:
            self.parts.append((last[0], last[1], last[2] - 1))

    def add(self, number: int) -> None:
        size, at = self.sizes[number], 1
        mean = lambda b: b[2] / b[3]
        own = first = self.block(number, 0, True)
        while True:
            if self.parts and mean(self.top()) >= mean(own):
                low = self.top()
                self.pop()
                own = (low[0], own[1], low[2] + own[2], low[3] + own[3])
            elif at < size and mean(own) >= mean(high := self.block(number, at, True)):
                own, at = (own[0], high[1], own[2] + high[2], own[3] + high[3]), at + 1
            else:
                break
        if own is first:
            self.parts.append((number, 0, size))
            return
        self.parts.append(own)
        if at < size:
            self.parts.append((number, at, size))


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks: list[list[float]] = []
    number = 0
    for batch in batches:
        x, total, weight, numbers = (c.to_numpy() for c in batch.columns)
        for s, t, w in zip(x.tolist(), total.tolist(), weight.tolist(), strict=True):
            own = [s, s, t, w]
            while blocks and blocks[-1][2] * own[3] >= own[2] * blocks[-1][3]:
                last = blocks.pop()
                own = [last[0], s, last[2] + own[2], last[3] + own[3]]
            blocks.append(own)
        number = int(numbers[0]) if len(numbers) else number
    for at in range(0, len(blocks), 10_000):
        some = blocks[at : at + 10_000]
        columns = list(zip(*some, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), number), pa.int32()), pa.array(np.arange(at, at + len(some)), pa.int32()), *[pa.array(c, pa.float64()) for c in columns]], names=["range", "at", "low", "upto", "total", "weight"])


def isotonic_blocks(df: DataFrame, score: str, target: str) -> DataFrame:
    """(low, upto, mean, weight): blocks of scores with rising means of the target.
    Rows without a score or a target take no part."""
    need(df, score, target)
    x, y = F.col(score).cast("double").alias("x"), F.col(target).cast("double").alias("y")
    totals = df.select(x, y).where("x is not null and not isnan(x) and y is not null").groupBy("x").agg(F.sum("y").alias("total"), F.count(F.lit(1)).cast("double").alias("weight"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = totals.repartitionByRange(n, "x").sortWithinPartitions("x").withColumn("range", F.spark_partition_id())
    local = settle(dealt.mapInArrow(_pooled, BLOCK))
    sizes = {r["range"]: r["n"] for r in local.groupBy("range").agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect()}
    schema = "low double, upto double, mean double, weight double"
    if not sizes:
        return df.sparkSession.createDataFrame([], schema)
    stack = _Stack(local, sizes)
    for number in sizes:
        stack.add(number)
    stay = F.broadcast(df.sparkSession.createDataFrame([p for p in stack.parts if len(p) == 3], "range int, first int, end int"))  # two for each range at most
    kept = local.join(stay, "range").where("at >= first and at < end").select("low", "upto", (F.col("total") / F.col("weight")).alias("mean"), "weight")
    pooled = [(low, upto, total / weight, weight) for low, upto, total, weight in (p for p in stack.parts if len(p) == 4)]
    return kept.unionByName(df.sparkSession.createDataFrame(pooled, schema))


def calibrate_by(df: DataFrame, score: str, blocks: DataFrame, name: str = "calibrated") -> DataFrame:
    """``df`` with the curve's value at each score: linear between the blocks'
    greatest scores, level beyond the first and last; null without a score."""
    points = blocks.select(F.col("upto").alias("t"), F.col("mean").alias("p"))
    points = over_rows(points, "t", (), lambda over, _: {"t2": F.lead("t", 1).over(over), "p2": F.lead("p", 1).over(over)}, 0, 1)
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    kind = T.StructType(df.schema.fields)
    rows = df.select(F.col(f"`{score}`").cast("double").alias("x"), F.lit(1).alias("what"), whole, *[F.lit(None).cast("double").alias(c) for c in ("t", "p", "t2", "p2")])
    curve = points.select(F.col("t").alias("x"), F.lit(0).alias("what"), F.lit(None).cast(kind).alias("row"), "t", "p", "t2", "p2")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = rows.unionByName(curve)
    dealt = both.repartitionByRange(n, "x", "what", F.hash("row")).sortWithinPartitions("x", "what").withColumn("range", F.spark_partition_id())
    dealt = settle(dealt)
    lasts = dealt.where("what = 0").groupBy("range").agg(F.max(F.struct("t", "p", "t2", "p2")).alias("m")).orderBy("range").collect()  # a row for each range
    first = points.agg(F.min(F.struct("t", "p")).alias("m")).first()["m"]
    states, state = {}, None
    for r in lasts:
        states[r["range"]] = state
        state = tuple(r["m"])
    known = sorted(states)
    after = {r["range"]: tuple(r["m"]) for r in lasts}

    def start_of(number: int) -> tuple | None:
        if number in states:
            return states[number]
        before = [k for k in known if k < number]
        return after[before[-1]] if before else None

    lowest = first["p"] if first else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point, begun = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if not begun:
                point, begun = start_of(batch.column(7)[0].as_py()), True
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            mine = batch.column(1).to_numpy() == 0
            number = np.cumsum(mine)
            curve = np.array([[np.nan] * 4 if point is None else [np.nan if v is None else v for v in point], *np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float)[mine] for c in (3, 4, 5, 6)]).tolist()])
            t, p, t2, p2 = curve[number].T
            with np.errstate(all="ignore"):
                made = np.where(np.isnan(t2), p, p + (np.clip(x, t, t2) - t) / (t2 - t) * (p2 - p))
            made = np.where(np.isnan(t), np.nan if lowest is None else lowest, made)
            made = np.where(np.isnan(x), np.nan, made)
            point = tuple(None if np.isnan(v) else float(v) for v in curve[-1]) if not np.isnan(curve[-1][0]) else None
            taken = pa.array(np.flatnonzero(~mine))
            yield pa.RecordBatch.from_arrays([batch.column(2).take(taken), pa.array(made[~mine], from_pandas=True)], names=["row", "made"])

    out = dealt.select("x", "what", "row", "t", "p", "t2", "p2", "range").mapInArrow(run, T.StructType([T.StructField("row", kind), T.StructField("made", T.DoubleType())]))
    return out.select(*[F.col("row").getField(c).alias(c) for c in df.columns if c != name], F.col("made").alias(name))
