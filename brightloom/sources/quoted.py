"""CSV files with line breaks inside quotes, split over many tasks.

Spark's text source deals a file out in byte ranges that end at line feeds.
Whether a range begins inside quotes depends on all quotes before it, so:

1. Each range counts its lines with an odd number of quotes, and reports the
   lines up to the first of them and from the last of them on.
2. A running total of those counts over the ranges of a file tells which ranges
   begin inside quotes: a few numbers for each range.
3. Each range then parses its own records, from the first that begins in it to the
   last that ends in it. What lies across ranges is put together from their
   reported ends: a record begins in the range whose end is open, runs through
   ranges without a quote of that kind, and ends in the next one that has one.
   Ends too long to report, of records of that length, are read in a pass of
   their own.

Quotes within quotes are doubled, so they never change the count's parity; a
single quote inside an unquoted field isn't RFC 4180 and not told apart.
Records end in LF or CRLF; line breaks inside quotes stay as they are. A record
must fit into memory; no other thing needs to.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..checkpoints import held
from ..errors import ParseError

SUMMARY = "path string, start long, n_odd long, tail string, head string, lead boolean"
#: Records that the parser takes together.
AT_ONCE = 4096
#: Ends of a range up to so many bytes are reported in the first pass.
SHORT = 1 << 16
#: Summaries of so many ranges at most are kept by the driver.
FEW = 100


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, start, value): the lines of each byte range, in order."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array, bool]]:
    """Each range's key with its lines, part by part, and whether it is a new one."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        path, start = batch.column(0), batch.column(1)
        change = np.flatnonzero((pc.not_equal(path[1:], path[:-1])).to_numpy(zero_copy_only=False) | (start.to_numpy()[1:] != start.to_numpy()[:-1])) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for s, e in zip(edges, edges[1:], strict=False):
            key = (path[s].as_py(), start[s].as_py())
            yield key, batch.column(2).slice(s, e - s), key != last
            last = key


def _odd(values: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.count_substring(values, '"').to_numpy(zero_copy_only=False) & 1)


class _End:
    """Lines that a range may have to report, as long as they are short."""

    def __init__(self) -> None:
        self.parts: list[pa.Array] | None = []
        self.size = 0

    def add(self, values: pa.Array) -> None:
        if self.parts is not None and len(values):
            self.size += len(values) + (pc.sum(pc.binary_length(values)).as_py() or 0)
            self.parts = [*self.parts, values] if self.size <= SHORT else None

    def text(self) -> str | None:
        return None if self.parts is None else "\n".join(x for v in self.parts for x in v.to_pylist())


class _Range:
    """The ends of a range: ``tail`` are the lines up to the first odd one,
    ``head`` those from the last odd one on; ``lead`` says that only blank lines
    are before ``head``."""

    def __init__(self, key: tuple[str, int]):
        self.key, self.n, self.tail, self.head, self.blank, self.lead = key, 0, _End(), _End(), True, False

    def add(self, values: pa.Array) -> None:
        odd = _odd(values)
        blank = lambda v: all(not x.strip("\r") for x in v.to_pylist())
        if len(odd):
            first, last = int(odd[0]), int(odd[-1])
            if not self.n:
                self.tail.add(values.slice(0, first + 1))
                self.lead = len(odd) == 1 and self.blank and blank(values.slice(0, last))
            else:
                self.lead = False
            self.head = _End()
            self.head.add(values.slice(last))
            self.n += len(odd)
        elif self.n:
            self.head.add(values)
        else:
            self.tail.add(values)
            self.blank = self.blank and blank(values)

    def row(self) -> dict:
        path, start = self.key
        some = self.n > 0
        return {"path": path, "start": start, "n_odd": self.n, "tail": self.tail.text() if some else None, "head": self.head.text() if some else None, "lead": self.lead}


def summaries(rows: DataFrame) -> DataFrame:
    """A row of ``SUMMARY`` for each range; long ends are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Range | None = None
        for key, values, new in _ranges(batches):
            if new:
                if own:
                    yield pa.RecordBatch.from_pylist([own.row()], schema)
                own = _Range(key)
            own.add(values)
        if own:
            yield pa.RecordBatch.from_pylist([own.row()], schema)

    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("n_odd", pa.int64()), ("tail", pa.string()), ("head", pa.string()), ("lead", pa.bool_())])
    return rows.mapInArrow(run, SUMMARY)


def long_ends(rows: DataFrame, wanted: dict[tuple[str, int], set[int]]) -> DataFrame:
    """(path, start, part, text) of ends that were too long to report: part 0 up
    to the first odd line (all lines, if there is none), part 1 from the last on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[tuple[str, int, int], list[str]] = {}
        met: set[tuple[str, int]] = set()
        for key, values, _ in _ranges(batches):
            some = wanted.get(key, ())
            odd = _odd(values) if some else ()
            if 0 in some and key not in met:
                parts.setdefault((*key, 0), []).extend(values.slice(0, int(odd[0]) + 1 if len(odd) else len(values)).to_pylist())
            if len(odd):
                met.add(key)
                if 1 in some:
                    parts[(*key, 1)] = values.slice(int(odd[-1])).to_pylist()
            elif 1 in some and key in met:
                parts[(*key, 1)].extend(values.to_pylist())
        yield pa.RecordBatch.from_pylist([{"path": p, "start": s, "part": k, "text": "\n".join(x)} for (p, s, k), x in parts.items()], kinds)

    kinds = pa.schema([("path", pa.string()), ("start", pa.int64()), ("part", pa.int32()), ("text", pa.string())])
    return rows.mapInArrow(run, "path string, start long, part int, text string")


def _parsed(records: list[str], width: int, delimiter: str, strict: bool) -> pa.RecordBatch:
    csv.field_size_limit(1 << 31)
    made = []
    for row in csv.reader(records, delimiter=delimiter, quoting=csv.QUOTE_NOTNULL, strict=strict):
        if strict and len(row) != width:
            raise ParseError(f"a record has {len(row)} fields, not {width}")
        made.append((row + [None] * width)[:width] if len(row) != width else row)
    columns = list(zip(*made, strict=True)) or [()] * width
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=[f"_{k}" for k in range(width)])


def _own_records(rows: DataFrame, inside: frozenset, width: int, delimiter: str, header: bool, strict: bool, schema) -> DataFrame:
    """The records that begin and end in one range, parsed."""
    shared = rows.sparkSession.sparkContext.broadcast(inside)  # at most one entry for each range

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
        held: list[str] | None = None  # lines of the open record; None if it began before the range
        is_open = skip = False
        for key, values, new in _ranges(batches):
            if new:
                is_open, held, skip = key in shared.value, None, header and key[1] == 0
            odd = set(_odd(values).tolist())
            for k, line in enumerate(values.to_pylist()):
                if not is_open and k not in odd:
                    whole = line
                elif not is_open:
                    is_open, held = True, [line]
                    continue
                else:
                    if held is not None:
                        held.append(line)
                    if k not in odd:
                        continue
                    is_open = False
                    if held is None:
                        continue
                    whole = "\n".join(held)
                whole = whole[:-1] if whole.endswith("\r") else whole
                if whole and skip:
                    skip = False
                elif whole:
                    yield whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[str] = []
        for record in records(batches):
            some.append(record)
            if len(some) == AT_ONCE:
                yield _parsed(some, width, delimiter, strict)
                some = []
        yield _parsed(some, width, delimiter, strict)

    return rows.mapInArrow(run, schema)


def _joined_records(rows: DataFrame, known: DataFrame, width: int, delimiter: str, header: bool, strict: bool, schema) -> DataFrame:
    """The records that lie across ranges, put together and parsed."""
    ends = known.where("inside").select("path", "start", F.lit(0).alias("part"), F.col("tail").alias("text"), F.lit(False).alias("lead"))
    starts = known.where("n_odd > 0 and inside <> (n_odd % 2 = 1)").select("path", "start", F.lit(1).alias("part"), F.col("head").alias("text"), (F.col("lead") & (F.col("start") == 0)).alias("lead"))
    some = ends.unionByName(starts)
    wanted: dict[tuple[str, int], set[int]] = {}
    for r in some.where("text is null").select("path", "start", "part").collect():  # of few ranges, if any
        wanted.setdefault((r["path"], r["start"]), set()).add(r["part"])
    if wanted:
        texts = long_ends(rows, wanted).withColumnRenamed("text", "long")
        some = some.join(texts, ["path", "start", "part"], "left").withColumn("text", F.coalesce("text", "long")).drop("long")
    number = F.sum("part").over(W.partitionBy("path").orderBy("start", "part"))
    some = some.withColumn("record", number).groupBy("path", "record").agg(F.array_sort(F.collect_list(F.struct("start", "part", "text"))).alias("pieces"), F.max("lead").alias("lead"))
    if header:
        some = some.where("not lead")
    text = F.array_join(F.transform("pieces", lambda p: p["text"]), "\n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _parsed([x[:-1] if x.endswith("\r") else x for x in batch.column(0).to_pylist()], width, delimiter, strict)

    return some.select(text.alias("text")).mapInArrow(run, schema)


def read(spark: SparkSession, path: str | list[str], width: int, delimiter: str, header: bool, strict: bool) -> DataFrame | None:
    """Text columns ``_0``, ``_1`` ... of all records; None if no record has a
    line break, so that Spark's reader can split the files itself."""
    rows = lines(spark, path)
    found = held(summaries(rows), FEW)
    if not found.where("n_odd > 0").limit(1).count():
        return None
    before = F.sum("n_odd").over(W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    known = held(found.withColumn("inside", F.coalesce(before, F.lit(0)) % 2 == 1), FEW)
    inside = frozenset((r["path"], r["start"]) for r in known.where("inside").select("path", "start").collect())
    schema = ", ".join(f"_{k} string" for k in range(width))
    own = _own_records(rows, inside, width, delimiter, header, strict, schema)
    return own.unionByName(_joined_records(rows, known, width, delimiter, header, strict, schema))
