"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = "\t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: A broadcast side has at most so many rows and bytes, both measured.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20
SALTS = 8
#: Keys of at least this part of all rows are heavy; so there are no more.
HEAVY = 4096

_own: dict[str, str] = {}
#: What is written inside of each open ``scratch``.
_scratch: list[list[DataFrame]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset
    and all threads are this machine's, as in tests, a temporary folder takes
    its place.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = _own.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="brightloom-")
        _own[spark.sparkContext.applicationId] = path
    return path.rstrip("/")


def packed(df: DataFrame, *needed: str) -> tuple[DataFrame, list[str]]:
    """The needed columns, and the others in one struct ``__rest``, so that no
    name of theirs can clash; and the fields to select to get them back."""
    rest = [c for c in df.columns if c not in needed]
    made = df.select(*[F.col(f"`{c}`") for c in needed], *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__rest")] if rest else []))
    return made, [F.col("__rest").getField(c).alias(c) for c in rest]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: this cuts the
    lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brightloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._written = path
    for written in _scratch:
        written.append(made)
    return made


@contextmanager
def scratch(kept: list[DataFrame]) -> Iterator[None]:
    """What ``materialize`` writes inside is deleted at the end, but for what is
    in ``kept`` by then: for work that has been written itself."""
    _scratch.append([])
    try:
        yield
    finally:
        stay = {getattr(df, "_written", None) for df in kept}
        discard(*[df for df in _scratch.pop() if df._written not in stay])


def discard(*written: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    for df in written:
        if path := getattr(df, "_written", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes."""
    size = F.lit(8 * len(df.columns)).cast("long")
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            size = size + F.octet_length(F.to_json(F.struct(F.col(f"`{name}`"))))
    return size


def first_by_hash(rows: DataFrame, n: int, key: str, *ties: str) -> DataFrame:
    """The ``n`` rows of the smallest 64-bit hash in column ``key``. Each task of a
    top-n sends its ``n`` first rows; so where rows are many more, those
    above a bound that follows from their number are left out before, if enough
    rows are below it: the same rows come out."""
    total = rows.count()
    share = (1.5 * n + 1000) / max(total, 1)
    if share < 0.5:
        few = rows.where(F.col(key) < F.lit(int(-(2**63) + 2**64 * share)))
        if few.limit(n).count() == n:
            rows = few
    return rows.orderBy(key, *ties).limit(n)


def small_or_plain(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint if it has at most ``rows`` rows of ``size``
    bytes in all (both are measured, never assumed), else as it is; and whether
    it was small."""
    got = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("b")).first()
    small = got["n"] <= rows and got["b"] <= size
    return (F.broadcast(df) if small else df), small


def join_salted(left: DataFrame, right: DataFrame, on: list[str], by: str, how: str = "inner", small: bool | None = None) -> DataFrame:
    """A join of ``left`` with a small number of columns whose keys may hold
    very many rows of ``left``: each key's rows are dealt out over ``SALTS``
    tasks by the column ``by``. Broadcast instead if ``right`` is small, which
    is measured unless known."""
    if small is None:
        small = small_or_plain(right)[1]
    if small:
        return left.join(F.broadcast(right), on, how)
    left = left.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def join_heavy(left: DataFrame, right: DataFrame, on: list[str], copies: str) -> DataFrame:
    """Inner join with the one row of ``right`` for each key, whose column
    ``copies`` says how many rows of ``left`` have it. Keys that hold a part of
    1 in ``HEAVY`` of all rows or more are at most ``HEAVY``, so these are
    broadcast; the others are joined by a shuffle."""
    total = right.agg(F.coalesce(F.sum(copies), F.lit(0)).alias("n")).first()["n"]
    heavy = F.col(copies) * HEAVY >= F.lit(max(total, 1))
    most, _ = small_or_plain(right.where(heavy), HEAVY)
    rest = left.join(most.select(*on), on, "left_anti").join(right.where(~heavy), on)
    return left.join(most, on).unionByName(rest)


def words(text) -> object:
    """Array of the words of a text; empty for null."""
    flat = F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, " " * len(ASCII_SPACE))
    return F.array_remove(F.split(flat, " "), "")


def n_words(text) -> object:
    """How many words a text has: the blanks that something else follows, one put
    before the text. No array of words is built, only texts with other blanks."""
    flat = F.concat(F.lit(" "), F.coalesce(text, F.lit("")))
    for blank in ASCII_SPACE:
        flat = F.replace(flat, F.lit(blank), F.lit(" "))
    # tabs and line feeds are free now: a pair for each blank shows neighbours
    shown = F.replace(flat, F.lit(" "), F.lit("\t\n"))
    blanks = F.octet_length(shown) - F.octet_length(flat)
    neighbours = (F.octet_length(shown) - F.octet_length(F.replace(shown, F.lit("\n\t"), F.lit("")))) / 2
    return (blanks - neighbours - F.endswith(flat, F.lit(" ")).cast("int")).cast("long")
