"""CSV, JSON, Arrow files."""

from __future__ import annotations

import csv
import io
import json
import os
import shutil
import uuid
from collections.abc import Iterator, Mapping, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidParameter
from . import arrow_files, quoted

#: Texts that mean null in a CSV file.
NULL_TOKENS = ("", "NA", "na", "N/A", "n/a", "null", "NULL", "NaN", "nan", "None")
#: Kinds that inference tries, in this order; text is the last resort.
KINDS = ("boolean", "bigint", "double", "date")


def _try(column: str, kind: str):
    text = F.trim(F.col(f"`{column}`"))
    if kind == "boolean":
        low = F.lower(text)
        return F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False)
    if kind == "date":
        return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr(f"try_cast(trim(`{column}`) as date)"))
    return F.expr(f"try_cast(trim(`{column}`) as {kind})")


def header_names(names: Sequence[str]) -> list[str]:
    """Blank headers become ``col_i``, repeated ones get ``_1``, ``_2``."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for i, raw in enumerate(names):
        name = (raw or "").strip() or f"col_{i}"
        k = seen.get(name, 0)
        seen[name] = k + 1
        out.append(name if not k else f"{name}_{k}")
    return out


def infer_kinds(df: DataFrame, booleans_from_digits: bool = True) -> dict[str, str]:
    """The narrowest kind of each text column, over all rows, in one
    aggregation. A column of only nulls is text."""
    made = []
    for c in df.columns:
        made.append(F.count(F.col(f"`{c}`")).alias(f"{c}~n"))
        for k in KINDS:
            misfit = F.col(f"`{c}`").isNotNull() & _try(c, k).isNull()
            if k == "boolean" and not booleans_from_digits:
                misfit = misfit | F.trim(F.col(f"`{c}`")).isin("0", "1")
            made.append(F.count_if(misfit).alias(f"{c}~{k}"))
    row = df.agg(*made).first()
    return {c: "string" if not row[f"{c}~n"] else next((k for k in KINDS if not row[f"{c}~{k}"]), "string") for c in df.columns}


def read_csv(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    header: bool = True,
    null_values: Sequence[str] = NULL_TOKENS,
    infer: bool = True,
    kinds: Mapping[str, str] | None = None,
    max_rows: int | None = None,
    strict: bool = False,
    booleans_from_digits: bool = True,
    quoted_newlines: bool = True,
) -> DataFrame:
    """RFC 4180 files; every column is read as text, null tokens become null,
    and types come from the whole column or from ``kinds``. Short rows are
    filled with nulls unless ``strict``. Large files are split over many tasks,
    also where records have line breaks within quotes, which takes a pass that
    looks for them, left out without ``quoted_newlines``. (A delimiter of more
    than one character is left to Spark, and a file to one task then.)"""
    reader = spark.read.option("sep", delimiter).option("multiLine", quoted_newlines).option("quote", '"').option("escape", '"').option("mode", "FAILFAST" if strict else "PERMISSIVE")
    first = reader.option("header", False).csv(path)
    n = len(first.columns)
    names = [f"col{i}" for i in range(n)]
    if header:
        head = first.limit(1).collect()
        names = header_names(list(head[0])) if head else names
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    rows = quoted.read(spark, path, n, delimiter, header, strict) if quoted_newlines and n and len(delimiter) == 1 else None
    if rows is None:
        reader = reader.option("multiLine", quoted_newlines and len(delimiter) > 1)
        rows = reader.option("header", header).option("enforceSchema", True).schema(schema).csv(path)
    else:
        rows = rows.toDF(*names)
    if max_rows is not None:
        rows = rows.limit(max_rows)
    return _typed(rows, null_values, infer, kinds, booleans_from_digits)


def parse_csv(
    spark: SparkSession,
    text: str,
    delimiter: str = ",",
    header: bool = True,
    null_values: Sequence[str] = NULL_TOKENS,
    infer: bool = True,
    kinds: Mapping[str, str] | None = None,
    strict: bool = False,
    booleans_from_digits: bool = True,
) -> DataFrame:
    """As ``read_csv``, of a string that the driver holds. Blank lines are
    passed over; ``strict`` raises for rows of another length."""
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r]
    width = len(rows[0]) if rows else 0
    if not width:
        return spark.createDataFrame([], T.StructType([]))
    names = header_names(rows.pop(0)) if header else [f"col{i}" for i in range(width)]
    if strict and any(len(r) != width for r in rows):
        raise InvalidParameter(f"a row has not {width} fields")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    made = spark.createDataFrame([tuple((r + [None] * width)[:width]) for r in rows], schema)
    return _typed(made, null_values, infer, kinds, booleans_from_digits)


def _typed(rows: DataFrame, null_values: Sequence[str], infer: bool, kinds: Mapping[str, str] | None, booleans_from_digits: bool) -> DataFrame:
    names = rows.columns
    rows = rows.select(*[F.when(~F.trim(F.col(f"`{c}`")).isin(*null_values), F.col(f"`{c}`")).alias(c) for c in names])
    kinds = dict(kinds or {})
    if infer:
        rest = [c for c in names if c not in kinds]
        kinds = (infer_kinds(rows.select(*[F.col(f"`{c}`") for c in rest]), booleans_from_digits) if rest else {}) | kinds
    return rows.select(*[F.col(f"`{c}`") if kinds.get(c, "string") == "string" else _try(c, kinds[c]).cast(kinds[c]).alias(c) for c in names])


#: Bytes that one task copies into a single file.
COPY_BYTES = 64 << 20


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """Nulls as empty fields. One file on request only: parts are written side
    by side, and tasks copy ranges of them to their places in it, on a file
    system where a file may be written at any place (``file:``); elsewhere one
    task writes it."""
    local = single and (path.startswith(("file:", "/")))
    where = f"{path.rstrip('/')}-{uuid.uuid4().hex}" if local else path
    # without headers: only the single file's first line is one
    (df.coalesce(1) if single and not local else df).write.mode("overwrite").option("header", not local).option("emptyValue", "").option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(where)
    if local:
        _joined(df, where, path)


def _joined(df: DataFrame, parts: str, path: str) -> None:
    """The one file of ``path``, of the header and the parts in their order."""
    spark, at = df.sparkSession, lambda p: "/" + p.removeprefix("file:").lstrip("/")
    head = spark.createDataFrame([tuple(df.columns)], ", ".join(f"c{i} string" for i in range(len(df.columns)))).coalesce(1)
    head.write.mode("overwrite").option("escape", '"').csv(path)
    target = next(str(p) for p in Path(at(path)).glob("part-*"))
    place, ranges = os.path.getsize(target), []
    for part in sorted(str(p) for p in Path(at(parts)).glob("part-*")):
        size = os.path.getsize(part)
        ranges += [(part, k, min(COPY_BYTES, size - k), place + k) for k in range(0, size, COPY_BYTES)]
        place += size
    for crc in Path(at(path)).glob(".*.crc"):  # of the header alone
        crc.unlink()

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with open(r["part"], "rb") as source, open(target, "r+b") as out:
                    source.seek(r["start"])
                    out.seek(r["place"])
                    left = r["size"]
                    while left:
                        piece = source.read(min(left, 1 << 20))
                        if not piece:
                            raise OSError(f"{r['part']} ends early")
                        out.write(piece)
                        left -= len(piece)
        yield pa.RecordBatch.from_arrays([pa.array([1])], names=["done"])

    if ranges:
        rows = spark.createDataFrame(ranges, "part string, start long, size long, place long")
        rows.repartitionByRange(len(ranges), "place").mapInArrow(copy, "done long").count()
    if os.path.getsize(target) != place:
        raise OSError(f"{target} has not {place} bytes")
    shutil.rmtree(at(parts))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A top-level array of objects: union of keys, nested values as JSON text."""
    rows = spark.read.option("multiLine", True).json(path)
    nested = [f.name for f in rows.schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    return rows.withColumns({c: F.to_json(c) for c in nested}) if nested else rows


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    return spark.createDataFrame(table)


def to_arrow(df: DataFrame) -> pa.Table:
    """The whole frame on the driver: for results, not for corpora."""
    return df.toArrow()


def read_feather(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] = (), split_bytes: int = arrow_files.SPLIT_BYTES) -> DataFrame:
    """Arrow IPC files or folders of them: record batches are dealt out over
    tasks, and only ``columns`` (all, if none is named) are read."""
    arrow_files.register(spark)
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.format(arrow_files.ARROW).option("paths", json.dumps(paths)).option("split_bytes", split_bytes)
    if columns:
        whole = reader.load().schema
        reader = reader.schema(T.StructType([whole[c] for c in columns]))
    return reader.load()


def write_feather(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "lz4") -> None:
    """A folder of Arrow IPC files, one of each task."""
    arrow_files.register(df.sparkSession)
    df.write.format(arrow_files.ARROW).mode(mode).option("compression", compression).save(path)


def feather_bytes(df: DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = df.toArrow()
    with pa.ipc.new_file(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def tensor_headers(spark: SparkSession, paths: str | Sequence[str], part: str = "tensors") -> DataFrame:
    """(path, name, dtype, shape, start, end) of the tensors in
    safetensors and GGUF files, or ``part="metadata"``: (path, format, key,
    value). Only headers are read; offsets are from the start of the data."""
    arrow_files.register(spark)
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format(arrow_files.TENSORS).option("paths", json.dumps(paths)).option("part", part).load()


def read_url(spark: SparkSession, url: str) -> DataFrame:
    """CSV or JSON over HTTP(S), by extension; every executor gets the file."""
    from pyspark import SparkFiles

    if not url.startswith(("http://", "https://")):
        return read_json(spark, url) if url.endswith(".json") else read_csv(spark, url)
    spark.sparkContext.addFile(url)
    local = "file://" + SparkFiles.get(url.rsplit("/", 1)[-1].split("?")[0])
    return read_json(spark, local) if url.split("?")[0].endswith(".json") else read_csv(spark, local)
