"""Arrow IPC (Feather) files, and headers of tensor files, as Spark data sources.

``brightloom_arrow`` takes schema and number of record batches from a file's
footer, deals batches out (``split_bytes`` of a file together, one batch at
least) and reads only the columns of the schema that is asked for. Its writer
makes a part for each task in a staging folder; commit moves the parts of
successful attempts into place, replaces older ones if told to overwrite, and
abort removes the staging folder.

``brightloom_tensors`` reads headers of safetensors and GGUF files, a partition
for each file: rows of tensors, or with ``part=metadata`` of keys and values.

Paths are files, folders or URIs of whatever file system pyarrow knows; driver
and executors must both reach them. This module is sent to workers by value, so
it imports nothing of the package.
"""

from __future__ import annotations

import json
import struct
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

ARROW, TENSORS = "brightloom_arrow", "brightloom_tensors"
SPLIT_BYTES = 64 << 20
#: The longest header of a safetensors file, by its format.
HEADER_BYTES = 100_000_000
#: Kinds of metadata values in a GGUF file by their number, as in
#: Python's struct (s: string, [: array), and of tensors that aren't quantised.
GGUF_KINDS = "BbHhIif?s[Qqd"
GGUF_TENSORS = {0: "F32", 1: "F16", 24: "I8", 25: "I16", 26: "I32", 27: "I64", 28: "F64", 30: "BF16"}


def register(spark: SparkSession) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(ArrowFiles)
    spark.dataSource.register(TensorHeaders)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1)) if path.startswith("file:/") else (fs.LocalFileSystem(), path)


def listed(paths: list[str]) -> list[str]:
    """The files of all paths, folders without what begins with _ or a dot."""
    out = []
    for path in paths:
        system, at = opened(path)
        info = system.get_file_info(at)
        if info.type == fs.FileType.Directory:
            found = sorted(x.path for x in system.get_file_info(fs.FileSelector(at)) if x.is_file and x.base_name[0] not in "_.")
            out += [path.rstrip("/") + "/" + x.rsplit("/", 1)[-1] for x in found]
        elif info.is_file:
            out.append(path)
        else:
            raise FileNotFoundError(path)
    return out


def paths_of(options: dict) -> list[str]:
    return json.loads(options["paths"]) if "paths" in options else [options["path"]]


def plain(kind: pa.DataType) -> pa.DataType:
    """The type that Spark has for an Arrow type."""
    if pa.types.is_dictionary(kind):
        return plain(kind.value_type)
    if pa.types.is_list(kind) or pa.types.is_large_list(kind) or pa.types.is_fixed_size_list(kind):
        return pa.list_(plain(kind.value_type))
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, plain(f.type)) for f in kind])
    if pa.types.is_timestamp(kind):
        return pa.timestamp("us", kind.tz)
    other = {pa.large_string(): pa.string(), pa.string_view(): pa.string(), pa.large_binary(): pa.binary(), pa.binary_view(): pa.binary(), pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0), pa.float16(): pa.float32(), pa.date64(): pa.date32(), pa.null(): pa.string()}
    return other.get(kind, kind)


@dataclass
class Batches(InputPartition):
    path: str
    first: int
    end: int


class ArrowFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return ARROW

    def schema(self) -> StructType:
        found = listed(paths_of(self.options))
        if not found:
            raise FileNotFoundError(f"no files in {paths_of(self.options)}")
        system, at = opened(found[0])
        with system.open_input_file(at) as f:
            return from_arrow_schema(pa.schema([pa.field(x.name, plain(x.type)) for x in pa.ipc.open_file(f).schema]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrowReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ArrowWriter(schema, overwrite, self.options)


class ArrowReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.wanted, self.files = to_arrow_schema(schema), listed(paths_of(options))
        self.split = int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[Batches]:
        out = []
        for path in self.files:
            system, at = opened(path)
            with system.open_input_file(at) as f:
                size, n = f.size(), pa.ipc.open_file(f).num_record_batches
            parts = max(1, min(n, -(-size // self.split)))
            out += [Batches(path, n * k // parts, n * (k + 1) // parts) for k in range(parts)]
        return out or [Batches("", 0, 0)]

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.end:
            return
        system, at = opened(partition.path)
        with system.open_input_file(at) as f:
            names = pa.ipc.open_file(f).schema.names
            options = pa.ipc.IpcReadOptions(included_fields=[names.index(c) for c in self.wanted.names if c in names])
            source = pa.ipc.open_file(f, options=options)
            for k in range(partition.first, partition.end):
                batch = source.get_batch(k)
                columns = [self._cast(batch.column(x.name), x.type) if x.name in batch.schema.names else pa.nulls(len(batch), x.type) for x in self.wanted]
                yield pa.RecordBatch.from_arrays(columns, schema=self.wanted) if columns else batch

    @staticmethod
    def _cast(column: pa.Array, kind: pa.DataType) -> pa.Array:
        if pa.types.is_dictionary(column.type):
            column = column.dictionary_decode()
        return column if column.type == kind else column.cast(kind, safe=False)


@dataclass
class Part(WriterCommitMessage):
    name: str | None


class ArrowWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, overwrite: bool, options: dict):
        self.schema, self.overwrite, self.path = schema, overwrite, options["path"].rstrip("/")
        self.staging = f"_staging-{uuid.uuid4().hex}"
        self.compression = options.get("compression", "lz4")
        # made once, here: a task that outlives an abort must not make it again
        system, at = opened(f"{self.path}/{self.staging}")
        system.create_dir(at, recursive=True)

    def _file(self, where: str, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> None:
        system, at = opened(f"{self.path}/{where}")
        options = pa.ipc.IpcWriteOptions(compression=None if self.compression == "none" else self.compression)
        with system.open_output_stream(at) as out, pa.ipc.new_file(out, schema, options=options) as made:
            for batch in batches:
                made.write_batch(batch)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        first = next(iterator, None)
        if first is None:
            return Part(None)
        name = f"part-{uuid.uuid4().hex}.arrow"

        def batches() -> Iterator[pa.RecordBatch]:
            yield first
            yield from iterator

        self._file(f"{self.staging}/{name}", first.schema, batches())
        return Part(name)

    def commit(self, messages: list[Part | None]) -> None:
        system, at = opened(self.path)
        system.create_dir(at, recursive=True)
        older = listed([self.path]) if self.overwrite else []
        names = [m.name for m in messages if m and m.name]
        for name in names:
            system.move(f"{at}/{self.staging}/{name}", f"{at}/{name}")
        if not names and (self.overwrite or not listed([self.path])):
            self._file(f"part-{uuid.uuid4().hex}.arrow", to_arrow_schema(self.schema), iter(()))
        for path in older:
            system.delete_file(opened(path)[1])
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        system, at = opened(self.path)
        if system.get_file_info(f"{at}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/{self.staging}")


# ---- tensor files ----------------------------------------------------------------------


@dataclass
class OneFile(InputPartition):
    path: str


class TensorHeaders(DataSource):
    @classmethod
    def name(cls) -> str:
        return TENSORS

    def schema(self) -> str:
        if self.options.get("part") == "metadata":
            return "path string, format string, key string, value string"
        return "path string, name string, dtype string, shape array<bigint>, start bigint, end bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        return TensorReader(schema, self.options)


class TensorReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.kinds, self.files = to_arrow_schema(schema), listed(paths_of(options))
        self.metadata = options.get("part") == "metadata"

    def partitions(self) -> list[OneFile]:
        return [OneFile(p) for p in self.files] or [OneFile("")]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, at = opened(partition.path)
        with system.open_input_stream(at) as f:
            start = f.read(8)
            kind, read = ("gguf", gguf_header) if start[:4] == b"GGUF" else ("safetensors", safetensors_header)
            metadata, tensors = read(f, start, partition.path)
        rows = [{"key": k, "value": v} for k, v in metadata.items()] if self.metadata else tensors
        yield pa.RecordBatch.from_pylist([{"path": partition.path} | r | ({"format": kind} if self.metadata else {}) for r in rows], schema=self.kinds)


def safetensors_header(f, start: bytes, path: str) -> tuple[dict[str, str], list[dict]]:
    """A little-endian 64-bit length, then that much JSON; offsets are from its end."""
    size = int.from_bytes(start, "little")
    if len(start) < 8 or not 0 < size <= HEADER_BYTES:
        raise ValueError(f"{path}: a header of {size} bytes")
    found = json.loads(f.read(size))
    metadata = found.pop("__metadata__", {})
    return metadata, [{"name": k, "dtype": v["dtype"], "shape": v["shape"], "start": v["data_offsets"][0], "end": v["data_offsets"][1]} for k, v in found.items()]


def gguf_header(f, start: bytes, path: str) -> tuple[dict[str, str], list[dict]]:
    """Counts, keys with typed values, then tensors with offsets into the data;
    version 1 has 32-bit counts."""

    def number(kind: str):
        size = struct.calcsize(f"<{kind}")
        raw = f.read(size)
        if len(raw) < size:
            raise ValueError(f"{path}: the header ends early")
        return struct.unpack(f"<{kind}", raw)[0]

    version = struct.unpack("<I", start[4:8])[0]
    count = "I" if version == 1 else "Q"

    def text() -> str:
        return f.read(number(count)).decode("utf-8", "replace")

    def value(kind: str):
        if kind == "s":
            return text()
        if kind == "[":
            inner = GGUF_KINDS[number("I")]
            return [value(inner) for _ in range(number(count))]
        return number(kind)

    n_tensors, n_keys = number(count), number(count)
    metadata = {}
    for _ in range(n_keys):
        key = text()
        found = value(GGUF_KINDS[number("I")])
        metadata[key] = found if isinstance(found, str) else json.dumps(found)
    tensors = []
    for _ in range(n_tensors):
        name = text()
        shape = [number(count) for _ in range(number("I"))]
        kind = number("I")
        tensors.append({"name": name, "dtype": GGUF_TENSORS.get(kind, f"GGML_{kind}"), "shape": shape, "start": number("Q"), "end": None})
    return metadata, tensors
