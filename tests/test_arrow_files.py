"""Arrow files and tensor headers as data sources."""

import json
import struct

import pyarrow as pa
import pyarrow.feather as feather
import pytest
from pyspark.sql import functions as F

from brightloom.sources import files


def test_batches_are_dealt_out_and_columns_pruned(spark, tmp_path):
    table = pa.table({"a": pa.array(range(1000), pa.uint32()), "b": pa.array([None if i % 7 == 0 else f"é{i}" for i in range(1000)]).dictionary_encode(), "c": pa.array([[i, None] for i in range(1000)], pa.large_list(pa.int16()))})
    feather.write_feather(table, str(tmp_path / "t.feather"), chunksize=100)
    df = files.read_feather(spark, str(tmp_path / "t.feather"), split_bytes=1)
    assert df.rdd.getNumPartitions() == 10 and df.dtypes == [("a", "bigint"), ("b", "string"), ("c", "array<smallint>")]
    assert sorted(map(tuple, df.collect())) == [(i, None if i % 7 == 0 else f"é{i}", [i, None]) for i in range(1000)]
    some = files.read_feather(spark, str(tmp_path / "t.feather"), ["c", "a"])
    assert some.columns == ["c", "a"] and some.agg(F.sum("a")).first()[0] == 499500 and some.count() == 1000


def test_round_trip_in_parts(spark, tmp_path):
    path = "file://" + str(tmp_path / "parts")
    df = spark.range(500).select("id", F.expr("timestamp_micros(id * 1000001)").alias("at"), F.expr("if(id % 3 = 0, null, cast(id as decimal(12, 2)))").alias("d"), F.struct("id", F.array("id")).alias("s")).repartition(4)
    files.write_feather(df, path, compression="zstd")
    parts = [p for p in (tmp_path / "parts").iterdir()]
    assert len(parts) == 4 and all(p.suffix == ".arrow" for p in parts)
    assert sorted(map(repr, files.read_feather(spark, path).collect())) == sorted(map(repr, df.collect()))
    files.write_feather(df.limit(3), path, mode="append")
    assert files.read_feather(spark, path).count() == 503
    files.write_feather(df.limit(0), path)
    none = files.read_feather(spark, path)
    assert none.count() == 0 and none.columns == df.columns


def test_failed_writes_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "parts")
    files.write_feather(spark.range(10), path)
    broken = spark.range(100).repartition(3).select(F.expr("if(id = 77, raise_error('stop'), id)").cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        files.write_feather(broken, path)
    assert files.read_feather(spark, path).count() == 10 and not list((tmp_path / "parts").glob("_staging*"))
    with pytest.raises(Exception, match="missing"):
        files.read_feather(spark, str(tmp_path / "missing")).count()


def text(s):
    return struct.pack("<Q", len(s.encode())) + s.encode()


def test_gguf_headers(spark, tmp_path):
    values = {"general.name": (8, text("tiny")), "block.count": (4, struct.pack("<I", 2)), "neg": (11, struct.pack("<q", -5)), "eps": (6, struct.pack("<f", 0.5)), "yes": (7, b"\x01"), "words": (9, struct.pack("<IQ", 8, 2) + text("a") + text("é"))}
    head = b"GGUF" + struct.pack("<IQQ", 3, 2, len(values)) + b"".join(text(k) + struct.pack("<I", t) + v for k, (t, v) in values.items())
    head += text("w") + struct.pack("<IQQIQ", 2, 4, 8, 0, 0) + text("q") + struct.pack("<IQIQ", 1, 32, 2, 128)
    (tmp_path / "m.gguf").write_bytes(head + bytes(200))
    got = [tuple(r)[1:] for r in files.tensor_headers(spark, str(tmp_path / "m.gguf")).orderBy("start").collect()]
    assert got == [("w", "F32", [4, 8], 0, None), ("q", "GGML_2", [32], 128, None)]
    keys = {r.key: r.value for r in files.tensor_headers(spark, [str(tmp_path / "m.gguf")], "metadata").collect()}
    assert keys == {"general.name": "tiny", "block.count": "2", "neg": "-5", "eps": "0.5", "yes": "true", "words": json.dumps(["a", "é"])}
    (tmp_path / "bad.gguf").write_bytes(head[:60])
    with pytest.raises(Exception, match="ends early"):
        files.tensor_headers(spark, str(tmp_path / "bad.gguf")).collect()
