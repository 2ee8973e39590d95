import datetime
import json

import pytest
from pyspark.sql import functions as F

from brightloom.errors import InvalidParameter
from brightloom.sources import databases, files
from brightloom.streaming import streams


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("Bob, the \"Great\"", 3, 1.5, True), ("Ann", None, None, False)], "name string, age long, rate double, active boolean")
    files.write_csv(df, str(tmp_path / "c"))
    back = files.read_csv(spark, str(tmp_path / "c"))
    assert dict(back.dtypes) == {"name": "string", "age": "bigint", "rate": "double", "active": "boolean"}
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_csv_options(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('age,age,age,\n25,30,35\n1,"a\nb",N/A,2024-01-05\n')
    df = files.read_csv(spark, str(path))
    assert df.columns == ["age", "age_1", "age_2", "col_3"]
    rows = df.collect()
    assert rows[0]["col_3"] is None and rows[1]["col_3"] == datetime.date(2024, 1, 5) and rows[1]["age_1"] == "a\nb" and rows[1]["age_2"] is None
    path.write_text("1;x\n0;y\n")
    plain = files.read_csv(spark, str(path), delimiter=";", header=False, kinds={"col0": "bigint"})
    assert plain.columns == ["col0", "col1"] and plain.first()[0] == 1
    assert dict(files.read_csv(spark, str(path), delimiter=";", header=False).dtypes)["col0"] == "boolean"


def test_json_and_arrow(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1, "b": {"c": 2}}, {"a": 2, "d": "x"}]))
    rows = files.read_json(spark, str(tmp_path / "a.json"))
    assert set(rows.columns) == {"a", "b", "d"} and rows.where("a = 1").first().b == '{"c":2}'
    df = spark.createDataFrame([(1, "x"), (None, None)], "k long, s string")
    files.write_feather(df, str(tmp_path / "f.arrow"))
    assert sorted(map(str, files.read_feather(spark, str(tmp_path / "f.arrow")).collect())) == sorted(map(str, df.collect()))
    assert files.from_arrow(spark, files.to_arrow(df)).count() == 2 and len(files.feather_bytes(df)) > 100


def test_sqlite(spark, tmp_path):
    url = f"sqlite:{tmp_path}/t.db"
    df = spark.createDataFrame([(1, "Alice", 95.5), (2, "Bob", float("nan"))], "id long, name string, score double")
    databases.write_sql(df, "users", url)
    databases.write_sql(df, "users", url)
    assert databases.read_sql(spark, "select * from users", url).count() == 4
    databases.write_sql(df, "users", url, "replace")
    back = databases.read_sql(spark, "select * from users order by id", url)
    assert dict(back.dtypes) == {"id": "bigint", "name": "string", "score": "double"} and back.collect()[1].score is None
    with pytest.raises(InvalidParameter):
        databases.write_sql(df, "users", url, "failIfExists")


def test_jdbc_options():
    made = databases.jdbc_options("postgres://u:p@host/db?sslmode=require")
    assert made["url"] == "jdbc:postgresql://host:5432/db" and made["sslmode"] == "require" and made["user"] == "u"


def test_streams(spark, tmp_path):
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).select("id", (F.col("id") % 2).alias("g")).coalesce(1).write.mode("append").option("header", True).csv(str(tmp_path / "in"))
    sizes = []
    stream = streams.stream_csv(spark, str(tmp_path / "in"), "id long, g long")
    streams.each_chunk(stream, lambda df, _: sizes.append(df.count()), str(tmp_path / "cp")).awaitTermination()
    assert sizes == [10, 10, 10]
    total = streams.run_to_table(streams.group_stream(stream.where("id >= 10"), ["g"], n=F.count(F.lit(1))), "totals")
    assert sorted((r.g, r.n) for r in total.collect()) == [(0, 10), (1, 10)]


def test_entry(spark):
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert entry.entry(spark).count() > 0
