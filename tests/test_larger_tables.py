"""Queries and verbs on more rows than the test tables have, and on odd ones."""

import csv

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brightloom.errors import InvalidParameter
from brightloom.functions import statistics as st
from brightloom.functions import text
from brightloom.operators import models
from brightloom.operators import vectors as vec
from brightloom.queries import catalog, exchange
from brightloom.sources import databases, files


def test_scores_round_as_the_sql_does(spark, tmp_path):
    n_chars = [725, 1425, 2825, 2875, 700, 1500, 6000]
    spark.createDataFrame([(i, 1 - i % 2) for i in range(7)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(n_chars)), "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES["roc_curve"](spark, str(tmp_path)).collect()
    assert sorted(r["threshold"] for r in found) == [0.14, 0.28, 0.3, 0.56, 0.57, 1.0]


def test_shapiro_wilk_of_many_rows(spark, tmp_path):
    x = np.round(np.random.default_rng(3).gamma(20, size=6000), 1)
    column = lambda v: spark.createDataFrame([(float(e),) for e in v], "s_acctbal double")
    few = st.shapiro_wilk_column(column(x[:300]), "s_acctbal")
    assert few["statistic"] == pytest.approx(st.shapiro_wilk(x[:300])["statistic"], rel=1e-12)
    assert few["p_value"] == pytest.approx(st.shapiro_wilk(x[:300])["p_value"], rel=1e-9)
    column(x).write.parquet(f"{tmp_path}/supplier.parquet")
    many = catalog.QUERIES["shapiro_wilk"](spark, str(tmp_path)).first()
    assert many["statistic"] == pytest.approx(st.shapiro_wilk(x)["statistic"], rel=1e-12) and many["p_value"] < 1e-6


def test_derby_for_many_processes(spark, tmp_path):
    rows = [(1, 0.1, 'a "b", c'), (2, None, ""), (3, -1e300, None), (4, 5.0, "zwei\nZeilen, é")]
    df = spark.createDataFrame(rows, "k long, x double, s string")
    urls = databases.write_derby(df, "said", f"file://{tmp_path}/shared", part_rows=2)
    assert len(urls) == 2 and all(u.startswith("jdbc:derby:jar:") for u in urls)  # read-only: no process locks it
    found = [r for u in urls for r in databases.read_sql(spark, "SELECT * FROM said", u).collect()]
    assert sorted(map(tuple, found)) == rows
    (url,) = databases.write_derby(df.where("k < 0").coalesce(1), "said", f"file://{tmp_path}/shared")
    assert databases.read_sql(spark, "SELECT * FROM said", url).count() == 0


def test_feather_columns_keeps_the_tables_parts(spark, tmp_path, monkeypatch):
    rows = spark.range(60).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.current_date().alias("l_shipdate"), F.lit("x").alias("l_comment"))
    rows.repartition(9).write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = []
    monkeypatch.setattr(exchange.files, "write_feather", lambda df, path, write=exchange.files.write_feather, **more: (parts.append(df.rdd.getNumPartitions()), write(df, path, **more)))
    spark.conf.set("spark.sql.files.openCostInBytes", 128 << 20)
    try:
        assert catalog.QUERIES["feather_columns"](spark, str(tmp_path)).count() == 60
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert parts == [9]


def test_tiles_are_sent_once_a_block(spark, monkeypatch):
    monkeypatch.setattr(vec, "TILE", 8)
    x = np.random.default_rng(1).normal(size=(160, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    index = vec.PivotIndex(df, "id", "v")
    near = index.partners(100.0, True)

    def seen(state, own, others):
        yield pa.RecordBatch.from_arrays([pa.array([own[0]] * len(others), pa.int64()), pa.array([o[0] for o in others], pa.int64())], names=["tile", "other"])

    met = index.meet(near, seen, "tile long, other long").collect()
    n = len(index.numbers)
    assert n > 2 * index.blocks and len(met) == len(set(met)) == n * n
    assert near.select("tile", "b").distinct().count() == near.select("other_tile", "a").distinct().count() == n * index.blocks


def test_one_csv_file_of_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "COPY_BYTES", 50)
    rows = [(i, f'a "{i}",\nb' if i % 3 else None) for i in range(40)]
    df = spark.createDataFrame(rows, 'id long, `said, "so"` string').repartitionByRange(4, "id")
    files.write_csv(df, f"file://{tmp_path}/one", single=True)
    (path,) = (tmp_path / "one").glob("part-*")
    with path.open(newline="") as f:
        found = list(csv.reader(f))
    assert found[0] == df.columns and found[1:] == [[str(i), s or ""] for i, s in rows]
    assert sorted(map(tuple, files.read_csv(spark, f"file://{tmp_path}/one", kinds={"id": "bigint"}).collect())) == rows
    assert [p.name for p in tmp_path.iterdir()] == ["one"]


def test_trees_are_fitted_to_counted_rows(spark, tmp_path, monkeypatch):
    fitted = []
    monkeypatch.setattr(models.mlr.GBTRegressor, "fit", lambda self, df, fit=models.mlr.GBTRegressor.fit: (fitted.append(df), fit(self, df))[1])
    lines = spark.range(3000).select((F.col("id") % 7).cast("double").alias("l_quantity"), (F.col("id") % 5 / 50).alias("l_discount"), F.lit(0.1).alias("l_tax"))
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(models, "PART_ROWS", 10, raising=False)
    assert catalog.QUERIES["boosted_trees"](spark, str(tmp_path)).first()["r2"] > 0.9
    (rows,) = fitted
    assert rows.count() == 35 and rows.rdd.getNumPartitions() == 4
    assert rows.agg(F.sum("_weight")).first()[0] == 3000
    # few different values: all of them are cuts, so the weighted fit is that of all rows
    df = spark.read.parquet(f"{tmp_path}/lineitem.parquet").withColumn("y", 9 * F.col("l_quantity") + F.pmod(F.xxhash64("l_quantity", "l_discount"), F.lit(997)) / 7)
    for kind in ("gbt_regressor", "decision_tree_regressor"):
        few = models.fit_counted(df, kind, ["l_quantity", "l_discount"], "y").transform(df)
        all_rows = models.estimator(kind, ["l_quantity", "l_discount"], "y").fit(df).transform(df)
        ends = [d.agg(F.sum("prediction"), F.sum(F.col("prediction") * F.col("prediction"))).first() for d in (few, all_rows)]
        assert ends[0] == pytest.approx(ends[1])
    for kind, more in (("random_forest_regressor", {}), ("gbt_regressor", {"subsamplingRate": 0.5})):
        with pytest.raises(InvalidParameter):
            models.fit_counted(df, kind, ["l_quantity"], "y", **more)


@pytest.mark.parametrize("columns", [32, 1])
def test_naive_bayes_tokenises_once(spark, monkeypatch, columns):
    x = np.random.default_rng(5).zipf(1.3, (120, 30)) % 200
    rows = [(i, f"c{i % 3}" if i % 7 else None, [f"t{v + i % 3}" if v % 17 else None for v in r]) for i, r in enumerate(x)] + [(200, "c1", []), (201, "c1", None), (202, None, ["unseen", ""]), (None, "c2", ["t1", "t1"])]
    df = spark.createDataFrame(rows, "id long, lang string, w array<string>").repartition(3)
    want = None
    model = text.naive_bayes(df.where("id % 2 = 0"), "lang", "w")
    monkeypatch.setattr(text, "CLASS_COLUMNS", columns)
    for small in (True, False):
        monkeypatch.setattr(text, "small", lambda d, small=small: small)
        for weighed in (1 << 15, 20, 0):
            monkeypatch.setattr(text, "WEIGHED", weighed)
            seen = spark.sparkContext.accumulator(0)
            own = F.udf(lambda w, seen=seen: (seen.add(1), w)[1], "array<string>").asNondeterministic()
            asked = df.select("id", own("w").alias("w")) if columns > 1 else df
            found = sorted(map(tuple, text.naive_bayes_predict(asked, "id", "w", model, "lang").collect()), key=str)
            want = want or found
            assert found == want and len(found) == len(rows)
            assert columns == 1 or seen.value <= 2 * len(rows)  # the filter on sizes may take one more look
