import pandas as pd
import pytest
from pyspark.sql import functions as F

from brightloom.errors import ColumnNotFound, DuplicateColumn, InvalidParameter, ParseError, PartialCastFailure, CastFailed, TypeMismatch
from brightloom.operators import frame, predicates, relational, windows
from brightloom.plans import command, lazy


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(25, "Alice"), (30, "Bob"), (35, "Carol"), (40, "Dave"), (None, "Eve")], "age long, name string")


@pytest.fixture(scope="module")
def grouped(spark):
    return spark.createDataFrame([("A", 10, 1.5), ("A", 20, 2.5), ("B", 30, 3.5), ("B", 40, 4.5), ("A", 50, 5.5)], "category string, val1 long, val2 double")


def values(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_projection_checks_names(people):
    assert frame.select(people, "name").columns == ["name"]
    assert frame.rename(people, "age", "years").columns == ["years", "name"]
    with pytest.raises(ColumnNotFound):
        frame.drop(people, "nothing")
    with pytest.raises(DuplicateColumn):
        frame.select(people, "age", "age")
    with pytest.raises(DuplicateColumn):
        frame.rename(people, "age", "name")


def test_filters_ignore_nulls(people):
    assert values(predicates.filter_where(people, "age", ">", 28), "name") == [("Bob",), ("Carol",), ("Dave",)]
    assert predicates.filter_where(people, "age", "!=", 25).count() == 3
    assert values(predicates.filter_where(people, "age", "isNull"), "name") == [("Eve",)]
    assert values(predicates.filter_where(people, "name", "contains", "o"), "name") == [("Bob",), ("Carol",)]
    with pytest.raises(TypeMismatch):
        predicates.filter_where(people, "name", "==", 5)
    with pytest.raises(TypeMismatch):
        predicates.filter_where(people, "age", "contains", "1")


def test_nan_compares_as_ieee(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (9.0,)], "x double")
    assert predicates.filter_where(df, "x", ">", 5.0).count() == 1


def test_filter_reaches_the_scan(spark, people, tmp_path):
    people.write.parquet(str(tmp_path / "p"))
    plan = predicates.filter_where(spark.read.parquet(str(tmp_path / "p")), "age", ">", 28).select("name")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(age,28)" in text and "ReadSchema: struct<age:bigint,name:string>" in text


def test_cast_reports_failures(spark):
    bad = spark.createDataFrame([("10",), ("invalid_number",), ("30",)], "s string")
    with pytest.raises(PartialCastFailure):
        frame.cast_column(bad, "s", "bigint")
    with pytest.raises(CastFailed):
        frame.cast_column(bad.where("s like 'inv%'"), "s", "bigint")
    assert [r[0] for r in frame.cast_column(bad, "s", "bigint", strict=False).collect()] == [10, None, 30]


def test_order_and_positions(people):
    assert [r.name for r in frame.sort_by(people, "age", ascending=False).collect()][-1] == "Eve"
    assert [r.name for r in frame.head(people, 2, "age").collect()] == ["Alice", "Bob"]
    assert [r.name for r in frame.tail(people, 2, "name").collect()] == ["Dave", "Eve"]
    assert frame.row_at(people, 1, "name")["name"] == "Bob"
    assert [r.name for r in frame.gather(people, [3, 0, 3], "name").collect()] == ["Dave", "Alice", "Dave"]
    assert sorted(r.row_id for r in frame.with_row_id(people, "name").collect()) == [0, 1, 2, 3, 4]


def test_samples_are_exact_and_repeatable(spark):
    df = spark.range(100)
    one, two = (sorted(r.id for r in frame.sample_n(df.repartition(n), 10, "id", 3).collect()) for n in (2, 7))
    assert one == two and len(one) == 10
    train, test = frame.train_test_split(df, "id", 0.25)
    assert test.count() == 25 and train.union(test).distinct().count() == 100


def test_joins(spark):
    left = spark.createDataFrame([(1, "Alice"), (2, "Bob"), (3, "Charlie")], "id long, name string")
    right = spark.createDataFrame([(2, 95.0), (3, 88.0), (4, 72.0)], "id long, score double")
    assert {how: relational.join(left, right, "id", how).count() for how in ("inner", "left", "right", "outer", "semi", "anti")} == {"inner": 2, "left": 3, "right": 3, "outer": 4, "semi": 2, "anti": 1}
    clash = relational.join(left, left, "id")
    assert clash.columns == ["id", "name_x", "name_y"]
    with pytest.raises(InvalidParameter):
        relational.join(left, right, "id", "cross")


def test_grouping(grouped):
    g = relational.group_by(grouped, "category")
    assert values(g.count(), "category", "val1") == [("A", 3), ("B", 2)]
    assert values(g.sum(), "category", "val1", "val2") == [("A", 80.0, 9.5), ("B", 70.0, 8.0)]
    assert values(g.agg({"val1": "max", "val2": ["min", "last"]}, order_by="val1"), "category", "val1_max", "val2_min", "val2_last") == [("A", 50.0, 1.5, 5.5), ("B", 40.0, 3.5, 4.5)]
    with pytest.raises(ColumnNotFound):
        relational.group_by(grouped, "nothing")
    with pytest.raises(TypeMismatch):
        g.agg({"category": "sum"})


def test_pivot_and_melt_round_trip(spark):
    weather = spark.createDataFrame([("01-01", "NYC", 32.0), ("01-01", "LA", 65.0), ("01-02", "NYC", 35.0), ("01-02", "LA", 68.0), ("01-03", None, 1.0)], "date string, city string, temp double")
    wide = relational.pivot(weather, "date", "city", "temp")
    assert set(wide.columns) == {"date", "NYC", "LA", "null"}
    back = relational.melt(wide, ["date"], ["NYC", "LA"], "city", "temp").where("temp is not null")
    assert values(back, "date", "city", "temp") == values(weather.where("city is not null"), "date", "city", "temp")


def test_distinct_keeps_first(spark):
    df = spark.createDataFrame([("A", 1), ("B", 2), ("A", 1), ("B", 3), ("C", 1)], "cat string, val long")
    assert frame.distinct_rows(df).count() == 4
    assert values(frame.distinct_rows(df, "val", ["cat"]), "cat", "val") == [("A", 1), ("B", 2), ("C", 1)]


def test_windows(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0), (4, 5.0)], "t long, x double").withColumn("g", F.lit(1))
    assert [r[0] for r in windows.rolling_mean(df, "x", 2, "t").orderBy("t").select("x_rolling_mean_2").collect()] == [1.0, 1.0, 3.0, 4.0]
    assert [r[0] for r in windows.rolling_std(df, "x", 2, "t").orderBy("t").select("x_rolling_std_2").collect()] == [0.0, 0.0, 0.0, pytest.approx(2**0.5)]
    assert [r[0] for r in windows.ewma(df, "x", 0.5, "t", ["g"]).orderBy("t").select("`x_ewma_0.50`").collect()] == [1.0, None, 2.0, 3.5]
    assert [r[0] for r in windows.ewma(df, "x", 1.0, "t", ["g"]).orderBy("t").select("`x_ewma_1.00`").collect()] == [1.0, None, 3.0, 5.0]
    assert windows.lag_features(df, "x", [1, 2], "t").count() == 2
    with pytest.raises(InvalidParameter):
        windows.ewma(df, "x", 0.0, "t", ["g"])


def test_commands(spark):
    df = spark.createDataFrame([("A", 10.0), ("A", 20.0), ("B", 30.0), ("B", None)], "category string, value double")
    assert command.evaluate(df, "filter value >= 20 | head n=5").count() == 2
    assert values(command.evaluate(df, "GROUPBY category mean value"), "category", "value_mean") == [("A", 15.0), ("B", 30.0)]
    assert command.evaluate(df, "fillnulls value 0 | rename value to v").where("v = 0").count() == 1
    assert command.evaluate(df, "dropnulls | select category").count() == 3
    assert "| value | double | 1 |" in command.summary(df)
    for text in ("explode everything", "filter value", "groupby category first", ""):
        with pytest.raises(ParseError):
            command.evaluate(df, text)


def test_lazy_chain(spark):
    df = spark.createDataFrame([("Alice", 75.0, 25), ("Bob", 92.0, 30), ("Charlie", 88.0, 35)], "name string, score double, age int")
    assert [r.name for r in lazy.lazy(df).filter(F.col("score") > 80).filter("age < 32").select("name").collect()] == ["Bob"]


@pytest.mark.parametrize("chunk", [65_536, 5])
def test_one_series_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(frame, "CHUNK", chunk)
    x = pd.Series([float((7 * i) % 11) if i % 6 else None for i in range(40)])
    df = spark.createDataFrame([(i, None if pd.isna(v) else v) for i, v in enumerate(x)], "t long, x double").repartition(3)

    def got(made, name):
        return [r[0] for r in made.orderBy("t").select(f"`{name}`").collect()]

    def same(values, series):
        assert [None if v is None else pytest.approx(v) for v in values] == [None if pd.isna(v) else v for v in series]

    same(got(windows.rolling_mean(df, "x", 4, "t"), "x_rolling_mean_4"), x.rolling(4, min_periods=1).mean())
    same(got(windows.rolling_mean(df, "x", 9, "t"), "x_rolling_mean_9"), x.rolling(9, min_periods=1).mean())
    std = x.rolling(4, min_periods=1).std().mask(x.rolling(4, min_periods=1).count() == 1, 0.0)
    same(got(windows.rolling_std(df, "x", 4, "t"), "x_rolling_std_4"), std)
    same(got(frame.with_lag(df, "x", 3, "y", "t"), "y"), x.shift(3))
    same(got(frame.with_lag(df, "x", -7, "y", "t"), "y"), x.shift(-7))
    same(got(windows.lag_features(df, "x", [1, 3], "t"), "lag_3"), x.shift(3)[3:])
    same(got(windows.full_moving_average(df, "x", 3, "t"), "moving_average"), x.rolling(3, min_periods=1).mean()[2:])
    same(got(windows.expanding(df, "x", "t", min_periods=0), "x_expanding_mean"), x.expanding(1).mean())
    std = x.expanding(1).std().mask(x.expanding(1).count() == 1, 0.0)
    same(got(windows.expanding(df, "x", "t", min_periods=0), "x_expanding_std"), std)
    nulls = x.isna().sum()
    same(got(windows.average_rank(df, "x"), "rank"), (x.rank() + nulls).fillna((nulls + 1) / 2))
    assert frame.row_at(df, 7, "t") == {"t": 7, "x": x[7]} and frame.row_at(df, 40, "t") is None
    for made in (frame.with_lag(df, "x", 1, "y", "t"), windows.rolling_mean(df, "x", 2, "t"), windows.average_rank(df, "x")):
        assert "SinglePartition" not in made._jdf.queryExecution().executedPlan().toString()
