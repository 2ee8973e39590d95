"""Quantiles by distributed selection against sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from brightloom.errors import InvalidParameter
from brightloom.functions import quantiles
from brightloom.functions import statistics as st

AT = [0.0, 0.013, 0.25, 0.5, 0.77, 1.0]


def sorted_quantile(values, q):
    v = sorted((x for x in values if x is not None), key=lambda x: (math.isnan(x), x))
    if not v:
        return None
    p = q * (len(v) - 1)
    low, high = v[math.floor(p)], v[math.ceil(p)]
    return low if low == high or math.floor(p) == math.ceil(p) else (math.ceil(p) - p) * low + (p - math.floor(p)) * high


def groups(seed):
    rng = random.Random(seed)
    rows = []
    for key, make in {
        "even": lambda: rng.random(),
        "wide": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-200, 200),
        "ties": lambda: float(rng.choice([1, 1, 1, 2, 5, rng.randint(0, 300)])),
        "odd": lambda: rng.choice([float("inf"), float("-inf"), float("nan"), 0.0, -0.0, rng.gauss(0, 1), None]),
        None: lambda: rng.expovariate(1),
        "tiny": lambda: 3.0,
    }.items():
        n = 3 if key == "tiny" else 900
        rows += [(key, make()) for _ in range(n)]
    return rows + [("none", None)] * 4


@pytest.mark.parametrize(("limit", "few"), [(1 << 17, 1000), (20, 1000), (20, 2)])
def test_grouped_quantiles(spark, monkeypatch, limit, few):
    monkeypatch.setattr(quantiles, "LIMIT", limit)
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "GRID", 16)
    rows = groups(limit)
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    gathered = []
    inside = quantiles._inside

    def watched(rows, spans, keys):
        made = inside(rows, spans, keys)
        if spans.columns == [*keys, "lo", "hi"] and limit == 20 and few > 2:
            gathered.append(made.groupBy(*[f"r_{c}" for c in spans.columns]).count().agg(F.max("count")).first()[0] or 0)
        return made

    monkeypatch.setattr(quantiles, "_inside", watched)
    got = {r["g"]: r["values"] for r in quantiles.grouped(df, ["g"], "x", AT).collect()}
    assert set(got) == {k for k, _ in rows}
    for key, values in got.items():
        want = [sorted_quantile([x for k, x in rows if k == key], q) for q in AT]
        for a, b in zip(values or [None] * len(AT), want, strict=True):
            assert a == b or (b is not None and math.isnan(b) and math.isnan(a)) or a == pytest.approx(b, rel=1e-12)
    # sketches take large intervals, only small ones are gathered
    assert not gathered or gathered[-1] <= limit < max(gathered)


def test_quantiles_of_columns(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "LIMIT", 30)
    rng = random.Random(3)
    rows = [(i, rng.gauss(0, 1) if i % 9 else None, None) for i in range(800)]
    df = spark.createDataFrame(rows, "a long, b double, c double")
    got = quantiles.of_columns(df, {"a": F.col("a"), "b": F.col("b"), "c": F.col("c")}, AT)
    assert got["a"] == pytest.approx([sorted_quantile([float(r[0]) for r in rows], q) for q in AT])
    assert got["b"] == pytest.approx([sorted_quantile([r[1] for r in rows], q) for q in AT]) and got["c"] == [None] * 6
    assert quantiles.of_columns(df.limit(0), {"a": F.col("a")}, [0.5]) == {"a": [None]}
    with pytest.raises(InvalidParameter):
        quantiles.of_columns(df, {"a": F.col("a")}, [1.5])
    row = st.describe_column(df, "b").first()
    assert row["median"] == pytest.approx(got["b"][3]) and row["null_count"] == 89
    table = {r.statistic: r.a for r in st.describe(df, ["a"]).collect()}
    assert table["50%"] == 399.5 and table["25%"] == 199.75
