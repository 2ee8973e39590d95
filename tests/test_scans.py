"""Recurrences over ranges against a plain loop."""

import random

import numpy as np
import pytest

from brightloom.errors import EmptyInput
from brightloom.functions import statistics
from brightloom.operators import vectors, windows


def brute(values, alpha):
    out, s = [], None
    for v in values:
        if v is None:
            out.append(None)
            continue
        s = v if s is None else alpha * v + (1 - alpha) * s
        out.append(s)
    return out


@pytest.mark.parametrize(("alpha", "parts", "batch"), [(0.3, 3, 10_000), (0.05, 11, 7), (1.0, 5, 4)])
def test_ewma_over_ranges(spark, alpha, parts, batch):
    rng = random.Random(parts)
    series = {("a", 1): 400, ("a", None): 90, (None, 1): 5, ("b", 2): 1, ("c", 3): 60}
    rows = [(g, h, t, None if rng.random() < (0.9 if g == "c" else 0.3) else rng.gauss(0, 5)) for (g, h), n in series.items() for t in range(n)]
    df = spark.createDataFrame(rows, "g string, h int, t long, x double").repartition(4)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        name = f"`x_ewma_{alpha:.2f}`"
        got = {(r.g, r.h, r.t): r[3] for r in windows.ewma(df, "x", alpha, "t", ["g", "h"]).select("g", "h", "t", name).collect()}
        for key, n in series.items():
            want = brute([x for g, h, _, x in rows if (g, h) == key], alpha)
            assert [got[(*key, t)] for t in range(n)] == [pytest.approx(v) for v in want]
        one = windows.ewma(df.withColumn("k", df.t * 1000 + windows.F.xxhash64("g", "h") % 7), "x", alpha, ["k", "g", "h"])
        order = sorted(one.collect(), key=lambda r: (r.k, r.g is None, r.g or "", r.h is None, r.h or 0))
        assert len(order) == len(rows)
        assert [r[-1] for r in order] == [pytest.approx(v) for v in brute([r.x for r in order], alpha)]
        assert windows.ewma(df.limit(0), "x", alpha, "t").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def brute_cox(t, e, x, rounds=30):
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        g, h = np.zeros(len(beta)), np.zeros((len(beta), len(beta)))
        r = np.exp(x @ beta)
        for i in np.flatnonzero(e):
            at = t >= t[i]
            w = r[at] / r[at].sum()
            mean = w @ x[at]
            g += x[i] - mean
            h += (w[:, None] * x[at]).T @ x[at] - np.outer(mean, mean)
        beta = beta + np.linalg.solve(h, g)
    return beta


@pytest.mark.parametrize(("parts", "batch"), [(3, 10_000), (13, 5)])
def test_hazards_over_ranges_with_ties(spark, parts, batch):
    rng = np.random.default_rng(parts)
    n = 240
    x = rng.normal(size=(n, 2))
    t = np.ceil(rng.exponential(np.exp(-(0.8 * x[:, 0] - 0.5 * x[:, 1])) * 6))
    t[:90] = 4.0  # a third of all rows share a duration
    e = rng.integers(0, 2, n)
    df = spark.createDataFrame([(float(a), int(b), *map(float, c)) for a, b, c in zip(t, e, x, strict=True)] + [(None, 1, 0.0, 0.0)], "t double, e int, a double, b double").repartition(4)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert np.allclose(statistics.cox_ph(df, "t", "e", ["a", "b"]), brute_cox(t, e, x), atol=1e-7)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_decomposition_over_rows(spark):
    rng = np.random.default_rng(3)
    u, v = np.linalg.qr(rng.normal(size=(500, 12)))[0], np.linalg.qr(rng.normal(size=(30, 12)))[0]
    x = (u * 0.5 ** np.arange(12) * 100) @ v.T
    df = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,)], "v array<double>").repartition(37)
    s, rows = vectors.row_svd(df, "v", 5, oversample=4, power=3)
    assert np.allclose(s, np.linalg.svd(x)[1][:5], rtol=1e-8) and np.allclose(np.abs(rows @ v[:, :5]), np.eye(5), atol=1e-6)
    both = [vectors.pca(df.where("v is not null"), "v", 4, widest) for widest in (1024, 10)]
    assert np.allclose(both[0]["variance"], both[1]["variance"], rtol=1e-8) and np.allclose(both[0]["components"], both[1]["components"], atol=1e-6)
    with pytest.raises(EmptyInput):
        vectors.row_svd(df.where("v is null"), "v", 2)
