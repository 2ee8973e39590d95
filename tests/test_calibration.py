"""Isotonic blocks and calibration over ranges against one pass."""

import random

import numpy as np
import pytest

from brightloom.operators import calibration


def brute(points):
    blocks = []
    for x, y, n in points:
        own = [x, x, y * n, n]
        while blocks and blocks[-1][2] / blocks[-1][3] >= own[2] / own[3]:
            last = blocks.pop()
            own = [last[0], x, last[2] + own[2], last[3] + own[3]]
        blocks.append(own)
    return [(low, upto, s / n, n) for low, upto, s, n in blocks]


def shapes(rng, kind):
    n = 600
    for i in range(n):
        x = rng.randint(0, 150) if kind == "ties" else i + rng.random()
        y = {"noise": rng.randint(0, 1), "rising": i * 1.0, "falling": float(-i), "ties": x + rng.gauss(0, 60), "valley": float(abs(i - 400)), "saw": float(i % 97)}[kind]
        yield float(x), float(y)


@pytest.mark.parametrize("kind", ["noise", "rising", "falling", "ties", "valley", "saw"])
def test_blocks_over_ranges(spark, monkeypatch, kind):
    rng = random.Random(kind)
    monkeypatch.setattr(calibration, "EDGE", 2)
    monkeypatch.setattr(calibration, "FETCH", 3)
    rows = list(shapes(rng, kind))
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (None, 1.0), (5.0, None)], "s double, y double").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        blocks = calibration.isotonic_blocks(df, "s", "y")
        sums = {}
        for x, y in rows:
            t = sums.setdefault(x, [0.0, 0])
            t[0], t[1] = t[0] + y, t[1] + 1
        want = brute([(x, t / n, n) for x, (t, n) in sorted(sums.items())])
        got = sorted(map(tuple, blocks.collect()))
        assert len(got) == len(want) and [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2:] for g in got], [w[2:] for w in want])
        asked = [rng.uniform(-20, 650) for _ in range(300)] + [w[1] for w in want[:5]]
        frame = spark.createDataFrame([(i, x) for i, x in enumerate(asked)] + [(-1, None)], "range int, s double").repartition(2)
        found = {r.range: r.calibrated for r in calibration.calibrate_by(frame, "s", blocks).collect()}
        assert found.pop(-1) is None and len(found) == len(asked)
        assert np.allclose([found[i] for i in range(len(asked))], np.interp(asked, [w[1] for w in want], [w[2] for w in want]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")


def test_no_rows(spark):
    none = spark.createDataFrame([], "s double, y double")
    assert calibration.isotonic_blocks(none, "s", "y").count() == 0
    frame = spark.createDataFrame([(1.0,)], "s double")
    assert calibration.calibrate_by(frame, "s", calibration.isotonic_blocks(none, "s", "y")).first().calibrated is None
