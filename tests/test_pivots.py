"""Neighbours and density clusters through the pivot index, against all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brightloom.operators import vectors as vec


@pytest.fixture
def blobs(spark):
    rng = np.random.default_rng(5)
    centers = rng.uniform(-40, 40, (9, 5))
    x = np.concatenate([c + rng.normal(0, 0.5, (n, 5)) for c, n in zip(centers, (260, 40, 30, 60, 50, 20, 30, 5, 1), strict=True)])
    x = np.concatenate([x, x[:4], rng.uniform(-40, 40, (20, 5))])  # equal rows and stray ones
    order = rng.permutation(len(x))
    x = x[order]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    return df, d


def brute_clusters(d, eps, least):
    near = d <= eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(d)), -1)
    changed = True
    while changed:
        low = np.array([min([label[i], *label[near[i] & core]]) if core[i] else -1 for i in range(len(d))])
        changed, label = (low != label).any(), low
    for i in np.flatnonzero(~core):
        touched = label[near[i] & core]
        label[i] = touched.min() if len(touched) else -1
    names = sorted(set(label[core].tolist()))
    return [names.index(x) if x >= 0 else -1 for x in label.tolist()]


@pytest.mark.parametrize("tile", [2048, 40])
def test_neighbours_and_clusters(blobs, monkeypatch, tile):
    df, d = blobs
    monkeypatch.setattr(vec, "TILE", tile)
    n = len(d)
    got = {}
    for r in vec.neighbours(df, "id", "v", k=6).collect():
        got.setdefault(r[0], []).append((round(r[2], 9), r[1]))
    for i in range(n):
        assert sorted(got[i]) == sorted((round(d[i, j], 9), j) for j in sorted(set(range(n)) - {i}, key=lambda j: (d[i, j], j))[:6])
    pairs = {(r[0], r[1]) for r in vec.neighbours(df, "id", "v", radius=1.1).collect()}
    assert pairs == {(i, j) for i in range(n) for j in range(n) if i != j and d[i, j] <= 1.1}
    for eps, least in ((1.1, 5), (0.6, 3), (3.0, 1)):
        found = {r.id: r.cluster for r in vec.dbscan(df, "id", "v", eps, least).collect()}
        assert [found[i] for i in range(n)] == brute_clusters(d, eps, least)


def test_pairs_of_tiles_are_skipped(blobs, monkeypatch):
    df, d = blobs
    monkeypatch.setattr(vec, "TILE", 40)
    index = vec.PivotIndex(df, "id", "v")
    tiles = index.tiles.collect()
    assert sum(len(t["keys"]) for t in tiles) == len(d) and max(len(t["keys"]) for t in tiles) <= 40
    near = {(r[0], r[1]) for r in index.partners(1.1, True).collect()}
    keys = {t["tile"]: t["keys"] for t in tiles}
    for a, own in keys.items():
        for b, other in keys.items():
            assert (a, b) in near or d[np.ix_(own, other)].min() > 1.1
    assert len(near) < 0.5 * len(tiles) ** 2


def test_null_vectors_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(vec, "TILE", 2)
    df = spark.createDataFrame([(1, [0.0]), (2, None), (3, [0.1]), (None, [0.2]), (4, [9.0]), (5, [0.0])], "id long, v array<double>")
    assert {r.id: r.cluster for r in vec.dbscan(df, "id", "v", 0.15, 2).collect()} == {1: 0, 2: -1, 3: 0, None: 0, 4: -1, 5: 0}
    assert sorted((r.id or -1, r.other or -1) for r in vec.neighbours(df, "id", "v", k=1).collect()) == [(-1, 3), (1, 5), (3, 1), (4, -1), (5, 1)]
    assert vec.dbscan(df.where(F.col("id") > 90), "id", "v").count() == 0


def test_synthetic_rows_lie_between_near_rows(spark, monkeypatch):
    from brightloom.operators import preprocessing as pp

    monkeypatch.setattr(vec, "TILE", 16)
    rng = np.random.default_rng(8)
    many, few = rng.normal(0, 1, (150, 2)), np.concatenate([rng.normal(9, 0.1, (30, 2)), rng.normal(-9, 0.1, (10, 2))])
    rows = [(*map(float, x), "many") for x in many] + [(*map(float, x), "few") for x in few] + [(1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, y string").repartition(3)
    got = pp.smote(df, ["a", "b"], "y", k=4, seed=3).collect()
    made = np.array([(r.a, r.b) for r in got if r.y == "few"])
    assert {y: sum(r.y == y for r in got) for y in ("many", "few", None)} == {"many": 150, "few": 150, None: 150}
    assert {(r.a, r.b) for r in got if r.y is None} == {(1.0, 2.0)}
    d = np.sqrt(((few[:, None] - few[None]) ** 2).sum(2))
    near = [np.argsort(d[i])[1:5] for i in range(len(few))]
    for p in made:
        gaps = [abs(np.linalg.norm(p - few[i]) + np.linalg.norm(few[j] - p) - d[i, j]) for i in range(len(few)) for j in near[i]]
        assert min(gaps) < 1e-9
    assert sorted(map(tuple, pp.smote(df, ["a", "b"], "y", k=4, seed=3).select("a", "b").collect())) == sorted((r.a, r.b) for r in got)


def test_clusters_compare_each_pair_of_tiles_once(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 24))
    near = x[:4, None] + rng.normal(0, 0.02, (4, 7, 24))
    far = x[:4] + 0.25 * rng.normal(size=(4, 24))  # some touch a group from outside
    x = np.concatenate([x, near.reshape(-1, 24), far])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)
    monkeypatch.setattr(vec, "TILE", 32)
    pairs, meet = [], vec._meet

    def counted(held, sent, *more, **named):
        pairs.append(sent.agg(F.sum(F.size("partners"))).first()[0] or 0)
        return meet(held, sent, *more, **named)

    monkeypatch.setattr(vec, "_meet", counted)
    tiles = len(vec.PivotIndex(df, "id", "v").numbers)
    for eps, least in ((1.3, 6), (0.2, 8), (3.0, 3)):
        pairs.clear()
        found = {r.id: r.cluster for r in vec.dbscan(df, "id", "v", eps, least).collect()}
        assert [found[i] for i in range(len(x))] == brute_clusters(d, eps, least)
        assert sum(pairs) <= tiles * (tiles + 1)  # half of them twice; before, half of them five times


@pytest.mark.parametrize("offset, scale", [(0, 1), (300, 1), (1e7, 1), (0, 1e-20), (0, 1e25)])
def test_rows_within_reach_in_either_precision(offset, scale):
    rng = np.random.default_rng(7)
    x = (rng.integers(-3, 4, (400, 3)) + float(offset)) * scale  # many distances are the limit itself
    keys = [*range(170), None, *range(60, 70), None, *range(182, 400)]
    part = [(0, slice(0, 150), 90), (1, slice(150, 400), 140)]
    own, other = (vec._Rows(tile, pa.array(keys[s], pa.int64()), x[s].tobytes(), range(s.stop - s.start), first) for tile, s, first in part)
    for a, b in ((own, other), (other, own), (other, other)):
        for eps in (0, scale, 2 * scale, 3 * scale):
            for both in (True, False):
                got = [(int(i), int(j)) for row, col in vec._within(a, b, eps, both) for i, j in zip(row, col, strict=True)]
                d = np.sqrt(((a.x[:, None] - b.x[None]) ** 2).sum(2))
                ok = (d <= eps) & np.array([[p != q for q in b.keys] for p in a.keys])
                first, more = np.arange(len(a.x))[:, None] < a.first, np.arange(len(b.x))[None] < b.first
                ok &= first if a is b else first | more
                ok &= both | ~(first & more)
                assert sorted(got) == list(zip(*map(np.ndarray.tolist, np.nonzero(ok)), strict=True))
