"""Exact trees against brute force over all cuts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.errors import EmptyInput, InvalidParameter
from brightloom.operators import trees


def brute(x, y, kind, depth, least, classes):
    """(feature, threshold, gain, left, right) or a leaf's value."""
    stats = np.array([(y == c).sum() for c in classes], float) if kind != "mse" else np.array([len(y), y.sum(), (y * y).sum()])
    if depth == 0 or len(y) < least or len(np.unique(y)) == 1:
        return classes[int(stats.argmax())] if kind != "mse" else y.mean()
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values, values[1:], strict=False):
            left = x[:, f] <= a
            own = np.array([(y[left] == c).sum() for c in classes], float) if kind != "mse" else np.array([left.sum(), y[left].sum(), 0.0])
            gain = float(trees.gains(own, stats, kind))
            if best is None or gain > best[2] + 1e-12:
                best = (f, trees.midpoint(a, b), gain)
    if best is None:
        return classes[int(stats.argmax())] if kind != "mse" else y.mean()
    left = x[:, best[0]] <= best[1]
    return (*best, brute(x[left], y[left], kind, depth - 1, least, classes), brute(x[~left], y[~left], kind, depth - 1, least, classes))


def shape(tree, k=0):
    node = tree.nodes[k]
    if node.feature < 0:
        return tree.value(node)
    return node.feature, node.threshold, node.gain, shape(tree, node.left), shape(tree, node.right)


def flat(t):
    return [t] if not isinstance(t, tuple) else [*t[:3], *flat(t[3]), *flat(t[4])]


@pytest.mark.parametrize(("kind", "least"), [("gini", 2), ("entropy", 20), ("mse", 2)])
def test_tree_is_exact(spark, kind, least):
    rng = np.random.default_rng(least)
    n = 300
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 6, n), rng.integers(0, 2, n), np.full(n, 3.0)])
    y = ((x[:, 0] > 0.3) + (x[:, 1] > 2) * rng.integers(0, 2, n)).astype(float) if kind != "mse" else 3 * x[:, 0] + x[:, 1] + rng.normal(size=n)
    names = list("abcd")
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], [*names, "y"]).repartition(5)
    tree = trees.decision_tree(df, names, "y", kind, max_depth=4, min_split=least)
    want = brute(x, y, kind, 4, least, sorted(set(y.tolist())))
    assert flat(shape(tree)) == pytest.approx(flat(want))
    got = sum(tree.importances())
    assert got == pytest.approx(1) and tree.importances()[3] == 0
    leaf = tree.transform(df.withColumn("leaf", tree.node())).groupBy("leaf").agg(F.countDistinct("prediction").alias("n"), F.avg("y").alias("m"), F.first("prediction").alias("p")).collect()
    assert all(r.n == 1 for r in leaf) and (kind != "mse" or all(r.m == pytest.approx(r.p) for r in leaf))


def test_small_fixtures(spark):
    apart = spark.createDataFrame([(1.0, 2.0, 0), (1.5, 1.8, 0), (2.0, 2.1, 0), (8.0, 8.0, 1), (8.5, 7.5, 1), (9.0, 8.8, 1)], "a double, b double, y int")
    tree = trees.decision_tree(apart, ["a", "b"], "y", max_depth=3)
    assert tree.transform(apart).where("prediction <> y").count() == 0 and sum(tree.importances()) == pytest.approx(1)
    assert (tree.nodes[0].feature, tree.nodes[0].threshold) == (0, 5.0)
    xor = spark.createDataFrame([(0, 0, "n"), (0, 1, "y"), (1, 0, "y"), (1, 1, "n")], "a int, b int, y string")
    assert trees.decision_tree(xor, ["a", "b"], "y").transform(xor).where("prediction <> y").count() == 0
    with pytest.raises(EmptyInput):
        trees.decision_tree(xor.limit(0), ["a", "b"], "y")
    with pytest.raises(InvalidParameter):
        trees.decision_tree(xor, ["a", "b"], "y", "best")


def test_nulls_and_extreme_values(spark):
    rows = [(None, 1.0), (float("nan"), 1.0), (float("inf"), 0.0), (1e308, 0.0), (1.5e308, 0.0), (-1e308, 5.0), (2.0, None)]
    df = spark.createDataFrame(rows, "x double, y double")
    tree = trees.decision_tree(df, ["x"], "y", "mse")
    assert {round(r.prediction, 9) for r in tree.transform(df).where("x is null or isnan(x)").collect()} == {1.0}
    assert {round(r.prediction, 9) for r in tree.transform(df).where("x = 1e308 or x = double('infinity')").collect()} == {0.0}
    assert trees.midpoint(1.0, np.nextafter(1.0, 2)) == 1.0 and trees.midpoint(-1.0, 3.0) == 1.0


def test_forest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4))
    rows = [(*map(float, r), int(r[0] + 0.5 * r[1] > 0), float(2 * r[0] - r[2])) for r in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, y int, z double").repartition(3)
    forest = trees.random_forest(df, list("abcd"), "y", trees=7, max_depth=4)
    assert forest.transform(df).where("prediction = y").count() > 350
    sizes = {float(t.nodes[0].stats.sum()) for t in forest.trees}
    assert len(sizes) > 1 and all(300 < s < 500 for s in sizes) and len({t.nodes[0].feature for t in forest.trees}) > 1
    assert sum(forest.importances()) == pytest.approx(1) and int(forest.importances().argmax()) == 0
    again = trees.random_forest(df, list("abcd"), "y", trees=7, max_depth=4)
    assert [shape(t) for t in forest.trees] == [shape(t) for t in again.trees]
    means = trees.random_forest(df, list("abcd"), "z", "mse", trees=3, max_depth=5, features=4)
    assert means.transform(df).agg(F.corr("prediction", "z")).first()[0] > 0.9


@pytest.mark.parametrize("kind", ["gini", "mse"])
def test_rows_that_are_alike_are_put_together(spark, monkeypatch, kind):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 4, (600, 3)) / 2
    rows = [(*map(float, r), int(r[0] + r[1] > 1.5 + (r[2] > 1)), None if i % 50 == 0 else float(3 * r[0] - r[2])) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int, z double").withColumn("b", F.when(F.col("b") > 0, F.col("b"))).repartition(4)
    df = trees.settle(df)
    grow = lambda: trees.random_forest(df, list("abc"), "z" if kind == "mse" else "y", kind, trees=3, max_depth=3, features=2).trees
    settled = []
    monkeypatch.setattr(trees, "settle", lambda d, settle=trees.settle: (settled.append(settle(d)), settled[-1])[1])
    near = grow()
    assert settled[0].count() <= 4**3 * 2  # not 600 rows, at each level again
    monkeypatch.setattr(trees, "ALIKE", 10**9)
    far = grow()
    assert all(flat(shape(a)) == pytest.approx(flat(shape(b))) for a, b in zip(near, far, strict=True))
    assert [n.stats[0] for t in near for n in t.nodes] == [n.stats[0] for t in far for n in t.nodes]
    ones = lambda: trees.decision_tree(df, list("abc"), "y", max_depth=3)
    whole = ones()
    monkeypatch.setattr(trees, "ALIKE", 1)
    assert shape(ones()) == shape(whole)
