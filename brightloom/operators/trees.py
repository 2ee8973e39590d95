"""Exact decision trees and forests, grown level by level over all rows.

At each level every row is sent to its open node by the tree so far, a column
expression, and the rows of a node are totalled for each different value of each
feature (class weights, or weight and sum of the target). These totals are dealt
out by ranges of (tree, node, feature, value), so a feature of any number of
values is spread over tasks; a few numbers for each range give it what lies
before it, and each range then weighs every cut between two of its neighbours,
for all open nodes, features and trees of a forest at once. The driver gets the
best cut of each open node: it holds the trees, never rows. Rows that agree in all
features (and in their class) go the same way in every tree, so where a sketch says
that they are many, one pass makes them one row with its weight in each tree, and
the levels run over those.

Thresholds are midpoints between neighbouring values (the lower one, where no
number lies between); ties of gains go to the earlier feature, then the lower
threshold. Nulls and NaN are the largest value and go right; rows without a
target take no part. A node is a leaf at ``max_depth``, with fewer than
``min_split`` rows, if its targets are equal, or if no feature has two values.
Importances are totals of gains times rows, adding up to one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import settle
from ..errors import EmptyInput, InvalidParameter
from .frame import need

#: A classifier has at most so many classes.
CLASSES = 1000
KINDS = ("gini", "entropy", "mse")
#: Rows are put together if so many or more of them, on average, are alike.
ALIKE = 4


@dataclass
class Node:
    stats: np.ndarray
    depth: int
    feature: int = -1
    threshold: float = 0.0
    gain: float = 0.0
    left: int = -1
    right: int = -1


@dataclass
class Tree:
    """Nodes, the first of them the root; ``classes`` is None for means."""

    columns: list[str]
    classes: list | None
    shift: float
    nodes: list[Node] = field(default_factory=list)

    def value(self, node: Node) -> object:
        """The class of most weight (ties: the first), or the mean."""
        if self.classes is not None:
            return self.classes[int(node.stats.argmax())]
        return float(node.stats[1] / node.stats[0] + self.shift)

    def _walk(self, leaf, k: int = 0) -> Column:
        node = self.nodes[k]
        if node.feature < 0:
            return leaf(k)
        goes_left = _value(self.columns[node.feature]) <= F.lit(node.threshold)
        return F.when(goes_left, self._walk(leaf, node.left)).otherwise(self._walk(leaf, node.right))

    def node(self) -> Column:
        """The number of the node that a row ends in."""
        return self._walk(F.lit)

    def prediction(self) -> Column:
        return self._walk(lambda k: F.lit(self.value(self.nodes[k])))

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.prediction())

    def importances(self) -> np.ndarray:
        out = np.zeros(len(self.columns))
        for node in self.nodes:
            if node.feature >= 0:
                out[node.feature] += node.gain * (node.stats[0] if self.classes is None else node.stats.sum())
        return out / out.sum() if out.sum() > 0 else out


@dataclass
class Forest:
    trees: list[Tree]

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """The class that most trees name (ties: the first), or the mean."""
        votes = [t.prediction() for t in self.trees]
        if self.trees[0].classes is None:
            return df.withColumn(name, sum(votes[1:], votes[0]) / len(votes))
        count = [F.struct(sum(((v == F.lit(c)).cast("int") for v in votes), F.lit(0)).alias("n"), F.lit(-k).alias("k"), F.lit(c).alias("c")) for k, c in enumerate(self.trees[0].classes)]
        return df.withColumn(name, F.array_max(F.array(*count))["c"])

    def importances(self) -> np.ndarray:
        out = sum(t.importances() for t in self.trees)
        return out / out.sum() if out.sum() > 0 else out


def _value(column: str) -> Column:
    return F.coalesce(F.col(column).cast("double"), F.lit(float("nan")))


def _impurity(stats: np.ndarray, kind: str) -> np.ndarray:
    """Of rows of class weights."""
    share = stats / np.maximum(stats.sum(-1, keepdims=True), 1e-300)
    if kind == "gini":
        return 1 - (share * share).sum(-1)
    return -(share * np.log2(np.where(share > 0, share, 1))).sum(-1)


def gains(left: np.ndarray, whole: np.ndarray, kind: str) -> np.ndarray:
    """The decrease of impurity by cuts with those totals to the left."""
    right = whole - left
    if kind == "mse":
        part = lambda s: s[..., 1] ** 2 / s[..., 0]
        return (part(left) + part(right) - part(whole)) / whole[..., 0]
    n, m = whole.sum(-1), left.sum(-1)
    return _impurity(whole, kind) - m / n * _impurity(left, kind) - (n - m) / n * _impurity(right, kind)


def midpoint(a: float, b: float) -> float:
    """A number from a on and below b, where NaN is the largest."""
    with np.errstate(all="ignore"):
        mid = a + (b - a) / 2 if np.sign(a) == np.sign(b) else (a + b) / 2
    return float(mid) if a <= mid and (mid < b or b != b) and np.isfinite(mid) else float(a)


def _pure(node: Node, kind: str) -> bool:
    if kind == "mse":
        n, s, ss = node.stats
        return ss - s * s / n <= 1e-12 * max(ss, 1e-300)
    return int((node.stats > 0).sum()) < 2


def _best_cuts(totals: DataFrame, kind: str, width: int) -> list:
    """The best cut (tree, node, feature, threshold, gain, left) of each node, of
    totals (tree, node, feature, v, stats)."""
    keys = ["tree", "node", "feature"]
    dealt = settle(totals.repartitionByRange(*keys, "v").sortWithinPartitions(*keys, "v").withColumn("range", F.spark_partition_id()))
    # of each range and key: its total, and its first value, which is the next one of the range before
    parts = dealt.groupBy("range", *keys).agg(F.min("v").alias("v"), F.array(*[F.sum(F.col("stats")[k]) for k in range(width)]).alias("stats"))
    by_key: dict[tuple, list] = {}
    for r in parts.orderBy(*keys, "range").collect():  # a row for each key, and one more for each range
        by_key.setdefault((r["tree"], r["node"], r["feature"]), []).append((r["range"], r["v"], np.array(r["stats"])))
    state = {}
    for key, own in by_key.items():
        before, whole = np.zeros(width), sum(s for _, _, s in own)
        for k, (number, _, stats) in enumerate(own):
            state[(number, *key)] = (before, whole, own[k + 1][1] if k + 1 < len(own) else None)
            before = before + stats
    shared = totals.sparkSession.sparkContext.broadcast(state)
    names = [*keys, "gain", "threshold", "left"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried, held = None, None, None  # the last key, its total so far, and its last value
        best: dict[tuple, tuple] = {}

        def weigh(key: tuple, v: np.ndarray, left: np.ndarray, following: np.ndarray) -> None:
            whole = shared.value[key][1]
            found = gains(left, whole, kind)
            k = int(np.argmax(found))
            if key not in best or found[k] > best[key][0]:
                best[key] = (float(found[k]), midpoint(float(v[k]), float(following[k])), left[k].tolist())

        for batch in batches:
            if not batch.num_rows:
                continue
            table = [batch.column(i).to_numpy() for i in range(4)]
            stats = batch.column(4).flatten().to_numpy().reshape(-1, width)
            number = batch.column(5).to_numpy()
            change = np.flatnonzero((np.diff(table[0]) != 0) | (np.diff(table[1]) != 0) | (np.diff(table[2]) != 0)) + 1
            edges = [0, *change.tolist(), batch.num_rows]
            for s, e in zip(edges, edges[1:], strict=False):
                key = (int(number[s]), *(int(table[i][s]) for i in range(3)))
                if key != last:
                    if last is not None:
                        _close(last, held, carried, weigh, shared.value)
                    carried, held, last = shared.value[key][0], None, key
                v, left = table[3][s:e], carried + np.cumsum(stats[s:e], 0)
                if held is not None:
                    weigh(key, np.array([held]), carried[None], v[:1])
                if e - s > 1:
                    weigh(key, v[:-1], left[:-1], v[1:])
                carried, held = left[-1], v[-1]
        if last is not None:
            _close(last, held, carried, weigh, shared.value)
        rows = [{"tree": k[1], "node": k[2], "feature": k[3], "gain": g, "threshold": t, "left": x} for k, (g, t, x) in best.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("gain", pa.float64()), ("threshold", pa.float64()), ("left", pa.list_(pa.float64()))]))

    cuts = dealt.select(*keys, "v", "stats", "range").mapInArrow(run, "tree int, node int, feature int, gain double, threshold double, left array<double>")
    order = F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("threshold")).alias("t"))
    return cuts.groupBy("tree", "node").agg(F.max_by(F.struct(*names[2:]), order).alias("cut")).collect()  # a row for each open node


def _close(key: tuple, held: float, carried: np.ndarray, weigh, state: dict) -> None:
    """The cut between a range's last value and the next range's first."""
    following = state[key][2]
    if following is not None:
        weigh(key, np.array([held]), carried[None], np.array([following]))


def _grown(df: DataFrame, columns: list[str], target: str, kind: str, max_depth: int, min_split: int, trees: int, features: int | None, seed: int, bootstrap: bool) -> list[Tree]:
    need(df, *columns, target)
    if kind not in KINDS:
        raise InvalidParameter(f"criterion must be one of {KINDS}")
    rows = df.where(F.col(target).isNotNull())
    y, values = F.col(target), [_value(c).alias(c) for c in columns]
    classes, shift, kinds = None, 0.0, F.approx_count_distinct(F.xxhash64(*values)).alias("kinds")
    if kind == "mse":
        first = rows.agg(F.count(F.lit(1)), F.avg(y.cast("double")), kinds).first()
        n, shift, alike = first[0], first[1], first["kinds"] * ALIKE <= first[0]
        y = y.cast("double") - F.lit(shift)
        own = F.array(F.lit(1.0), y, y * y)
    else:
        found = rows.groupBy(target).agg(F.count(F.lit(1)).alias("n"), kinds).limit(CLASSES + 1).collect()
        if len(found) > CLASSES:
            raise InvalidParameter(f"{target} has more than {CLASSES} classes")
        n, classes = sum(r["n"] for r in found), sorted(r[0] for r in found)
        alike = sum(r["kinds"] for r in found) * ALIKE <= n
        own = F.array(*[(y == F.lit(c)).cast("double") for c in classes])
    if not n:
        raise EmptyInput(target)
    width = 3 if classes is None else len(classes)
    weight, parts = [F.lit(1)] * trees, [F.col("_stats")] * trees
    rows = rows.select(*(values if alike else columns), own.alias("_stats") if kind == "mse" or not alike else y.alias("_class"))
    if bootstrap:  # Poisson weights: how often a row is drawn
        rows = rows.withColumn("_row", F.monotonically_increasing_id())
        rows = rows if alike else settle(rows)
        u = [F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("_row")), F.lit(1 << 40)) / F.lit(float(1 << 40)) for k in range(trees)]
        if alike:
            rows = rows.select("*", *[x.alias(f"_u{k}") for k, x in enumerate(u)])
            u = [F.col(f"_u{k}") for k in range(trees)]
        steps = np.cumsum([np.exp(-1) / np.prod(range(1, i + 1)) for i in range(12)])
        weight = [sum(((x >= F.lit(float(s))).cast("int") for s in steps), F.lit(0)) for x in u]
    if alike and kind == "mse":
        rows = settle(rows.groupBy(*columns).agg(*[F.array(*[F.sum(F.col("_stats")[i] * w) for i in range(width)]).alias(f"_s{k}") for k, w in enumerate(weight)]))
        parts = [F.col(f"_s{k}") for k in range(trees)]
        weight = [(s[0] > 0).cast("int") for s in parts]
    elif alike:
        rows = rows.groupBy(*columns, "_class").agg(*[F.sum(w).alias(f"_w{k}") for k, w in enumerate(weight)])
        weight = [F.col(f"_w{k}") for k in range(trees)]
        rows = settle(rows.select(*columns, F.array(*[(F.col("_class") == F.lit(c)).cast("double") for c in classes]).alias("_stats"), *weight))
    names, rng = list(columns), np.random.default_rng(seed)
    starts = rows.agg(*[F.sum(parts[k][i] * weight[k]).alias(f"s{k}_{i}") for k in range(trees) for i in range(width)]).first()
    grown = [Tree(names, classes, shift, [Node(np.array([starts[k * width + i] for i in range(width)], float), 0)]) for k in range(trees)]
    is_open = {(k, 0) for k in range(trees)}
    size = lambda node: node.stats[0] if kind == "mse" else node.stats.sum()
    may_split = lambda node: node.depth < max_depth and size(node) >= max(min_split, 2) and not _pure(node, kind)
    is_open = {(k, i) for k, i in is_open if may_split(grown[k].nodes[i])}
    while is_open:
        drawn = {key: sorted(rng.choice(len(names), features, replace=False).tolist()) if features and features < len(names) else range(len(names)) for key in sorted(is_open)}
        wanted = df.sparkSession.createDataFrame([(k, i, f) for (k, i), own in drawn.items() for f in own], "tree int, node int, feature int")
        places = F.array(*[F.struct(F.lit(k).alias("tree"), t.node().alias("node"), weight[k].alias("w"), parts[k].alias("stats")) for k, t in enumerate(grown)])
        cells = F.array(*[F.struct(F.lit(f).alias("feature"), _value(c).alias("v")) for f, c in enumerate(names)])
        placed = rows.select(cells.alias("cells"), F.explode(places).alias("p")).where("p.w > 0")
        long = placed.select("p.tree", "p.node", "p.w", "p.stats", F.explode("cells").alias("c")).select("tree", "node", "c.feature", "c.v", "w", "stats")
        long = long.join(F.broadcast(wanted), ["tree", "node", "feature"])  # a row for each open node and feature
        totals = long.groupBy("tree", "node", "feature", "v").agg(F.array(*[F.sum(F.col("stats")[i] * F.col("w")) for i in range(width)]).alias("stats"))
        fresh = set()
        for r in _best_cuts(totals, kind, width):
            tree, cut = grown[r["tree"]], r["cut"]
            node, left = tree.nodes[r["node"]], np.array(cut["left"])
            node.feature, node.threshold, node.gain = cut["feature"], cut["threshold"], cut["gain"]
            for side, stats in (("left", left), ("right", node.stats - left)):
                setattr(node, side, len(tree.nodes))
                tree.nodes.append(Node(stats, node.depth + 1))
                if may_split(tree.nodes[-1]):
                    fresh.add((r["tree"], len(tree.nodes) - 1))
        is_open = fresh
    return grown


def decision_tree(df: DataFrame, columns: Sequence[str], target: str, criterion: str = "gini", max_depth: int = 5, min_split: int = 2) -> Tree:
    """``criterion`` gini or entropy for classes, mse for means."""
    return _grown(df, list(columns), target, criterion, max_depth, min_split, 1, None, 0, False)[0]


def random_forest(df: DataFrame, columns: Sequence[str], target: str, criterion: str = "gini", trees: int = 10, max_depth: int = 5, min_split: int = 2, features: int | None = None, seed: int = 42) -> Forest:
    """Trees over rows drawn with replacement (seeded Poisson weights), each split
    among ``features`` drawn features: by default the root of their number for
    classes and a third of it for means. All trees grow in the same passes."""
    names = list(columns)
    some = features or max(1, int(len(names) ** 0.5) if criterion != "mse" else len(names) // 3)
    return Forest(_grown(df, names, target, criterion, max_depth, min_split, trees, some, seed, True))
