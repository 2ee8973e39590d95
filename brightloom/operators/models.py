"""Supervised models: thin wrappers of the ML library where its optimum is the
wanted one, and exact variants by distributed sums where it isn't."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline as MLPipeline
from pyspark.ml import PipelineModel
from pyspark.ml import classification as mlc
from pyspark.ml import regression as mlr
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from .calibration import isotonic_blocks
from .frame import need


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def argmax(x: Column) -> Column:
    return F.array_position(x, F.array_max(x)) - 1


@dataclass(frozen=True)
class LinearModel:
    columns: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float
    kind: str = "linear"

    def margin(self) -> Column:
        return sum((F.col(c) * F.lit(w) for c, w in zip(self.columns, self.weights, strict=True)), F.lit(self.bias))

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        if self.kind == "linear":
            return df.withColumn(name, self.margin())
        score = sigmoid(self.margin()) if self.kind == "logistic" else self.margin()
        return df.withColumn("score", score).withColumn(name, (F.col("score") > (0.5 if self.kind == "logistic" else 0.0)).cast("int"))

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(asdict(self), f)

    @staticmethod
    def load(path: str) -> LinearModel:
        with open(path) as f:
            x = json.load(f)
        return LinearModel(tuple(x["columns"]), tuple(x["weights"]), x["bias"], x["kind"])


def linear_regression(df: DataFrame, columns: Sequence[str], target: str) -> LinearModel:
    """Least squares by the normal equations: all sums in one aggregation,
    shifted by the means for accuracy."""
    need(df, *columns, target)
    rows = df.dropna(subset=[*columns, target])
    names = [*columns, target]
    mean = list(rows.agg(*[F.avg(c) for c in names]).first())
    gap = [F.col(c).cast("double") - F.lit(m) for c, m in zip(names, mean, strict=True)]
    k = len(columns)
    sums = list(rows.agg(*[F.sum(gap[i] * gap[j]) for i in range(k) for j in range(i, k + 1)]).first())
    table, at = np.zeros((k, k + 1)), 0
    for i in range(k):
        for j in range(i, k + 1):
            table[i, j] = sums[at]
            if j < k:
                table[j, i] = sums[at]
            at += 1
    w = np.linalg.lstsq(table[:, :k], table[:, k], rcond=None)[0]
    return LinearModel(tuple(columns), tuple(map(float, w)), float(mean[-1] - w @ np.array(mean[:-1])))


def _descent(df: DataFrame, columns: Sequence[str], target: str, gradient: Callable, rounds: int, rate: Callable[[int], float]) -> tuple[np.ndarray, float]:
    """Full-batch descent from zero: each round is one aggregation of
    per-partition sums of gradients."""
    names, w = [*columns, target], np.zeros(len(columns) + 1)
    rows = df.select(*[F.col(c).cast("double") for c in names]).persist()
    try:
        n = rows.count()
        for epoch in range(rounds):

            def partial(frames, w=w):
                g = np.zeros(len(w))
                for pdf in frames:
                    x = np.column_stack([pdf[list(columns)].to_numpy(float), np.ones(len(pdf))])
                    g += x.T @ gradient(x @ w, pdf[target].to_numpy(float))
                yield pd.DataFrame([g], columns=[f"g{j}" for j in range(len(g))])

            total = rows.mapInPandas(partial, ", ".join(f"g{j} double" for j in range(len(w)))).agg(*[F.sum(f"g{j}") for j in range(len(w))]).first()
            step = np.array(total, float) / n
            w = w - rate(epoch) * step
            if np.abs(step).max() < 1e-10:
                break
    finally:
        rows.unpersist()
    return w[:-1], float(w[-1])


def logistic_regression(df: DataFrame, columns: Sequence[str], target: str, rounds: int = 0, rate: float = 0.1) -> LinearModel:
    """The converged optimum (ML library), or ``rounds`` of plain descent."""
    if rounds:
        w, b = _descent(df, columns, target, lambda z, y: 1 / (1 + np.exp(-np.clip(z, -60, 60))) - y, rounds, lambda _: rate)
        return LinearModel(tuple(columns), tuple(map(float, w)), b, "logistic")
    fitted = mlc.LogisticRegression(featuresCol="_f", labelCol=target, standardization=False).fit(assemble(df, columns))
    return LinearModel(tuple(columns), tuple(map(float, fitted.coefficients)), float(fitted.intercept), "logistic")


def linear_svc(df: DataFrame, columns: Sequence[str], target: str, rounds: int = 50, rate: float = 0.1, c: float = 1.0) -> LinearModel:
    """Squared hinge loss by descent with a falling rate; labels 0/1."""
    slope = lambda z, y: -2 * c * (2 * y - 1) * np.maximum(0, 1 - (2 * y - 1) * z)
    w, b = _descent(df, columns, target, slope, rounds, lambda e: rate / (1 + 0.001 * e))
    return LinearModel(tuple(columns), tuple(map(float, w)), b, "svc")


def assemble(df: DataFrame, columns: Sequence[str], name: str = "_f") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=name, handleInvalid="keep").transform(df)


ESTIMATORS = {
    "decision_tree_classifier": mlc.DecisionTreeClassifier,
    "decision_tree_regressor": mlr.DecisionTreeRegressor,
    "random_forest_classifier": mlc.RandomForestClassifier,
    "random_forest_regressor": mlr.RandomForestRegressor,
    "gbt_regressor": mlr.GBTRegressor,
    "gbt_classifier": mlc.GBTClassifier,
    "mlp_classifier": mlc.MultilayerPerceptronClassifier,
    "isotonic": mlr.IsotonicRegression,
}


def estimator(kind: str, columns: Sequence[str], target: str, **params) -> MLPipeline:
    """An ML pipeline over plain columns; ``fit`` and ``transform`` are Spark's,
    so are ``save`` and ``load``."""
    if kind not in ESTIMATORS:
        raise InvalidParameter(f"kind must be one of {list(ESTIMATORS)}")
    model = ESTIMATORS[kind](featuresCol="_f", labelCol=target, **params)
    return MLPipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="_f", handleInvalid="keep"), model])


#: Estimators that only total their rows, and what would make them draw or number rows.
TOTALLING = ("decision_tree_classifier", "decision_tree_regressor", "gbt_regressor", "gbt_classifier")
BY_ROW = {"subsamplingRate", "minInstancesPerNode", "weightCol"}
#: About so many rows are a partition of a fit (some 300 bytes each, as the ML library keeps them).
PART_ROWS = 1 << 18


def fit_counted(df: DataFrame, kind: str, columns: Sequence[str], target: str, **params) -> PipelineModel:
    """``estimator(...).fit`` to the different rows of ``df``, weighted by how often
    they occur. The ML library keeps a fit's rows in the partitions that it gets them
    in; here these are of ``PART_ROWS``, however large the parts of a table are."""
    if kind not in TOTALLING or BY_ROW & set(params):
        raise InvalidParameter(f"kind must be one of {TOTALLING}, without {sorted(BY_ROW)}")
    kinds = df.agg(F.approx_count_distinct(F.xxhash64(*columns, target))).first()[0]
    rows = df.groupBy(*columns, target).agg(F.count(F.lit(1)).cast("double").alias("_weight")).repartition(kinds // PART_ROWS + 1)
    return estimator(kind, columns, target, weightCol="_weight", **params).fit(rows)


def one_vs_rest(df: DataFrame, columns: Sequence[str], target: str, fit: Callable[..., LinearModel] = logistic_regression, **more) -> dict[object, LinearModel]:
    classes = sorted(r[0] for r in df.select(target).distinct().collect())
    return {c: fit(df.withColumn("_y", (F.col(target) == F.lit(c)).cast("double")), columns, "_y", **more) for c in classes}


def predict_one_vs_rest(df: DataFrame, models: dict[object, LinearModel], name: str = "prediction") -> DataFrame:
    best = F.array_max(F.array(*[F.struct(m.margin().alias("s"), F.lit(-k).alias("k"), F.lit(c).alias("c")) for k, (c, m) in enumerate(models.items())]))
    return df.withColumn(name, best["c"])


def multi_output(df: DataFrame, columns: Sequence[str], targets: Sequence[str], fit: Callable[..., LinearModel] = linear_regression) -> dict[str, LinearModel]:
    """One model per target: also multi-label, with a classifier's ``fit``."""
    return {t: fit(df, columns, t) for t in targets}


def mlp_regressor(df: DataFrame, columns: Sequence[str], target: str, hidden: int = 16, rounds: int = 200, rate: float = 0.01, seed: int = 42) -> Callable[[DataFrame], DataFrame]:
    """One hidden layer (tanh), Adam on full-batch gradients summed by tasks."""
    rng, d = np.random.default_rng(seed), len(columns)
    sizes = [(d, hidden), (hidden,), (hidden,), (1,)]
    w = np.concatenate([(rng.uniform(-1, 1, s) * np.sqrt(6 / (d + hidden)) * (len(s) == 2 or s == (hidden,))).ravel() for s in sizes])

    def split(v: np.ndarray) -> tuple:
        a = v[: d * hidden].reshape(d, hidden)
        return a, v[d * hidden : (d + 1) * hidden], v[(d + 1) * hidden : (d + 2) * hidden], v[-1]

    rows = df.select(*[F.col(c).cast("double") for c in [*columns, target]]).persist()
    n, m, s = rows.count(), np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):

        def partial(frames, w=w):
            g = np.zeros(len(w))
            for pdf in frames:
                x, y = pdf[list(columns)].to_numpy(float), pdf[target].to_numpy(float)
                a, b, c, e = split(w)
                h = np.tanh(x @ a + b)
                err = h @ c + e - y
                dh = err[:, None] * c * (1 - h * h)
                g += np.concatenate([(x.T @ dh).ravel(), dh.sum(0), h.T @ err, [err.sum()]])
            yield pd.DataFrame({"g": [g]})

        g = np.array([r[0] for r in rows.mapInPandas(partial, "g array<double>").select(F.posexplode("g").alias("p", "v")).groupBy("p").agg(F.sum("v").alias("v")).orderBy("p").select("v").collect()]) / n
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    rows.unpersist()
    a, b, c, e = split(w)

    @F.pandas_udf("double")
    def run(*x: pd.Series) -> pd.Series:
        return pd.Series(np.tanh(np.column_stack(x) @ a + b) @ c + e)

    return lambda frame, name="prediction": frame.withColumn(name, run(*[F.col(k).cast("double") for k in columns]))


# ---- calibration -----------------------------------------------------------------------


def platt(df: DataFrame, score: str, target: str) -> LinearModel:
    """Logistic curve of a score."""
    return logistic_regression(df, [score], target)


def isotonic(df: DataFrame, score: str, target: str) -> tuple[np.ndarray, np.ndarray]:
    """The curve of ``calibration.isotonic_blocks`` for a caller who can hold it:
    greatest score and mean of each block."""
    rows = isotonic_blocks(df, score, target).select("upto", "mean").orderBy("upto").collect()
    return np.array([r["upto"] for r in rows]), np.array([r["mean"] for r in rows])


def calibrate(df: DataFrame, score: str, curve: tuple[np.ndarray, np.ndarray], name: str = "calibrated") -> DataFrame:
    xs, ys = curve

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(np.interp(x.to_numpy(float), xs, ys))

    return df.withColumn(name, run(score))


# ---- explanations ------------------------------------------------------------------------


def permutation_importance(df: DataFrame, columns: Sequence[str], target: str, predict: Callable[[DataFrame], DataFrame], seed: int = 0) -> dict[str, float]:
    """Rise of the mean squared error when a column is dealt anew; at least 0.
    The new values come from a join on shuffled positions."""
    from .frame import with_row_id

    mse = lambda d: predict(d).agg(F.avg(F.pow(F.col(target) - F.col("prediction"), F.lit(2)))).first()[0]
    rows = with_row_id(df.withColumn("_h", F.xxhash64(*df.columns)), ["_h"], "_i")
    base, out = mse(df), {}
    for c in columns:
        dealt = with_row_id(df.select(c).withColumn("_h", F.xxhash64(F.lit(seed), c, F.monotonically_increasing_id())), ["_h"], "_i").select("_i", c)
        out[c] = max(0.0, mse(rows.drop(c, "_h").join(dealt, "_i")) - base)
    return out


def partial_dependence(df: DataFrame, column: str, predict: Callable[[DataFrame], DataFrame], grid: int = 10) -> DataFrame:
    """(value, mean prediction) over an even grid: each row is expanded once
    per grid value."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    points = [low + (high - low) * k / (grid - 1) for k in range(grid)]
    rows = df.withColumn(column, F.explode(F.array(*[F.lit(float(p)) for p in points])))
    return predict(rows).groupBy(F.col(column).alias("value")).agg(F.avg("prediction").alias("mean"))


def kernel_shap(model: Callable[[np.ndarray], np.ndarray], x: np.ndarray, background: np.ndarray, coalitions: int = 200, seed: int = 0) -> np.ndarray:
    """Shapley values by weighted least squares over coalitions of sizes 1 to
    M - 1: all of them where few enough, else seeded samples drawn by the
    kernel."""
    m, rng = len(x), np.random.default_rng(seed)
    base, full = float(model(background).mean()), float(model(x[None])[0])
    if m == 1:
        return np.array([full - base])
    if 2**m - 2 <= coalitions:
        masks = np.array([[i >> j & 1 for j in range(m)] for i in range(1, 2**m - 1)], bool)
        from math import comb

        weight = np.array([(m - 1) / (comb(m, k) * k * (m - k)) for k in masks.sum(1)])
    else:
        sizes = np.arange(1, m)
        p = (m - 1) / (sizes * (m - sizes))
        masks = np.zeros((coalitions, m), bool)
        for row, k in zip(masks, rng.choice(sizes, coalitions, p=p / p.sum()), strict=True):
            row[rng.permutation(m)[:k]] = True
        weight = np.ones(coalitions)
    values = np.array([model(np.where(mask, x, background)).mean() for mask in masks]) - base
    # the last value follows from the sum
    a, y = masks[:, :-1].astype(float) - masks[:, -1:], values - masks[:, -1] * (full - base)
    w = np.sqrt(weight)[:, None]
    phi = np.linalg.lstsq(a * w, y * w[:, 0], rcond=None)[0]
    return np.append(phi, full - base - phi.sum())


def shap_frame(df: DataFrame, columns: Sequence[str], model: Callable[[np.ndarray], np.ndarray], background: np.ndarray, coalitions: int = 200) -> DataFrame:
    """``shap``: an array of Shapley values for each row."""

    @F.pandas_udf("array<double>")
    def run(*x: pd.Series) -> pd.Series:
        return pd.Series([kernel_shap(model, row, background, coalitions) for row in np.column_stack(x).astype(float)])

    return df.withColumn("shap", run(*[F.col(c).cast("double") for c in columns]))


def fitted_trees(model) -> list[tuple[float, list[tuple[dict[int, tuple[float, float]], float]]]]:
    """(weight, leaves) of each tree of a fitted regression tree, forest or
    boosted ensemble; a leaf is the (above, up to] range of each column on its
    path, and its value. Splits of categories aren't taken."""
    trees = getattr(model, "trees", [model])
    weights = model.treeWeights if hasattr(model, "trees") else [1.0]
    if hasattr(model, "trees") and isinstance(model, mlr.RandomForestRegressionModel):
        weights = [1 / len(trees)] * len(trees)  # a forest predicts the mean

    def leaves(node, box: dict[int, tuple[float, float]]):
        if node.subtreeDepth() == 0:
            yield box, float(node.prediction())
            return
        split = node.split()
        if not hasattr(split, "threshold") or "Continuous" not in split.getClass().getSimpleName():
            raise InvalidParameter("splits of categories have no thresholds")
        j, cut = split.featureIndex(), float(split.threshold())
        low, high = box.get(j, (-np.inf, np.inf))
        yield from leaves(node.leftChild(), box | {j: (low, min(high, cut))})
        yield from leaves(node.rightChild(), box | {j: (max(low, cut), high)})

    return [(float(w), list(leaves(tree._call_java("rootNode"), {}))) for w, tree in zip(weights, trees, strict=True)]


def tree_shap(trees: list, x: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Exact Shapley values of rows ``x`` against a background, from the leaves
    of trees instead of sampled coalitions. A leaf that u columns reach only
    with the row's value and v only with the background's is worth its value
    times (u - 1)! v! / (u + v)! to each of the former and minus
    u! (v - 1)! / (u + v)! to each of the latter."""
    from math import factorial

    out = np.zeros(x.shape)
    for weight, leaves in trees:
        for box, value in leaves:
            if not box:
                continue
            names = list(box)
            within = lambda rows, names=names, box=box: np.column_stack([(rows[:, j] > box[j][0]) & (rows[:, j] <= box[j][1]) for j in names])
            mine, theirs = within(x)[:, None, :], within(background)[None, :, :]
            reached = (mine | theirs).all(2)
            own, other = (mine & ~theirs) & reached[..., None], (theirs & ~mine) & reached[..., None]
            m = len(names)
            share = np.array([[factorial(max(u - 1, 0)) * factorial(v) / factorial(max(u + v, 1)) for v in range(m + 1)] for u in range(m + 1)])
            u, v = own.sum(2), other.sum(2)
            gain = own * share[u, v][..., None] - other * share[v, u][..., None]
            out[:, names] += weight * value * gain.mean(1)
    return out


def tree_shap_frame(df: DataFrame, columns: Sequence[str], model, background: np.ndarray, rows: int = 256) -> DataFrame:
    """``shap``: an array of exact Shapley values for each row; the background
    (a few rows, the caller's) and the trees go to the executors, which take
    ``rows`` rows at a time. NaN goes right, as in Spark's trees."""
    trees, back = fitted_trees(model), np.nan_to_num(np.asarray(background, float), nan=np.inf)

    @F.pandas_udf("array<double>")
    def run(*x: pd.Series) -> pd.Series:
        values = np.nan_to_num(np.column_stack(x).astype(float), nan=np.inf)
        return pd.Series([v for at in range(0, len(values), rows) for v in tree_shap(trees, values[at : at + rows], back)], dtype=object)

    return df.withColumn("shap", run(*[F.col(c).cast("double") for c in columns]))


def explain_text(model: Callable[[str], float], text: str) -> list[tuple[str, float]]:
    """Impact of leaving out each token, the strongest first."""
    tokens = text.split()
    whole = model(text)
    found = [(t, whole - model(" ".join(tokens[:k] + tokens[k + 1 :]))) for k, t in enumerate(tokens)]
    return sorted(found, key=lambda x: -abs(x[1]))
