"""Model metrics and validation splits as aggregations."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..functions.statistics import prefix_sums
from .frame import with_row_id


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def _cell(t: int, p: int, truth: str, predicted: str, label: object) -> Column:
    one, two = F.col(truth) == F.lit(label), F.col(predicted) == F.lit(label)
    return F.count_if((one if t else ~one) & (two if p else ~two)).cast("double")


def classification_metrics(df: DataFrame, truth: str, predicted: str, label: object = 1, beta: float = 1.0) -> DataFrame:
    """One row: accuracy, precision, recall, f1, f_beta, mcc of one label."""
    tp, fp, fn, tn = (_cell(t, p, truth, predicted, label) for t, p in ((1, 1), (0, 1), (1, 0), (0, 0)))
    n = df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f = lambda b: ratio((1 + b * b) * tp, (1 + b * b) * tp + b * b * fn + fp)
    mcc = ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return n.select("accuracy", precision.alias("precision"), recall.alias("recall"), f(1.0).alias("f1"), f(beta).alias("f_beta"), mcc.alias("mcc"))


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1, support) of each label."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    both = cells.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit(1).alias("of_t"), (F.col("t") == F.col("p")).cast("int").alias("hit"), "n"), F.struct(F.col("p").alias("label"), F.lit(0).alias("of_t"), F.lit(0).alias("hit"), "n"))).alias("x")).select("x.*")
    per = both.groupBy("label").agg(F.sum(F.col("hit") * F.col("n")).alias("tp"), F.sum(F.col("of_t") * F.col("n")).alias("support"), F.sum((1 - F.col("of_t")) * F.col("n")).alias("called"))
    return per.select("label", ratio(F.col("tp"), F.col("called")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("called") + F.col("support")).alias("f1"), "support")


def balanced_accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    per = df.groupBy(truth).agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("recall"))
    return per.agg(F.avg("recall").alias("balanced_accuracy"))


def cohen_kappa(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = cells.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("a"))
    cols = cells.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("b"))
    chance = rows.join(cols, "label", "full").agg(F.sum(F.coalesce("a", F.lit(0.0)) * F.coalesce("b", F.lit(0.0))).alias("ab"))
    got = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("same"))
    pe, po = F.col("ab") / (F.col("n") * F.col("n")), F.col("same") / F.col("n")
    return got.join(F.broadcast(chance)).select(ratio(po - pe, 1 - pe, 1.0).alias("kappa"))


def probability_losses(df: DataFrame, truth: str, score: str, eps: float = 1e-15) -> DataFrame:
    y, p = F.col(truth).cast("double"), F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1 - eps))
    return df.agg((-F.avg(y * F.log(p) + (1 - y) * F.log1p(-p))).alias("log_loss"), F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"))


def logit_loss(df: DataFrame, truth: str, logit: str) -> DataFrame:
    """Binary cross entropy of logits, in its stable form."""
    z, y = F.col(logit).cast("double"), F.col(truth).cast("double")
    return df.agg(F.avg(F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))).alias("bce"))


def ranking_curve(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(threshold, tp, fp, fn, tn) at each distinct score, from the highest:
    ties fall together. Cumulated over ranges of distinct scores."""
    levels = df.groupBy((-F.col(score)).alias("minus")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) != 1).alias("n"))
    p, n = levels.agg(F.sum("p"), F.sum("n")).first()
    rows = prefix_sums(levels, "minus", {"tp": F.col("p"), "fp": F.col("n")})
    return rows.select((F.lit(0.0) - F.col("minus")).alias("threshold"), "tp", "fp", (F.lit(p or 0) - F.col("tp")).alias("fn"), (F.lit(n or 0) - F.col("fp")).alias("tn"))


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area by trapezoids, as a sum over distinct scores."""
    levels = df.groupBy((-F.col(score)).alias("minus")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) != 1).alias("n"))
    rows = prefix_sums(levels, "minus", {"tp": F.col("p")})
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2))
    return rows.agg(ratio(area, (F.sum("p") * F.sum("n")).cast("double")).alias("roc_auc"))


def pr_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Trapezoids between the points of the precision-recall curve."""
    curve = ranking_curve(df, truth, score).withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    numbered = with_row_id(curve.withColumn("_minus", -F.col("threshold")), "_minus", "_at")
    ahead = numbered.select((F.col("_at") + 1).alias("_at"), F.col("precision").alias("p0"), F.col("recall").alias("r0"))
    return numbered.join(ahead, "_at").agg(F.coalesce(F.sum((F.col("recall") - F.col("r0")) * (F.col("precision") + F.col("p0")) / 2), F.lit(0.0)).alias("pr_auc"))


def regression_metrics(df: DataFrame, truth: str, predicted: str, features: int = 1) -> DataFrame:
    """One row: mse, rmse, mae, r2, adjusted_r2, mape, explained_variance."""
    y, e = F.col(truth).cast("double"), F.col(truth).cast("double") - F.col(predicted)
    rows = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("vy"), F.var_pop(e).alias("ve"), F.count(e).alias("n"), F.avg(F.when(F.abs(y) > 1e-12, F.abs(e / y))).alias("ape"))
    r2 = F.when(F.col("vy") == 0, 0.0).otherwise(1 - F.col("mse") / F.col("vy"))
    adjusted = F.when(F.col("n") > features + 1, 1 - (1 - r2) * (F.col("n") - 1) / (F.col("n") - features - 1)).otherwise(r2)
    return rows.select("mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"), adjusted.alias("adjusted_r2"), (F.coalesce("ape", F.lit(0.0)) * 100).alias("mape"), F.when(F.col("vy") == 0, 0.0).otherwise(1 - F.col("ve") / F.col("vy")).alias("explained_variance"))


# ---- splits --------------------------------------------------------------------------


def k_fold(df: DataFrame, key: str, k: int = 5, seed: int = 0, shuffle: bool = True) -> DataFrame:
    """``fold`` from 0: contiguous equal parts of the (hashed) order."""
    if k < 2:
        raise InvalidParameter("k must be at least 2")
    n = df.count()
    rows = with_row_id(df.withColumn("_h", F.xxhash64(F.lit(seed), key)), ["_h", key] if shuffle else [key], "_row")
    big, extra = (n // k + 1), n % k
    fold = F.when(F.col("_row") < big * extra, F.floor(F.col("_row") / big)).otherwise(extra + F.floor((F.col("_row") - big * extra) / max(n // k, 1)))
    return rows.withColumn("fold", fold.cast("int")).drop("_h", "_row")


def stratified_k_fold(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Classes dealt over the folds in turn, by hashed order."""
    sizes = sorted(((r[0], r[1]) for r in df.groupBy(label).count().collect()), key=lambda x: (x[0] is None, x[0]))
    rows, start, first = with_row_id(df.withColumn("_h", F.xxhash64(F.lit(seed), key)), [label, "_h", key], "_row"), 0, F.lit(0)
    for value, n in sizes:
        first = F.when(F.col(label).eqNullSafe(F.lit(value)), F.lit(start)).otherwise(first)
        start += n
    return rows.withColumn("fold", F.pmod(F.col("_row") - first, F.lit(k)).cast("int")).drop("_h", "_row")


def group_k_fold(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Groups stay whole: the largest goes to the lightest fold first. One row
    for each group reaches the driver as a size; assignments are joined back."""
    sizes = df.groupBy(group).count().orderBy(F.desc("count"), group).collect()
    load, made = [0] * k, []
    for value, n in sizes:
        fold = min(range(k), key=lambda i: (load[i], i))
        load[fold] += n
        made.append((value, fold))
    table = df.sparkSession.createDataFrame(made, f"_g {df.schema[group].dataType.simpleString()}, fold int")
    return df.join(table, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")


def time_series_split(df: DataFrame, order_by: str, splits: int = 5) -> Iterator[tuple[DataFrame, DataFrame]]:
    """(train, test): growing past, next block."""
    n = df.count()
    size = n // (splits + 1)
    rows = with_row_id(df, order_by, "_row")
    for i in range(splits):
        end = n - (splits - i) * size
        yield rows.where(F.col("_row") < end).drop("_row"), rows.where((F.col("_row") >= end) & (F.col("_row") < end + size)).drop("_row")


def cross_validate(folded: DataFrame, fit: Callable[[DataFrame], object], score: Callable[[object, DataFrame], float]) -> dict[str, object]:
    """Scores of models fitted without each fold, mean and population std."""
    folds = sorted(r[0] for r in folded.select("fold").distinct().collect())
    scores = [score(fit(folded.where(F.col("fold") != f)), folded.where(F.col("fold") == f)) for f in folds]
    return {"scores": scores, "mean": float(np.mean(scores)), "std": float(np.std(scores))}


def grid_search(folded: DataFrame, grid: Sequence[dict], fit: Callable[..., object], score: Callable[[object, DataFrame], float]) -> dict[str, object]:
    found = [(cross_validate(folded, lambda d, p=p: fit(d, **p), score)["mean"], p) for p in grid]
    best = max(found, key=lambda x: x[0])
    return {"best_score": best[0], "best_params": best[1], "results": found}


def random_search(folded: DataFrame, space: dict[str, Sequence], n: int, fit: Callable[..., object], score: Callable[[object, DataFrame], float], seed: int = 0) -> dict[str, object]:
    rng = np.random.default_rng(seed)
    return grid_search(folded, [{k: v[int(rng.integers(len(v)))] for k, v in space.items()} for _ in range(n)], fit, score)
