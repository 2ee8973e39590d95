"""Descriptive statistics, correlation, tests and survival on DataFrames.

Each statistic is one distributed aggregation; only its few numbers reach the
driver, where p-values are computed. Nulls never count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..checkpoints import settle
from ..errors import EmptyInput, InvalidParameter
from ..operators.frame import need, numeric_columns
from . import quantiles, special

# ---- aggregate expressions -----------------------------------------------------


def variance(x: Column, ddof: int = 1) -> Column:
    """Null unless there are more than ``ddof`` values."""
    n = F.count(x)
    return F.when(n > ddof, F.var_pop(x) * n / (n - ddof))


def skewness(x: Column) -> Column:
    """Mean cubed deviation over the cubed sample deviation; 0 if constant."""
    n = F.count(x)
    return F.when(n >= 3, F.when(F.var_samp(x) == 0, 0.0).otherwise(F.skewness(x) * F.pow((n - 1) / n, F.lit(1.5))))


def kurtosis(x: Column) -> Column:
    n = F.count(x)
    return F.when(n >= 4, F.when(F.var_samp(x) == 0, 0.0).otherwise((F.kurtosis(x) + 3) * F.pow((n - 1) / n, F.lit(2.0)) - 3))


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column, kind: str = "l2") -> Column:
    size = F.transform(a, lambda x: F.abs(x.cast("double")))
    if kind == "l2":
        return F.sqrt(dot(a, a))
    if kind == "l1":
        return F.aggregate(size, F.lit(0.0), lambda s, v: s + v)
    if kind == "inf":
        return F.array_max(size)
    raise InvalidParameter(kind)


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, by: float) -> Column:
    return F.transform(a, lambda x: x * by)


def normalise(a: Column) -> Column:
    return F.transform(a, lambda x: x / norm(a))


def standardise(a: Column) -> Column:
    mean = F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    std = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / (F.size(a) - 1))
    return F.transform(a, lambda x: (x - mean) / std)


# ---- descriptions --------------------------------------------------------------


def describe_column(df: DataFrame, column: str) -> DataFrame:
    """One row of count, nulls, mean, std, variance, min, quartiles, max,
    range, skewness and kurtosis."""
    need(df, column)
    x = F.col(column).cast("double")
    quarters = quantiles.of_columns(df, {column: x}, QUARTERS)[column]
    made = df.agg(
        F.count(x).alias("count"), F.count_if(F.col(column).isNull()).alias("null_count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.var_samp(x).alias("variance"),
        F.min(x).alias("min"), *[F.lit(v).cast("double").alias(n) for v, n in zip(quarters, ("q25", "median", "q75"), strict=True)], F.max(x).alias("max"), (F.max(x) - F.min(x)).alias("range"), skewness(x).alias("skewness"), kurtosis(x).alias("kurtosis"),
    )
    return made


QUARTERS = (0.25, 0.5, 0.75)
STATISTICS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def describe(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Rows count, mean, std, min, 25%, 50%, 75%, max; a column for each
    numeric column; one aggregation over the data besides the quartiles'."""
    names = list(columns) or numeric_columns(df)
    need(df, *names)
    quarters = quantiles.of_columns(df, {c: F.col(c) for c in names}, QUARTERS)
    one = lambda c: F.array(F.count(c).cast("double"), F.avg(c), F.stddev_samp(c), F.min(c).cast("double"), *[F.lit(q).cast("double") for q in quarters[c]], F.max(c).cast("double"))
    wide = df.agg(*[one(c).alias(c) for c in names])
    return wide.select(F.explode(F.arrays_zip(F.array(*[F.lit(s) for s in STATISTICS]).alias("statistic"), *names)).alias("r")).select("r.statistic", *[f"r.{c}" for c in names])


def modes(df: DataFrame, column: str) -> DataFrame:
    """All most frequent values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    top = counts.agg(F.max("count").alias("top"))
    return counts.join(F.broadcast(top), F.col("count") == F.col("top")).select(column, "count")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``variable`` and one column for each variable; pairwise complete rows;
    all pairs in one aggregation."""
    need(df, *columns)
    pairs = {frozenset((a, b)): F.corr(F.col(a).cast("double"), F.col(b).cast("double")) for a, b in combinations(columns, 2)}
    wide = df.agg(*[v.alias("~".join(sorted(k))) for k, v in pairs.items()])
    cell = lambda a, b: F.lit(1.0) if a == b else F.col("`" + "~".join(sorted((a, b))) + "`")
    rows = F.array(*[F.struct(F.lit(a).alias("variable"), *[cell(a, b).alias(b) for b in columns]) for a in columns])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def ranked(df: DataFrame, column: str, name: str) -> DataFrame:
    """(value, average rank) of the distinct values: ranks come from cumulative
    counts of values, so equal values never meet in one task as rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    summed = prefix_sums(counts, column, {"_upto": F.col("_n")})
    return summed.select(column, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))


def prefix_sums(df: DataFrame, order_by: str, sums: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """Cumulative sums by ``order_by`` (unique), without one global window:
    sums within ranges, shifted by the totals of the ranges before (a few
    numbers for each range)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumns({f"_{k}": v for k, v in sums.items()}).repartitionByRange(n, order_by).withColumn("_range", F.spark_partition_id())
    dealt = settle(dealt)  # ranges are sampled: they must not be drawn twice
    totals = sorted(map(tuple, dealt.groupBy("_range").agg(*[F.sum(f"_{k}").alias(k) for k in sums]).collect()))
    over = W.partitionBy("_range").orderBy(order_by).rowsBetween(W.unboundedPreceding, 0)
    for i, k in enumerate(sums):
        before, total = [], 0
        for row in totals:
            before += [F.lit(row[0]), F.lit(total)]
            total += row[i + 1] or 0
        shift = F.element_at(F.create_map(*before), F.col("_range")) if before else F.lit(0)
        dealt = dealt.withColumn(k, F.sum(f"_{k}").over(over) + shift)
    return dealt.drop("_range", *[f"_{k}" for k in sums])


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Pearson's correlation of average ranks, of complete rows."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    rows = rows.join(ranked(rows, a, "_ra"), a).join(ranked(rows, b, "_rb"), b)
    return rows.agg(F.corr("_ra", "_rb").alias("spearman"))


# ---- tests ---------------------------------------------------------------------


def _moments(df: DataFrame, column: str) -> tuple[int, float, float]:
    n, mean, var = df.agg(F.count(column), F.avg(F.col(column).cast("double")), F.var_samp(F.col(column).cast("double"))).first()
    if not n or n < 2:
        raise EmptyInput("at least two values are needed")
    return n, mean, var


def t_test(df: DataFrame, column: str, mu: float = 0.0, confidence: float = 0.95) -> dict[str, float]:
    n, mean, var = _moments(df, column)
    se = math.sqrt(var / n)
    t = (mean - mu) / se if se else math.inf
    half = special.t_quantile(0.5 + confidence / 2, n - 1) * se
    return {"statistic": t, "p_value": special.t_two_sided(t, n - 1), "df": n - 1, "low": mean - half, "high": mean + half, "cohen_d": (mean - mu) / math.sqrt(var) if var else math.inf}


def t_test_two(df: DataFrame, column: str, group: str, first: object, second: object, pooled: bool = False, confidence: float = 0.95) -> dict[str, float]:
    """Welch's test by default."""
    rows = {r["g"]: r for r in df.where(F.col(group).isin(first, second)).groupBy(F.col(group).alias("g")).agg(F.count(column).alias("n"), F.avg(column).alias("m"), F.var_samp(column).alias("v")).collect()}
    a, b = rows[first], rows[second]
    va, vb = a["v"] / a["n"], b["v"] / b["n"]
    both = ((a["n"] - 1) * a["v"] + (b["n"] - 1) * b["v"]) / (a["n"] + b["n"] - 2)
    if pooled:
        se, df_ = math.sqrt(both * (1 / a["n"] + 1 / b["n"])), a["n"] + b["n"] - 2
    else:
        se, df_ = math.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (a["n"] - 1) + vb**2 / (b["n"] - 1))
    t = (a["m"] - b["m"]) / se
    half = special.t_quantile(0.5 + confidence / 2, df_) * se
    return {"statistic": t, "p_value": special.t_two_sided(t, df_), "df": df_, "low": a["m"] - b["m"] - half, "high": a["m"] - b["m"] + half, "cohen_d": (a["m"] - b["m"]) / math.sqrt(both)}


def t_test_paired(df: DataFrame, before: str, after: str) -> dict[str, float]:
    return t_test(df.select((F.col(after) - F.col(before)).alias("d")), "d")


def anova(df: DataFrame, column: str, group: str) -> dict[str, float]:
    """One-way analysis of variance; one row per group reaches the driver."""
    rows = df.where(F.col(column).isNotNull()).groupBy(group).agg(F.count(column).alias("n"), F.avg(column).alias("m"), F.var_pop(column).alias("v")).collect()
    if len(rows) < 2:
        raise EmptyInput("at least two groups are needed")
    n = np.array([r["n"] for r in rows], float)
    m, v = (np.array([r[k] for r in rows], float) for k in ("m", "v"))
    grand = (n * m).sum() / n.sum()
    between, within = (n * (m - grand) ** 2).sum(), (n * v).sum()
    d1, d2 = len(rows) - 1, n.sum() - len(rows)
    f = (between / d1) / (within / d2)
    return {"statistic": float(f), "p_value": special.f_upper(f, d1, d2), "df_between": d1, "df_within": int(d2), "eta_squared": float(between / (between + within))}


def chi2_fit(observed: Sequence[float], expected: Sequence[float] | None = None) -> dict[str, float]:
    o = np.asarray(observed, float)
    e = np.full(len(o), o.mean()) if expected is None else np.asarray(expected, float)
    x = float(((o - e) ** 2 / e).sum())
    return {"statistic": x, "p_value": special.chi2_upper(x, len(o) - 1), "df": len(o) - 1}


def ks_normal(df: DataFrame, column: str) -> dict[str, float]:
    """Kolmogorov-Smirnov distance to the fitted normal distribution, from
    distinct values and their cumulative counts."""
    n, mean, var = _moments(df, column)
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    steps = prefix_sums(counts, "x", {"upto": F.col("n")})
    cdf = F.udf(lambda x: special.normal_cdf((x - mean) / math.sqrt(var)), "double", useArrow=True)(F.col("x"))
    d = steps.withColumn("cdf", cdf).agg(F.max(F.greatest(F.abs(F.col("upto") / n - F.col("cdf")), F.abs(F.col("cdf") - (F.col("upto") - F.col("n")) / n)))).first()[0]
    return {"statistic": d, "p_value": special.kolmogorov_upper((math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d)}


def shapiro_wilk(values: Sequence[float]) -> dict[str, float]:
    """W by normal scores of Blom's positions, p by Royston's log-normal
    approximation (fitted to at most 5,000 values, and carried on beyond), of
    values that the driver holds."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3:
        raise InvalidParameter("at least 3 values are needed")
    m = np.array([special.normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    return _shapiro(n, float((m @ x) ** 2 / ((m @ m) * ((x - x.mean()) ** 2).sum())))


def shapiro_wilk_column(df: DataFrame, column: str) -> dict[str, float]:
    """As ``shapiro_wilk``, of any number of rows: counts of different values,
    cumulated over ranges, tell each value's positions, and tasks add up the
    scores there."""
    x = F.col(column).cast("double")
    n, mean, spread = df.agg(F.count(x), F.avg(x), F.var_pop(x)).first()
    if n < 3:
        raise InvalidParameter("at least 3 values are needed")
    levels = df.where(x.isNotNull()).groupBy(x.alias("x")).agg(F.count(F.lit(1)).alias("c"))
    score = NormalDist().inv_cdf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_x = squares = 0.0
        for batch in batches:
            for v, c, upto in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                for at in range(upto - c, upto, 4096):
                    m = np.array([score((i + 0.625) / (n + 0.25)) for i in range(at, min(at + 4096, upto))])
                    by_x, squares = by_x + (v - mean) * m.sum(), squares + m @ m
        yield pa.RecordBatch.from_arrays([pa.array([by_x]), pa.array([squares])], names=["m_x", "m_m"])

    found = prefix_sums(levels, "x", {"upto": F.col("c")}).select("x", "c", "upto").mapInArrow(run, "m_x double, m_m double")
    m_x, m_m = found.agg(F.sum("m_x"), F.sum("m_m")).first()
    return _shapiro(n, m_x**2 / (m_m * spread * n) if spread else float("nan"))


def _shapiro(n: int, w: float) -> dict[str, float]:
    if n < 12:
        g, mu = 0.459 * n - 2.273, 0.544 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        sigma = math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
        arg = g - math.log(max(1 - w, 1e-12))
        z = (-math.log(arg) - mu) / sigma if arg > 0 else 8.0
    else:
        log_n = math.log(n)
        mu, sigma = -1.5861 - 0.31082 * log_n - 0.083751 * log_n**2 + 0.0038915 * log_n**3, math.exp(-0.4803 - 0.082676 * log_n + 0.0030302 * log_n**2)
        z = (math.log(max(1 - w, 1e-12)) - mu) / sigma
    return {"statistic": w, "p_value": 1 - special.normal_cdf(z)}


def mann_whitney(df: DataFrame, column: str, group: str, first: object, second: object) -> dict[str, float]:
    """U of the first group, with a normal approximation corrected for ties."""
    rows = df.where(F.col(group).isin(first, second) & F.col(column).isNotNull())
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(group) == F.lit(first)).alias("a"))
    steps = prefix_sums(counts, column, {"upto": F.col("n")})
    ra, na, n, ties = steps.agg(F.sum(F.col("a") * (F.col("upto") - (F.col("n") - 1) / 2)), F.sum("a"), F.sum("n"), F.sum(F.pow(F.col("n"), F.lit(3)) - F.col("n"))).first()
    nb = n - na
    u = ra - na * (na + 1) / 2
    sd = math.sqrt(na * nb / 12 * ((n + 1) - ties / (n * (n - 1))))
    z = (u - na * nb / 2) / sd
    return {"statistic": u, "z": z, "p_value": 2 * (1 - special.normal_cdf(abs(z)))}


# ---- survival ------------------------------------------------------------------


def kaplan_meier(df: DataFrame, duration: str, event: str) -> DataFrame:
    """(time, at_risk, events, censored, survival): product-limit estimate at
    each distinct time."""
    times = df.groupBy(F.col(duration).alias("time")).agg(F.sum(F.col(event).cast("long")).alias("events"), F.count(F.lit(1)).alias("_n"))
    total = times.agg(F.sum("_n")).first()[0] or 0
    step = F.when(F.col("at_risk") == F.col("events"), F.lit(0.0)).otherwise(F.log(1 - F.col("events") / F.col("at_risk")))
    rows = prefix_sums(times, "time", {"_upto": F.col("_n")}).withColumn("at_risk", F.lit(total) - F.col("_upto") + F.col("_n"))
    rows = prefix_sums(rows, "time", {"_log": step, "_gone": (F.col("at_risk") == F.col("events")).cast("long")})
    return rows.select("time", "at_risk", "events", (F.col("_n") - F.col("events")).alias("censored"), F.when(F.col("_gone") > 0, 0.0).otherwise(F.exp("_log")).alias("survival"))


def cox_ph(df: DataFrame, duration: str, event: str, covariates: Sequence[str], rounds: int = 25) -> np.ndarray:
    """Coefficients of a proportional hazards model (Breslow ties) by Newton's
    method; rows with a null take no part. Rows are dealt once by ranges of
    falling duration. In each round a range gives the total of exp(xb), x exp(xb)
    and xx' exp(xb) of its rows; these, added up over the ranges before it, are
    what its risk sets start from, and the ranges then sum gradient and Hessian.
    A few numbers for each range reach the driver, however many durations there
    are, and rows of one duration may lie in several ranges."""
    need(df, duration, event, *covariates)
    k = len(covariates)
    zero = np.zeros(1 + k + k * k)
    rows = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate([duration, event, *covariates])]).dropna()
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = F.desc("_0")
    rows = rows.repartitionByRange(n, by, F.xxhash64(*rows.columns)).sortWithinPartitions(by)
    rows = settle(rows.withColumn("range", F.spark_partition_id()))

    def groups(batches: Iterator[pa.RecordBatch], beta: np.ndarray) -> Iterator[tuple[int, float, np.ndarray, float, np.ndarray]]:
        """(range, duration, sums over its rows, events, covariates of events) of
        runs of one duration; a run may come in parts."""
        for batch in batches:
            if not batch.num_rows:
                continue
            t, e, *x = (c.to_numpy() for c in batch.columns[:-1])
            x = np.column_stack(x)
            risk = np.exp(x @ beta)
            terms = np.column_stack([risk, risk[:, None] * x, (risk[:, None, None] * x[:, :, None] * x[:, None, :]).reshape(len(t), -1)])
            at = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            number = batch.column(batch.num_columns - 1)[0].as_py()
            sums, died, gone = np.add.reduceat(terms, at), np.add.reduceat(e, at), np.add.reduceat(e[:, None] * x, at)
            yield from zip([number] * len(at), t[at].tolist(), sums, died.tolist(), gone, strict=True)

    def totals(beta: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, first, last, own, whole = None, None, None, zero, zero
            for number, t, sums, _, _ in groups(batches, beta):
                first = t if first is None else first
                own = own + sums if t == first else own
                last, whole = t, whole + sums
            if number is not None:
                yield pa.RecordBatch.from_pylist([{"range": number, "first": first, "last": last, "own": own.tolist(), "whole": whole.tolist()}])

        return rows.mapInArrow(run, "range long, first double, last double, own array<double>, whole array<double>")

    def slopes(beta: np.ndarray, starts: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made, before, last, open_sums, died, gone, more = np.zeros(k + k * k), None, None, zero, 0.0, np.zeros(k), zero

            def close(back: np.ndarray) -> np.ndarray:
                if not died:
                    return np.zeros(k + k * k)
                mean = back[1 : k + 1] / back[0]
                return np.append(gone - died * mean, died * ((back[k + 1 :] / back[0]).reshape(k, k) - np.outer(mean, mean)))

            for number, t, sums, d, xd in groups(batches, beta):
                if before is None:
                    before, more = starts[number]
                elif t != last:
                    before = before + open_sums
                    made = made + close(before)
                    open_sums, died, gone = zero, 0.0, np.zeros(k)
                last, open_sums, died, gone = t, open_sums + sums, died + d, gone + xd
            if before is not None:
                made = made + close(before + open_sums + more)  # rows of the last duration in ranges after this one
                yield pa.RecordBatch.from_pylist([{"v": made.tolist()}])

        found = rows.mapInArrow(run, "v array<double>").select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("v")).collect()
        out = np.zeros(k + k * k)
        for r in found:
            out[r["pos"]] = r["v"]
        return out

    beta = np.zeros(k)
    for _ in range(rounds):
        found = totals(beta).orderBy("range").collect()  # a row for each range
        starts, before = {}, zero
        for i, r in enumerate(found):
            more = zero
            for other in found[i + 1 :]:
                if other["first"] != r["last"]:
                    break
                more = more + np.array(other["own"])
                if other["last"] != r["last"]:
                    break
            starts[r["range"]] = (before, more)
            before = before + np.array(r["whole"])
        made = slopes(beta, starts)
        move = np.linalg.solve(made[k:].reshape(k, k) + 1e-9 * np.eye(k), made[:k])
        beta = beta + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return beta
