"""Feature preprocessing: ``fit`` is one aggregation that returns a small
frozen object; its ``transform`` is a set of column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..checkpoints import settle
from ..errors import InvalidParameter, NotFitted
from ..functions.quantiles import of_columns
from .frame import need, with_row_id
from .vectors import neighbours, tile_pairs, tiles

EPS = 1e-12


def _lookup(pairs: Mapping[object, object], key: Column, kind: str) -> Column:
    """Value of each key by a literal map; null if absent."""
    if not pairs:
        return F.lit(None).cast(kind)
    made = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.try_element_at(made, key).cast(kind)


# ---- scalers ---------------------------------------------------------------------


@dataclass(frozen=True)
class AffineModel:
    """x -> (x - shift) / scale * gain + base, column by column."""

    params: Mapping[str, tuple[float, float, float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - s) / d * g + b for c, (s, d, g, b) in self.params.items()})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - b) / g * d + s for c, (s, d, g, b) in self.params.items()})


def _first(df: DataFrame, made: list[Column]) -> list:
    return list(df.agg(*[m.alias(f"_{k}") for k, m in enumerate(made)]).first())


def standard_scaler(df: DataFrame, columns: Sequence[str]) -> AffineModel:
    """Population standard deviation; constant columns aren't scaled."""
    need(df, *columns)
    row = _first(df, [f(F.col(c).cast("double")) for c in columns for f in (F.avg, F.stddev_pop)])
    return AffineModel({c: (row[2 * k], row[2 * k + 1] if row[2 * k + 1] > EPS else 1.0, 1.0, 0.0) for k, c in enumerate(columns)})


def min_max_scaler(df: DataFrame, columns: Sequence[str], low: float = 0.0, high: float = 1.0) -> AffineModel:
    """Constant columns go to ``low``."""
    need(df, *columns)
    row = _first(df, [f(F.col(c).cast("double")) for c in columns for f in (F.min, F.max)])
    return AffineModel({c: (row[2 * k], (row[2 * k + 1] - row[2 * k]) or 1.0, high - low, low) for k, c in enumerate(columns)})


def robust_scaler(df: DataFrame, columns: Sequence[str], quantiles: tuple[float, float] = (25.0, 75.0), centering: bool = True, scaling: bool = True) -> AffineModel:
    """Exact percentiles; a column whose range of quantiles is 0 isn't scaled."""
    need(df, *columns)
    found = of_columns(df, {c: F.col(c) for c in columns}, [q / 100 for q in (quantiles[0], 50.0, quantiles[1])])
    size = lambda q: q[2] - q[0] if scaling and q[2] - q[0] > EPS else 1.0
    return AffineModel({c: (q[1] if centering else 0.0, size(q), 1.0, 0.0) for c, q in found.items()})


def normalize_rows(df: DataFrame, columns: Sequence[str], norm: str = "l2") -> DataFrame:
    """Each row divided by its norm; rows of norm 0 become zeros."""
    need(df, *columns)
    x = [F.col(c).cast("double") for c in columns]
    if norm == "max":
        size = F.greatest(*[F.abs(v) for v in x]) if len(x) > 1 else F.abs(x[0])
    elif norm in ("l1", "l2"):
        size = sum((F.abs(v) if norm == "l1" else v * v for v in x), F.lit(0.0))
        size = F.sqrt(size) if norm == "l2" else size
    else:
        raise InvalidParameter(norm)
    return df.withColumns({c: F.when(size < EPS, 0.0).otherwise(v / size) for c, v in zip(columns, x, strict=True)})


# ---- encoders ----------------------------------------------------------------------


@dataclass(frozen=True)
class CodeModel:
    """Codes of the categories of some columns, in lexical order. Categories are
    kept on the driver, as columns or codes of a model have to be."""

    categories: Mapping[str, tuple[str, ...]]
    unknown: float | None = None
    suffix: str = ""

    def transform(self, df: DataFrame) -> DataFrame:
        """Unknown categories get ``unknown``, or raise when evaluated."""

        def code(c: str) -> Column:
            found = _lookup({v: k for k, v in enumerate(self.categories[c])}, F.coalesce(F.col(c).cast("string"), F.lit("")), "int")
            other = F.raise_error(F.concat(F.lit(f"unknown category of {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("null")))).cast("int") if self.unknown is None else F.lit(self.unknown).cast("int")
            return F.coalesce(found, other)

        return df.withColumns({c + self.suffix: code(c) for c in self.categories})

    def inverse(self, df: DataFrame, column: str, code: str | None = None) -> DataFrame:
        names = F.array(*[F.lit(v) for v in self.categories[column]])
        return df.withColumn(column, F.get(names, F.col(code or column + self.suffix)))

    def one_hot(self, df: DataFrame, column: str, strict: bool = True) -> DataFrame:
        """A 0/1 column ``column_category`` for every category."""
        values = self.categories[column]
        key = F.coalesce(F.col(column).cast("string"), F.lit(""))
        made = {f"{column}_{v}": (key == F.lit(v)).cast("double") for v in values}
        if strict:
            known = key.isin(*values)
            made = {k: F.when(known, x).otherwise(F.raise_error(F.lit(f"unknown category of {column}")).cast("double")) for k, x in made.items()}
        return df.withColumns(made)


def fit_codes(df: DataFrame, columns: Sequence[str], unknown: float | None = None, suffix: str = "_code") -> CodeModel:
    """Label / ordinal / one-hot encoder; null counts as an empty name."""
    need(df, *columns)
    row = _first(df, [F.array_sort(F.collect_set(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in columns])
    return CodeModel({c: tuple(v) for c, v in zip(columns, row, strict=True)}, unknown, suffix)


def target_encode(df: DataFrame, column: str, target: str, smoothing: float = 10.0, name: str | None = None, to: DataFrame | None = None) -> DataFrame:
    """(n * mean + s * global) / (n + s) of each category, joined to ``to`` (or
    ``df``); unseen categories get the global mean."""
    total = df.agg(F.avg(target).alias("_global"))
    codes = df.groupBy(F.col(column).alias("_key")).agg(F.count(target).alias("_n"), F.avg(target).alias("_mean"))
    made = (F.col("_n") * F.col("_mean") + smoothing * F.col("_global")) / (F.col("_n") + smoothing)
    out = (df if to is None else to).join(codes, F.col(column).eqNullSafe(F.col("_key")), "left")
    mean = total.first()[0]
    return out.withColumn("_global", F.lit(mean)).withColumn(name or f"{column}_target", F.coalesce(made, F.col("_global"))).drop("_key", "_n", "_mean", "_global")


def frequency_encode(df: DataFrame, column: str, name: str | None = None, to: DataFrame | None = None) -> DataFrame:
    """Share of each category; unseen ones get 0."""
    n = df.count()
    codes = df.groupBy(F.col(column).alias("_key")).agg((F.count(F.lit(1)) / F.lit(float(max(n, 1)))).alias("_share"))
    out = (df if to is None else to).join(codes, F.col(column).eqNullSafe(F.col("_key")), "left")
    return out.withColumn(name or f"{column}_freq", F.coalesce("_share", F.lit(0.0))).drop("_key", "_share")


# ---- missing values ----------------------------------------------------------------


def missing(column: str) -> Column:
    x = F.col(column).cast("double")
    return x.isNull() | F.isnan(x)


@dataclass(frozen=True)
class FillModel:
    values: Mapping[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.when(missing(c), F.lit(float(v))).otherwise(F.col(c).cast("double")) for c, v in self.values.items()})


def imputer(df: DataFrame, columns: Sequence[str], strategy: str = "mean", constant: float = 0.0) -> FillModel:
    """mean, median, mostFrequent (smallest of ties) or constant; NaN and null
    are missing; a column of nothing else gets the constant."""
    need(df, *columns)
    if strategy == "constant":
        return FillModel({c: constant for c in columns})
    value = lambda c: F.when(~missing(c), F.col(c).cast("double"))
    if strategy == "mostFrequent":
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), value(c).alias("v")) for c in columns])).alias("x")).where("x.v is not null")
        top = long.groupBy("x.c", "x.v").agg(F.count(F.lit(1)).alias("n")).groupBy("c").agg(F.max(F.struct("n", (-F.col("v")).alias("minus"))).alias("m"))
        found = {r["c"]: -r["m"]["minus"] for r in top.collect()}
        return FillModel({c: found.get(c, constant) for c in columns})
    if strategy == "median":
        row = [q[0] for q in of_columns(df, {c: value(c) for c in columns}, [0.5]).values()]
    elif strategy == "mean":
        row = _first(df, [F.avg(value(c)) for c in columns])
    else:
        raise InvalidParameter(strategy)
    return FillModel({c: constant if v is None else v for c, v in zip(columns, row, strict=True)})


def missing_indicator(df: DataFrame, columns: Sequence[str], only_missing: bool = False) -> DataFrame:
    """0/1 columns ``column_missing``; ``only_missing`` for those that have any
    (found by one aggregation)."""
    if only_missing:
        row = _first(df, [F.count_if(missing(c)) for c in columns])
        columns = [c for c, n in zip(columns, row, strict=True) if n]
    return df.withColumns({f"{c}_missing": missing(c).cast("int") for c in columns})


def knn_impute(df: DataFrame, columns: Sequence[str], train: DataFrame, k: int = 5, weights: str = "uniform") -> DataFrame:
    """Missing values from the k nearest of ``train``'s rows (by the distance
    over coordinates both have, scaled up for missing ones) that have the
    value; ties go to smaller values, and a value that no such row has is 0.
    Tiles of rows to fill meet tiles of training rows, each pair of tiles leaves
    the k best of each missing value, and the best k of all tiles are used."""
    names = list(columns)
    need(df, *names)
    vector = lambda: F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in names]).alias("_v")
    rows = settle(df.withColumn("_i", F.monotonically_increasing_id()))
    lacking = rows.select(vector(), "_i").where(F.exists("_v", F.isnan))
    fill = tiles(lacking, "_v", "_i", gaps=True)
    ref = tiles(train.select(vector(), F.lit(0).cast("long").alias("_i")), "_v", "_i", gaps=True)
    found = tile_pairs(fill, ref, "_i").mapInArrow(lambda batches: _nearest_values(batches, len(names), k), "_i long, j int, d double, v double")
    best = W.partitionBy("_i", "j").orderBy("d", "v")
    found = found.withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= k)
    w = F.lit(1.0) if weights == "uniform" else 1 / (F.col("d") + 1e-5)
    means = found.groupBy("_i", "j").agg((F.sum(w * F.col("v")) / F.sum(w)).alias("m"))
    filled = means.groupBy(F.col("_i").alias("_f")).agg(F.map_from_entries(F.collect_list(F.struct("j", "m"))).alias("_m"))
    out = rows.join(filled, F.col("_i") == F.col("_f"), "left")
    made = {c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.coalesce(F.try_element_at("_m", F.lit(j)), F.lit(0.0))).otherwise(F.col(c).cast("double")) for j, c in enumerate(names)}
    return out.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in df.columns])


def _nearest_values(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            own = batch.column(1)[r].values.to_numpy()
            x, ref = (np.frombuffer(batch.column(c)[r].as_py()).reshape(-1, width) for c in (2, 5))
            known, found = ~np.isnan(ref), []
            for i, row in zip(own, x, strict=True):
                both = known & ~np.isnan(row)
                n = both.sum(1)
                d2 = (np.where(both, ref - row, 0) ** 2).sum(1)
                d = np.where(n > 0, np.sqrt(d2 * (width - 1) / np.maximum(n, 1)), np.inf)
                for j in np.flatnonzero(np.isnan(row)):
                    ok = np.flatnonzero(known[:, j] & np.isfinite(d))
                    near = ok[np.lexsort((ref[ok, j], d[ok]))[:k]]
                    found += [(int(i), int(j), float(d[m]), float(ref[m, j])) for m in near]
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int32(), pa.float64(), pa.float64()), strict=True)], names=["_i", "j", "d", "v"])


# ---- features ----------------------------------------------------------------------


def polynomial(df: DataFrame, columns: Sequence[str], degree: int = 2, interaction_only: bool = False, bias: bool = True) -> DataFrame:
    """Products up to ``degree``, by degree, then lexicographic; bias first.
    Named like ``poly_a*b``."""
    need(df, *columns)
    pick = combinations if interaction_only else combinations_with_replacement
    made = {"poly_bias": F.lit(1.0)} if bias else {}
    for d in range(1, degree + 1):
        for group in pick(columns, d):
            value = F.lit(1.0)
            for c in group:
                value = value * F.col(c).cast("double")
            made["poly_" + "*".join(group)] = value
    return df.withColumns(made)


def interactions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{a}*{b}": F.col(a) * F.col(b) for a, b in combinations(columns, 2)})


def date_parts(df: DataFrame, column: str) -> DataFrame:
    """year, month, day, weekday (1 = Sunday), is_weekend."""
    x = F.col(column)
    return df.withColumns({f"{column}_year": F.year(x), f"{column}_month": F.month(x), f"{column}_day": F.dayofmonth(x), f"{column}_weekday": F.dayofweek(x), f"{column}_is_weekend": F.dayofweek(x).isin(1, 7).cast("int")})


def _power(x: Column, lam: float, kind: str) -> Column:
    if kind == "box-cox":
        return F.log(x) if abs(lam) < 1e-9 else (F.pow(x, F.lit(lam)) - 1) / lam
    up = F.log1p(x) if abs(lam) < 1e-9 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


@dataclass(frozen=True)
class PowerModel:
    kind: str
    params: Mapping[str, tuple[float, float, float]]  # lambda, mean, std

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (_power(F.col(c).cast("double"), lam, self.kind) - m) / s for c, (lam, m, s) in self.params.items()})


def power_transformer(df: DataFrame, columns: Sequence[str], kind: str = "yeo-johnson", standardize: bool = True) -> PowerModel:
    """Lambda by maximum likelihood on a grid of -2..2 by 0.1, refined by 0.01;
    all candidates of a pass in one aggregation."""
    need(df, *columns)

    def best(grids: dict[str, list[float]]) -> dict[str, float]:
        made = []
        for c, grid in grids.items():
            x = F.col(c).cast("double")
            slope = F.log(x) if kind == "box-cox" else F.signum(x) * F.log1p(F.abs(x))
            made += [F.sum(slope), F.count(x), *[F.var_pop(_power(x, lam, kind)) for lam in grid]]
        row, out, at = _first(df, made), {}, 0
        for c, grid in grids.items():
            jac, n, var = row[at], row[at + 1], row[at + 2 : at + 2 + len(grid)]
            at += 2 + len(grid)
            out[c] = max(zip(grid, var, strict=True), key=lambda g: -n / 2 * math.log(max(g[1], 1e-300)) + (g[0] - 1) * jac)[0]
        return out

    coarse = best({c: [round(-2 + 0.1 * k, 10) for k in range(41)] for c in columns})
    fine = best({c: [round(lam + 0.01 * k, 10) for k in range(-10, 11)] for c, lam in coarse.items()})
    row = _first(df, [f(_power(F.col(c).cast("double"), fine[c], kind)) for c in columns for f in (F.avg, F.stddev_pop)])
    return PowerModel(kind, {c: (fine[c], row[2 * k], row[2 * k + 1] if row[2 * k + 1] > EPS else 1.0) if standardize else (fine[c], 0.0, 1.0) for k, c in enumerate(columns)})


@dataclass(frozen=True)
class BinModel:
    edges: Mapping[str, tuple[float, ...]]
    one_hot: bool = False

    def transform(self, df: DataFrame) -> DataFrame:
        """``column_bin``, or 0/1 columns ``column_bin_i``. Bins are [a, b)."""
        made: dict[str, Column] = {}
        for c, edges in self.edges.items():
            x, code = F.col(c).cast("double"), F.lit(0)
            for k, e in enumerate(edges[1:-1], 1):
                code = F.when(x >= e, k).otherwise(code)
            code = F.when(x.isNotNull(), code)
            made |= {f"{c}_bin_{k}": (code == k).cast("double") for k in range(len(edges) - 1)} if self.one_hot else {f"{c}_bin": code}
        return df.withColumns(made)


def kbins(df: DataFrame, columns: Sequence[str], bins: int = 5, strategy: str = "uniform", one_hot: bool = False) -> BinModel:
    need(df, *columns)
    steps = [k / bins for k in range(bins + 1)]
    if strategy == "uniform":
        row = _first(df, [f(F.col(c).cast("double")) for c in columns for f in (F.min, F.max)])
        return BinModel({c: tuple(row[2 * k] + (row[2 * k + 1] - row[2 * k]) * s for s in steps) for k, c in enumerate(columns)}, one_hot)
    if strategy != "quantile":
        raise InvalidParameter(strategy)
    return BinModel({c: tuple(v) for c, v in of_columns(df, {c: F.col(c) for c in columns}, steps).items()}, one_hot)


# ---- selection and resampling ----------------------------------------------------------


def variance_threshold(df: DataFrame, columns: Sequence[str], threshold: float = 0.0) -> list[str]:
    """Columns whose population variance is above; all, if none is."""
    row = _first(df, [F.var_pop(F.col(c).cast("double")) for c in columns])
    return [c for c, v in zip(columns, row, strict=True) if v is not None and v > threshold] or list(columns)


def select_k_best(df: DataFrame, columns: Sequence[str], target: str | None, k: int, score: str = "anova") -> dict[str, float]:
    """The k columns of the highest F ratio over the classes of ``target`` (all
    columns in one aggregation by class), or of the highest variance."""
    if score == "variance":
        scores = dict(zip(columns, _first(df, [F.var_pop(F.col(c).cast("double")) for c in columns]), strict=True))
    else:
        rows = df.groupBy(target).agg(*[f(F.col(c).cast("double")) for c in columns for f in (F.count, F.avg, F.var_pop)]).collect()
        scores = {}
        for i, c in enumerate(columns):
            n, m, v = (np.array([r[1 + 3 * i + j] for r in rows], float) for j in range(3))
            grand = (n * m).sum() / n.sum()
            between, within = (n * (m - grand) ** 2).sum() / (len(n) - 1), (n * v).sum() / (n.sum() - len(n))
            scores[c] = float(between / within) if within > 0 else math.inf
    return dict(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k])


def eliminate_features(importances: Mapping[str, float], keep: int, step: int = 1) -> list[str]:
    """Recursive elimination by given importances."""
    left = dict(importances)
    while len(left) > keep:
        for c in sorted(left, key=lambda c: (left[c], c))[: min(step, len(left) - keep)]:
            del left[c]
    return list(left)


def recursive_elimination(columns: Sequence[str], keep: int, fit: Callable[[list[str]], Mapping[str, float]], step: int = 1) -> list[str]:
    """The columns left after dropping the ``step`` least important ones again
    and again; ``fit`` gives importances of the columns that are left, from a
    model fitted on them. Ties drop the smaller name first."""
    if keep < 1 or step < 1:
        raise InvalidParameter("keep and step must be positive")
    left = list(columns)
    while len(left) > keep:
        left = eliminate_features(dict(zip(left, map(fit(left).__getitem__, left), strict=True)), max(keep, len(left) - step), step)
    return left


def undersample(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """Every class down to the size of the smallest, by a seeded hash of the
    key: numbers within classes come from range-dealt positions, so a class of
    any size is spread over tasks."""
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    least = min(sizes.values())
    names = sorted(sizes, key=lambda x: (x is None, x))
    before = dict(zip(names, np.cumsum([0, *[sizes[x] for x in names]])[:-1].tolist(), strict=True))
    rows = with_row_id(df.withColumn("_h", F.xxhash64(F.lit(seed), key)), [label, "_h", key], "_row")
    keep = F.lit(False)
    for x, start in before.items():
        keep = keep | (F.col(label).eqNullSafe(F.lit(x)) & (F.col("_row") < start + least))
    return rows.where(keep).drop("_h", "_row")


def smote(df: DataFrame, columns: Sequence[str], label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Rows of ``columns`` and label, with synthetic ones that bring every class
    to the size of the largest. Each row of a class makes its share of what the
    class lacks (the first by a seeded hash one more), each between the row and
    one of its k nearest of the whole class, drawn by hash; a class of one row is
    repeated."""
    names = list(columns)
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # a row for each class
    most = max(sizes.values(), default=0)
    vector = F.array(*[F.col(c).cast("double") for c in names])
    kind = df.schema[label].dataType
    plain = df.select(*[F.col(c).cast("double").alias(c) for c in names], label)
    out = plain
    for cls, n in sizes.items():
        lack = most - n
        if not lack:
            continue
        own = df.where(F.col(label).eqNullSafe(F.lit(cls))).select(vector.alias("_v")).withColumn("_h", F.xxhash64(F.lit(seed), "_v"))
        rows = settle(with_row_id(own, ["_h"], "_id"))
        near = neighbours(rows, "_id", "_v", k=k).groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("distance", "other"))).alias("_near"))
        share = F.lit(lack // n) + (F.col("_id") < lack % n).cast("int")
        made = rows.join(near, "_id", "left").where(share > 0).select("_id", "_v", "_near", F.explode(F.sequence(F.lit(1), share.cast("int"))).alias("_nth"))
        drawn = lambda what: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "_id", "_nth"), F.lit(1 << 30))
        other = F.get("_near", (drawn(1) % F.size("_near")).cast("int"))["other"]
        made = made.select("_v", other.alias("_other"), (drawn(2) / F.lit(float(1 << 30))).alias("_u"))
        made = made.join(rows.select(F.col("_id").alias("_other"), F.col("_v").alias("_to")), "_other", "left")
        point = F.zip_with("_v", F.coalesce("_to", "_v"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        made = made.select(F.transform(point, lambda p: p["a"] + F.col("_u") * (p["b"] - p["a"])).alias("_p"))
        out = out.unionByName(made.select(*[F.col("_p")[i].alias(c) for i, c in enumerate(names)], F.lit(cls).cast(kind).alias(label)))
    return out


# ---- composition -----------------------------------------------------------------------


@dataclass
class Pipeline:
    """Steps are functions (df) -> fitted object with ``transform``."""

    steps: list
    fitted: list = field(default_factory=list)

    def fit(self, df: DataFrame) -> Pipeline:
        self.fitted = []
        for step in self.steps:
            self.fitted.append(step(df))
            df = self.fitted[-1].transform(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if len(self.fitted) != len(self.steps):
            raise NotFitted("call fit first")
        for model in self.fitted:
            df = model.transform(df)
        return df


def column_transformer(df: DataFrame, routes: Sequence[tuple[Sequence[str], object]]) -> DataFrame:
    """Each route's columns through its own fit; other columns are dropped."""
    out, kept = df, []
    for columns, step in routes:
        out = step(out).transform(out)
        kept += list(columns)
    return out.select(*kept)
