"""Whitening of embeddings by a randomised range finder.

Entries are quantised to integers, so sums are exact and every row is centred
exactly, ``n x - S``, before anything is multiplied. With V the covariance
(divisor n) of all rows:

1. A random block Q of ``k + oversample`` orthonormal directions; each power
   pass over all centred rows gives V Q as a total of the tasks' V Q, which is
   orthonormalised into the next Q. In the block, Rayleigh-Ritz (the small
   eigenproblem of Q' V Q) gives eigenvalues and vectors, and V Q their
   residuals V u - e u at no cost.
2. Passes end as soon as the first k residuals are below ``TOLERANCE`` of the
   largest eigenvalue, over the gap to the nearest other eigenvalue. If they
   don't get there in ``PASSES`` passes, as with flat spectra, Q is expanded to
   the full dimension and one more pass makes Rayleigh-Ritz exact.
3. A row's projections over the roots of the eigenvalues are its whitened
   coordinates. One more pass checks the covariance of those against the identity.

A task holds blocks of rows and one d x (k + oversample) total; totals travel in
pieces that tasks add up, so the driver gets one matrix, whatever the number of
rows: work on the driver is bounded by the dimension d (d x d numbers at most).

Defined cases: vectors that are null or empty, hold null or non-finite entries,
or entries that exceed 2**52 when scaled, take no part, nor do those of another
length than most (ties: the longer); repeated rows and ids each count; null ids are
ids like any other; an empty table gives an empty result. Components of no
variance (eigenvalue below d * 1e-13 of the trace) can't be scaled to one and
are left out, so a table of equal vectors gives an empty result, and a table of
fewer different vectors or dimensions than ``k`` fewer components. ``deviation``
is exact, null where it exceeds 64 bits. Signs: the largest entry of a component
(ties: the first) is positive. Extra columns take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize
from .hashing import give_back

COMPONENTS, OVERSAMPLE, PASSES = 32, 8, 6
TOLERANCE = 1e-14
ROWS = 2048
#: Numbers of a matrix that travel together.
PIECE = 1 << 14


@dataclass
class Whitening:
    """``mean`` (whole and fraction), eigenvalues in falling order, components as
    columns, and how it was found."""

    n: int
    whole: np.ndarray
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    passes: int
    expanded: bool
    identity_error: float = 0.0


def quantised(vectors: DataFrame, scale: int, offset: int, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, x array<bigint>) of the sound vectors."""
    c, most = F.col(embedding), float(1 << 52)
    sound = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < most))
    made = F.when(sound, F.transform(c, lambda x: F.floor(x.cast("double") * scale) + F.lit(offset)))
    return vectors.select(F.col(vec_id).alias("vec_id"), made.alias("x")).where("x is not null")


def _blocks(batch: pa.RecordBatch, column: int, d: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, batch.num_rows, ROWS):
        part = batch.column(column).slice(at, ROWS)
        yield at, part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), d)


def _total(rows: DataFrame, work: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], d: int) -> np.ndarray:
    """The sum of ``work`` (float64 or int64) over all blocks of rows: of each
    task in pieces, whose totals are made by tasks again."""

    def pieces(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        flat = total.ravel()
        for k, at in enumerate(range(0, flat.size, PIECE)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([flat[at : at + PIECE].tobytes()], pa.binary())], names=["piece", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in _blocks(batch, 0, d):
                made = work(x)
                total = made if total is None else total + made
        if total is not None:
            yield from pieces(total)
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(data, kind)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["piece", "data"])

    kind = work(np.zeros((0, d), np.int64)).dtype
    some = rows.select("x").mapInArrow(run, "piece int, data binary")
    parts = -(-shape[0] * shape[1] // PIECE)
    out = np.zeros((parts, PIECE), kind).ravel()
    for r in some.repartition(parts, "piece").mapInArrow(add, "piece int, data binary").collect():  # one matrix
        own = np.frombuffer(r["data"], kind)
        out[r["piece"] * PIECE :][: len(own)] = own
    return out[: shape[0] * shape[1]].reshape(shape)


def _centred(whole: np.ndarray, rest: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: (x - whole) - rest


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues in falling order, vectors, and lengths of the residuals."""
    small = q.T @ vq
    values, w = np.linalg.eigh((small + small.T) / 2)
    values, w = values[::-1], w[:, ::-1]
    u = q @ w
    return values, u, np.linalg.norm(vq @ w - u * values, axis=0)


def fit(rows: DataFrame, k: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES, seed: int = 13) -> Whitening | None:
    """Of ``quantised`` rows of one length; None of none."""
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first["d"]
    half = 26

    def sums(x: np.ndarray) -> np.ndarray:
        return np.stack([(x >> half).sum(0), (x & ((1 << half) - 1)).sum(0), np.full(d, len(x), np.int64)])

    high, low, n = _total(rows, sums, (3, d), d).tolist()
    n, exact = n[0], [(a << half) + b for a, b in zip(high, low, strict=True)]
    whole = np.array([s // n for s in exact], np.int64)
    rest = np.array([(s % n) / n for s in exact])
    centre = _centred(whole, rest)

    def product(q: np.ndarray) -> tuple[np.ndarray, float]:
        """V Q, and V's trace."""
        columns = q.shape[1]

        def work(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            return np.hstack([c.T @ (c @ q), (c * c).sum(0)[:, None]])

        got = _total(rows, work, (d, columns + 1), d) / n
        return got[:, :-1], float(got[:, -1].sum())

    rng = np.random.default_rng(seed)
    size = min(d, k + oversample)
    q = np.linalg.qr(rng.standard_normal((d, size)))[0]
    done = expanded = False
    for made in range(1, passes + 1):
        vq, trace = product(q)
        values, u, residual = _ritz(q, vq)
        if size == d or not trace:
            done = True
        else:
            # the vectors' own errors are residuals over gaps
            gap = np.abs(np.diff(values))
            near = np.minimum(np.append(np.inf, gap[: k - 1]), gap[:k])
            done = bool((residual[:k] <= np.maximum(TOLERANCE * values[0], 1e-11 * near)).all())
        if done:
            break
        q = np.linalg.qr(vq)[0]
    if not done:
        made, expanded = made + 1, True
        q = np.linalg.qr(np.hstack([q, rng.standard_normal((d, d - size))]))[0]
        vq, trace = product(q)
        values, u, residual = _ritz(q, vq)
    some = np.flatnonzero(values > d * 1e-13 * trace)[:k] if trace else np.empty(0, np.int64)
    values, u = values[some], u[:, some]
    u = u * np.sign(u[np.abs(u).argmax(0), np.arange(len(some))])
    out = Whitening(n, whole, exact, values, u, trace, made, expanded)
    if len(some):
        scaled = u / np.sqrt(values)

        def covariance(x: np.ndarray) -> np.ndarray:
            w = centre(x) @ scaled
            return w.T @ w

        got = _total(rows, covariance, (len(some), len(some)), d) / n
        out.identity_error = float(np.abs(got - np.eye(len(some))).max())
    return out


def deviations(x: np.ndarray, whole: np.ndarray, sums: list[int], n: int) -> list[int | None]:
    """The exact sum of (n x - S)^2 of each row; null beyond 64 bits."""
    y, rest = x - whole, [s - n * m for s, m in zip(sums, whole.tolist(), strict=True)]  # 0 <= rest < n
    most = n * (int(np.abs(y).max(initial=0)) + 1)
    if x.shape[1] * most * most < 1 << 63:
        c = n * y - np.array(rest, np.int64)
        return (c * c).sum(1).tolist()
    exact = (sum((n * a - b) ** 2 for a, b in zip(row, rest, strict=True)) for row in y.tolist())
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, k: int = COMPONENTS, scale: int = 64, offset: int = 1_000_000, vec_id: str = "vec_id", embedding: str = "embedding", oversample: int = OVERSAMPLE, passes: int = PASSES) -> DataFrame:
    """(vec_id, component from 1, n, deviation, whitened, explained,
    identity_error) for each sound vector and component."""
    kind = vectors.schema[vec_id].dataType
    schema = T.StructType([T.StructField("vec_id", kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]])
    rows = quantised(vectors, scale, offset, vec_id, embedding)
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d = lengths["d"]
    rows = materialize(rows.where(F.size("x") == d))
    model = fit(rows, k, oversample, passes)
    if not len(model.values):
        discard(rows)
        return vectors.sparkSession.createDataFrame([], schema)
    scaled, share = model.components / np.sqrt(model.values), model.values / model.trace
    centre = _centred(model.whole, np.array([(s % model.n) / model.n for s in model.sums]))
    n, whole, sums, error, many = model.n, model.whole, model.sums, model.identity_error, len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _blocks(batch, 1, d):
                w, size = centre(x) @ scaled, len(x)
                ids = batch.column(0).slice(at, size).take(pa.array(np.repeat(np.arange(size), many)))
                columns = [ids, pa.array(np.tile(np.arange(1, many + 1), size), pa.int32()), pa.array(np.full(size * many, n), pa.int64())]
                columns.append(pa.array(deviations(x, whole, sums, n), pa.int64()).take(pa.array(np.repeat(np.arange(size), many))))
                columns += [pa.array(w.ravel()), pa.array(np.tile(share, size)), pa.array(np.full(size * many, error))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        give_back()

    return rows.mapInArrow(run, schema)
