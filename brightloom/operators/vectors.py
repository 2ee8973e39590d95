"""Vector store, exact search, clustering, decomposition, outliers.

Pairwise operators that are quadratic by nature cut the rows into tiles of
bounded size and compare pairs of tiles by matrix products, so that any number
of rows is spread over tasks and none is held by the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..checkpoints import settle
from ..errors import EmptyInput, InvalidParameter
from ..functions import statistics as st
from ..functions.quantiles import of_columns
from .frame import need, with_row_id

TILE = 2048
#: Small factors that a task of a tree takes together.
FAN = 16
#: Pivots of an index, the rows they are chosen from, and bytes of its summaries.
PIVOTS, PIVOT_SAMPLE, SUMMARY_BYTES = 256, 4096, 64 << 20
#: Tiles meet in cells of blocks by blocks: blocks at least, and bytes of vectors in one.
BLOCKS, BLOCK_BYTES = 6, 64 << 20
#: Rows of a tile that meet another at a time.
STRIP = 128


# ---- vector store ----------------------------------------------------------------


class VectorStore:
    """(id, vector, metadata) as an immutable DataFrame; each method returns a
    new store. The last entry of an id wins."""

    def __init__(self, df: DataFrame):
        need(df, "id", "vector")
        self.df = df

    def add(self, rows: DataFrame) -> VectorStore:
        """Insert or replace by id: an anti-join, so old vectors aren't sorted."""
        return VectorStore(self.df.join(rows.select("id"), "id", "left_anti").unionByName(rows, allowMissingColumns=True))

    add_batch = add

    def remove(self, *ids: object) -> VectorStore:
        return VectorStore(self.df.where(~F.col("id").isin(*ids)))

    def clear(self) -> VectorStore:
        return VectorStore(self.df.limit(0))

    def contains(self, id_: object) -> bool:
        return not self.df.where(F.col("id") == F.lit(id_)).isEmpty()

    def get(self, id_: object) -> dict | None:
        row = self.df.where(F.col("id") == F.lit(id_)).first()
        return row.asDict() if row else None

    def search(self, query: Sequence[float], k: int = 5, metric: str = "cosine") -> DataFrame:
        """The k best of all vectors as a bounded top-n; L2 ascending."""
        score = similarity(F.col("vector"), F.array(*[F.lit(float(x)) for x in query]), metric)
        order = F.asc("score") if metric == "l2" else F.desc("score")
        return self.df.withColumn("score", score).orderBy(order, "id").limit(k)


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    if metric == "dot":
        return st.dot(a, b)
    if metric == "l2":
        gap = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
        return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, v: s + v))
    if metric == "cosine":
        size = st.norm(a) * st.norm(b)
        return F.when(size <= 1e-12, 0.0).otherwise(st.dot(a, b) / size)
    raise InvalidParameter(metric)


# ---- k-means and PCA -------------------------------------------------------------


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.nan_to_num(np.asarray(v, float)) for v in column]) if len(column) else np.empty((0, 0))


def assign(df: DataFrame, vector: str, centers: np.ndarray, name: str = "cluster") -> DataFrame:
    """The nearest centre of each row, and its squared distance in ``cost``."""

    @F.pandas_udf("struct<k:int,d:double>")
    def run(column: pd.Series) -> pd.DataFrame:
        x = _matrix(column)
        d = (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)
        k = d.argmin(1)
        return pd.DataFrame({"k": k.astype("int32"), "d": ((x - centers[k]) ** 2).sum(1)})

    return df.withColumn("_a", run(vector)).withColumns({name: F.col("_a.k"), "cost": F.col("_a.d")}).drop("_a")


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 42, rounds: int = 300, tol: float = 1e-4, init: np.ndarray | None = None) -> np.ndarray:
    """Lloyd's rounds from given or k-means++ centres (seeded on a bounded
    sample by hash); each round ships k partial sums per task."""
    if init is None:
        some = [r[0] for r in df.select(vector).orderBy(F.xxhash64(F.lit(seed), vector)).limit(2000).collect()]
        if len(some) < k:
            raise EmptyInput(f"fewer than {k} rows")
        x, rng = _matrix(pd.Series(some)), np.random.default_rng(seed)
        picks = [int(rng.integers(len(x)))]
        while len(picks) < k:
            d = ((x[:, None, :] - x[picks]) ** 2).sum(2).min(1)
            picks.append(int(rng.choice(len(x), p=d / d.sum())) if d.sum() else len(picks))
        init = x[picks]
    centers = np.array(init, float)

    for _ in range(rounds):

        def partial(frames, centers=centers):
            sums, n = np.zeros_like(centers), np.zeros(len(centers))
            for pdf in frames:
                if len(pdf):
                    x = _matrix(pdf[vector])
                    d = -2 * x @ centers.T + (centers * centers).sum(1)
                    a = d.argmin(1)
                    np.add.at(sums, a, x)
                    n += np.bincount(a, minlength=len(centers))
            yield pd.DataFrame({"k": np.arange(len(centers)), "n": n, "s": list(sums)})

        rows = df.select(vector).mapInPandas(partial, "k int, n double, s array<double>").groupBy("k").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(centers.shape[1])]).collect()
        new = centers.copy()
        for r in rows:
            if r["n"]:
                new[r["k"]] = np.array(r[2:]) / r["n"]
        shift = np.sqrt(((new - centers) ** 2).sum(1)).max()
        centers = new
        if shift < tol:
            break
    return centers


def covariance(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and sample covariance, from one sum of outer products per
    task."""

    def partial(frames):
        n, s, ss = 0, None, None
        for pdf in frames:
            if len(pdf):
                x = _matrix(pdf[vector])
                n, s, ss = n + len(x), x.sum(0) if s is None else s + x.sum(0), x.T @ x if ss is None else ss + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s], "ss": [ss.ravel()]})

    parts = df.select(vector).mapInPandas(partial, "n long, s array<double>, ss array<double>")
    flat = parts.select("n", F.posexplode(F.concat("s", "ss"))).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("v")).orderBy("pos").collect()
    if not flat:
        raise EmptyInput("no rows")
    values = np.array([r["v"] for r in flat])
    n, d = flat[0]["n"], int((np.sqrt(1 + 4 * len(values)) - 1) / 2 + 0.5)
    mean = values[:d] / n
    return n, mean, (values[d:].reshape(d, d) - n * np.outer(mean, mean)) / max(n - 1, 1)


def pca(df: DataFrame, vector: str, components: int, widest: int = 1024) -> dict[str, np.ndarray]:
    """Components (rows, largest entry positive), explained variances and their
    ratios among the kept ones. Vectors up to ``widest`` long by their covariance,
    the only thing that leaves the executors; wider ones by ``row_svd``."""
    first = df.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    if first and first[0] > widest:
        mean, n = column_means(df, vector)
        values, rows = row_svd(df, vector, components, power=6, center=mean)
        values = values**2 / max(n - 1, 1)
    else:
        _, mean, cov = covariance(df, vector)
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values)[:components]
        values, rows = values[order], vectors[:, order].T
    rows = rows * np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(1)])[:, None]
    kept = np.maximum(values, 0)
    return {"mean": mean, "components": rows, "variance": kept, "ratio": kept / (kept.sum() or 1)}


def pca_transform(df: DataFrame, vector: str, model: dict[str, np.ndarray], name: str = "scores") -> DataFrame:
    mean, rows = model["mean"], model["components"]

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series(list((_matrix(column) - mean) @ rows.T))

    return df.withColumn(name, run(vector))


def randomized_svd(x: np.ndarray, rank: int, oversample: int = 10, power: int = 2, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Halko, Martinsson and Tropp's range finder for a matrix on the driver."""
    q = np.linalg.qr(x @ np.random.default_rng(seed).standard_normal((x.shape[1], min(rank + oversample, min(x.shape)))))[0]
    for _ in range(power):
        q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
    u, s, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    return (q @ u)[:, :rank], s[:rank], vt[:rank]


def column_means(df: DataFrame, vector: str) -> tuple[np.ndarray, int]:
    rows = df.where(F.col(vector).isNotNull()).select(F.posexplode(vector).alias("p", "v")).groupBy("p").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n")).orderBy("p").collect()
    if not rows:
        raise EmptyInput("no rows")
    return np.array([r["m"] for r in rows]), rows[0]["n"]


def _summed(rows: DataFrame, vector: str, work, shape: tuple[int, int]) -> np.ndarray:
    """The sum of ``work`` (a matrix of a block of rows) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for whole in batches:
            for at in range(0, whole.num_rows, TILE):
                total = total + work(_matrix(whole.column(0).slice(at, TILE).to_pandas()))
        yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["row", "v"])

    parts = rows.select(vector).mapInArrow(run, "row int, v array<double>").select("row", F.posexplode("v").alias("p", "v"))
    found = parts.groupBy("row", "p").agg(F.sum("v").alias("v")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("p", "v"))).alias("v")).orderBy("row").collect()
    return np.array([[x["v"] for x in r["v"]] for r in found]) if found else np.zeros(shape)


def _tall_r(rows: DataFrame, vector: str, right: np.ndarray, center: np.ndarray) -> np.ndarray:
    """R of the QR of (rows - center) @ right: each task reduces its blocks to one
    small factor, and a tree of tasks stacks and reduces those, so no product
    of the whole is ever squared."""
    width = right.shape[1]

    def reduced(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
        r = None
        for block in blocks:
            r = np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")
        return r

    def out(r: np.ndarray | None, part: int) -> Iterator[pa.RecordBatch]:
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], names=["part", "r"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = ((_matrix(b.column(0).slice(at, TILE).to_pandas()) - center) @ right for b in batches for at in range(0, b.num_rows, TILE))
        yield from out(reduced(blocks), TaskContext.get().partitionId())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts = 0, []
        for b in batches:
            for part, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                number = part // FAN
                parts.append(np.frombuffer(r).reshape(-1, width))
        yield from out(reduced(iter(parts)), number)

    found, n = rows.select(vector).mapInArrow(first, "part long, r binary"), max(rows.rdd.getNumPartitions(), 1)
    while n > 1:
        n = -(-n // FAN)
        # each part's factors meet in one task, numbered by what they are called there
        found = found.repartitionByRange(n, F.col("part")) if n > 1 else found.coalesce(1)
        found = found.mapInArrow(merge, "part long, r binary")
    rs = [np.frombuffer(r["r"]).reshape(-1, width) for r in found.collect()]  # FAN small factors at most
    r = np.linalg.qr(np.vstack(rs), mode="r") if rs else np.zeros((0, width))
    return r


def row_svd(df: DataFrame, vector: str, rank: int, oversample: int = 10, power: int = 2, seed: int = 0, center: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right singular vectors (as rows) of the matrix whose
    rows are the vectors: a randomised range finder on the narrow side. Power
    steps multiply by the matrix and its transpose in one pass over the rows,
    without either; the last pass takes the QR of the rows' projections by
    tall-skinny factors, whose small SVD ends it. Only d x (rank + oversample)
    numbers reach the driver."""
    rows = df.where(F.col(vector).isNotNull())
    head = rows.select(F.size(vector)).first()
    if head is None:
        raise EmptyInput("no rows")
    d = head[0]
    size = min(d, rank + oversample)
    center = np.zeros(d) if center is None else center
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, size)))[0]
    for _ in range(power + 1 if size < d else 0):
        q = np.linalg.qr(_summed(rows, vector, lambda x, q=q: (x - center).T @ ((x - center) @ q), (d, size)))[0]
    _, s, vt = np.linalg.svd(_tall_r(rows, vector, q, center), full_matrices=False)
    return s[:rank], (vt @ q.T)[:rank]


# ---- pairs within reach -------------------------------------------------------------


def tiles(df: DataFrame, vector: str, *others: str, gaps: bool = False) -> DataFrame:
    """(tile, others as arrays, data): rows in tiles of at most ``TILE``,
    numbered from 0; ``data`` is their matrix of doubles, NaN as 0 unless ``gaps`` are wanted."""
    matrix = (lambda column: np.stack([np.asarray(x, float) for x in column])) if gaps else _matrix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TILE):
                batch = whole.slice(at, TILE)
                ends = pa.array([0, batch.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.concat_arrays([c])) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([matrix(batch.column(0).to_pandas()).tobytes()], pa.binary())], names=[*others, "data"])

    kinds = [f"`{c}` array<{df.schema[c].dataType.simpleString()}>" for c in others]
    rows = df.where(F.col(vector).isNotNull()).select(vector, *others).mapInArrow(run, ", ".join([*kinds, "data binary"]))
    return with_row_id(rows.withColumn("_k", F.monotonically_increasing_id()), "_k", "tile").drop("_k")


def tile_pairs(some: DataFrame, others: DataFrame, column: str) -> DataFrame:
    """(tile, own, data, other_tile, other, other_data): each tile of one frame
    with every tile of the other, by an equi-join on the tile's number. All
    pairs are the task itself; a task holds one pair at a time, whatever the
    number of rows."""
    n = others.count()
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(n - 1)) if n else F.array().cast("array<long>")
    sent = some.select("tile", F.col(column).alias("own"), "data", F.explode(numbers).alias("other_tile"))
    return sent.join(others.select(F.col("tile").alias("other_tile"), F.col(column).alias("other"), F.col("data").alias("other_data")), "other_tile").select("tile", "own", "data", "other_tile", "other", "other_data")


def _squares(data: bytes, n: int, other_data: bytes, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Both matrices, the squared distances by one matrix product, and a bound
    of their rounding."""
    y, x = np.frombuffer(data).reshape(n, -1), np.frombuffer(other_data).reshape(m, -1)
    sy, sx = (y * y).sum(1), (x * x).sum(1)
    return y, x, np.maximum(sy[:, None] - 2 * y @ x.T + sx, 0), 1e-12 * float(sy.max() + sx.max())


def _meet(held: DataFrame, sent: DataFrame, work, schema: str, last=None, parts: int | None = None) -> DataFrame:
    """What ``work(state, own, others)`` yields for each row of ``sent`` (a, b,
    tile, keys, data, ..., partners): ``others`` are the tiles of ``held`` (a, b,
    tile, keys, data, ...) in the same cell (a, b) that are its partners, or all
    if those are null; ``state`` is a dict that lasts as long as the cell. A task
    keeps the held tiles of one cell, which are a block, and tiles sent there
    pass by, so a tile is shuffled once for each block, not for each partner.
    ``last(state)`` yields what a cell leaves; cells go to ``parts`` tasks, or as
    many as any shuffle has."""
    names = [c for c in held.columns if c not in ("a", "b")]
    none = F.lit(None).cast("array<bigint>").alias("partners")
    both = held.select("a", "b", F.lit(0).alias("side"), *names, none).unionByName(sent.select("a", "b", F.lit(1).alias("side"), *names, "partners"))
    dealt = both.repartition(*([parts] if parts else []), "a", "b").sortWithinPartitions("a", "b", "side", "tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, near, state = None, {}, {}
        for batch in batches:
            for r in range(batch.num_rows):
                a, b, side, tile, *own = (c[r] for c in batch.columns)
                if (a.as_py(), b.as_py()) != cell:
                    if last and cell:
                        yield from last(state)
                    cell, near, state = (a.as_py(), b.as_py()), {}, {}
                row = [tile.as_py(), own[0].values, own[1].as_py(), *(v.as_py() for v in own[2:-1])]
                if not side.as_py():
                    near[row[0]] = row
                else:
                    chosen = own[-1].as_py()
                    yield from work(state, row, [near[k] for k in (near if chosen is None else chosen)])
        if last and cell:
            yield from last(state)

    return dealt.mapInArrow(run, schema)


def _blocks(n_bytes: int) -> int:
    return max(BLOCKS, -(-n_bytes // BLOCK_BYTES))


class PivotIndex:
    """Vectors in tiles of near ones, with what rules pairs of tiles out.

    Pivots are spread over a bounded sample, each farthest from those before. A
    row goes to its nearest pivot's cell, rows of a cell are in the order of their
    distance from it, and are cut into tiles, so a hot cell is many tiles. A tile
    knows its rows' least and greatest distance from every pivot: by the
    triangle inequality rows of two tiles are at least as far apart as their
    ranges are, for any pivot. The summaries of all tiles are broadcast; pivots are
    as few as keep them under ``SUMMARY_BYTES``."""

    def __init__(self, df: DataFrame, key: str, vector: str):
        self.kind, self.size = df.schema[key].dataType.simpleString(), TILE
        size = self.size
        rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"))
        n = rows.count()
        self.one = n <= size
        pivots = np.zeros((0, 0))
        if self.one:
            rows = rows.coalesce(1)
        else:
            some = rows.select("v").orderBy(F.xxhash64("v")).limit(PIVOT_SAMPLE).collect()
            pivots = spread(_matrix(pd.Series([r[0] for r in some])), max(2, min(PIVOTS, 2 * n // size, SUMMARY_BYTES * size // (64 * n))))
            cells = rows.mapInArrow(lambda batches: _in_cells(batches, pivots, size), f"k {self.kind}, v array<double>, cell int, far double")
            rows = cells.repartitionByRange("cell", "far").sortWithinPartitions("cell", "far")
        tiles = rows.mapInArrow(lambda batches: _cut(batches, pivots, size), f"keys array<{self.kind}>, data binary, low binary, high binary, norm double")
        self.tiles = tiles.withColumn("tile", F.lit(0).cast("long") if self.one else F.monotonically_increasing_id())
        if not self.one:
            self.tiles = settle(self.tiles)
            found = self.tiles.select("tile", "low", "high", "norm", F.length("data").alias("bytes")).orderBy("tile").collect()
            few = max(1, SUMMARY_BYTES // (16 * len(found)))
            low, high = (np.stack([np.frombuffer(r[c])[:few] for r in found]) for c in ("low", "high"))
            self.numbers = [r["tile"] for r in found]
            self.blocks = _blocks(sum(r["bytes"] for r in found))
            self.slack = 1e-7 * max(r["norm"] for r in found)  # of distances by matrix products
            self.summary = df.sparkSession.sparkContext.broadcast((np.array(self.numbers), low, high))

    def partners(self, reach: DataFrame | float, itself: bool) -> DataFrame:
        """(tile, other_tile) of the pairs of which some rows may be within
        ``reach``: one number, or (tile, reach) with one for each tile; and
        their blocks (a, b)."""
        summary, slack, blocks = self.summary, self.slack, self.blocks

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers, low, high = summary.value
            block = (np.arange(len(numbers)) * blocks // len(numbers)).astype("int32")
            for batch in batches:
                for tile, far in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    at = int(np.searchsorted(numbers, tile))
                    gap = np.maximum(low - high[at], low[at] - high).max(1)
                    near = (gap <= far + slack) & (itself | (numbers != tile))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(near.sum()), tile)), pa.array(numbers[near]), pa.array(np.full(int(near.sum()), block[at])), pa.array(block[near])], names=["tile", "other_tile", "a", "b"])

        if not isinstance(reach, DataFrame):
            reach = self.tiles.select("tile", F.lit(float(reach)).alias("reach"))
        return reach.select("tile", "reach").mapInArrow(run, "tile long, other_tile long, a int, b int")

    def halves(self, reach: float) -> DataFrame:
        """``partners`` with each pair of tiles once, in cells of smaller blocks: as
        a tile then goes to half as many, they shuffle no more than ``partners``."""
        self.blocks = min(2 * self.blocks - 1, len(self.numbers))
        return self.partners(reach, True).where("tile <= other_tile")

    def meet(self, partners: DataFrame | None, work, schema: str, *more: str, last=None, parts: int | None = None) -> DataFrame:
        """``_meet`` of partners, with columns of the tiles; of the one tile
        with itself, if there is one."""
        tiles = self.tiles.select("tile", "keys", "data", *more)
        if self.one:
            held = tiles.select(F.lit(0).alias("a"), F.lit(0).alias("b"), "*")
            return _meet(held, held.withColumn("partners", F.lit(None).cast("array<bigint>")), work, schema, last, parts)
        sent = partners.groupBy("tile", "a", "b").agg(F.sort_array(F.collect_list("other_tile")).alias("partners"))
        held = partners.select(F.col("other_tile").alias("tile"), "a", "b").distinct()
        return _meet(tiles.join(held, "tile"), tiles.join(sent, "tile"), work, schema, last, parts)

    def with_column(self, name: str, values: DataFrame) -> None:
        """Adds a column of arrays to the tiles, from rows (tile, at, value); what
        a tile's row has none of is null."""
        lists = values.groupBy("tile").agg(F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("m"))
        joined = self.tiles.drop(name).join(lists, "tile", "left")
        at = F.sequence(F.lit(0), F.size("keys") - 1)
        self.tiles = settle(joined.withColumn(name, F.transform(at, lambda i: F.try_element_at("m", i))).drop("m"))


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` rows of the sample, each the farthest from those before, in
    the order of a chain from each to the nearest left: near cells have near
    numbers, and small ones share a tile."""
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    left, chain = sample[chosen], []
    at = left[0]
    while len(left):
        k = int(((left - at) ** 2).sum(1).argmin())
        at = left[k]
        chain.append(at)
        left = np.delete(left, k, 0)
    return np.stack(chain)


def _from_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1), 0))


def _in_cells(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, size):
            batch = whole.slice(at, size)
            x = _matrix(batch.column(1).to_pandas())
            d = _from_pivots(x, pivots)
            cell = d.argmin(1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(x)), cell])], names=["k", "v", "cell", "far"])


def _cut(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Tiles of at most ``most`` rows, cut where a cell ends if they aren't small."""

    def tile(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        x = _matrix(rows.column("v").to_pandas())
        keys = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), rows.column("k").combine_chunks())
        d = _from_pivots(x, pivots) if len(pivots) else np.zeros((len(x), 0))
        made = [keys, pa.array([x.tobytes()], pa.binary()), *[pa.array([v.tobytes()], pa.binary()) for v in (d.min(0), d.max(0))], pa.array([float(np.sqrt((x * x).sum(1).max()))])]
        return pa.RecordBatch.from_arrays(made, names=["keys", "data", "low", "high", "norm"])

    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        cells = batch.column(2).to_numpy() if batch.num_columns > 2 else np.zeros(batch.num_rows, np.int32)
        edges = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for s, e in zip(edges, edges[1:], strict=False):
            if held and size >= most // 4 and cells[s] != last:
                yield tile(held)
                held, size = [], 0
            last = cells[s]
            while s < e:
                part = batch.slice(s, min(e - s, most - size))
                held.append(part)
                size, s = size + part.num_rows, s + part.num_rows
                if size == most:
                    yield tile(held)
                    held, size = [], 0
    if held:
        yield tile(held)


class _Pair:
    """The rows of two tiles with their squared distances; rows of one key are
    infinitely far apart."""

    def __init__(self, own: list, other: list):
        self.own, others = own[1], other[1]
        y, x, d2, self.slack = _squares(own[2], len(self.own), other[2], len(others))
        self.order = pc.array_sort_indices(others).to_numpy()  # ties go to smaller keys
        self.others, self.y, self.x, self.d2 = others.take(pa.array(self.order)), y, x[self.order], d2[:, self.order]
        code = {v: i for i, v in enumerate(dict.fromkeys([*self.own.to_pylist(), *self.others.to_pylist()]))}
        mine, theirs = (np.array([code[v] for v in c.to_pylist()]) for c in (self.own, self.others))
        self.d2[mine[:, None] == theirs] = np.inf

    def within(self, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and exact distances of pairs up to the squared limits, or
        a little above."""
        row, col = np.nonzero((self.d2 <= limit[:, None] + self.slack) & np.isfinite(self.d2))
        d = np.empty(len(row))
        for at in range(0, len(row), 1 << 16):
            part = slice(at, at + (1 << 16))
            d[part] = np.sqrt(((self.y[row[part]] - self.x[col[part]]) ** 2).sum(1))
        return row, col, d


def neighbours(df: DataFrame, key: str, vector: str, k: int | None = None, radius: float | None = None) -> DataFrame:
    """(key, other, distance): the k nearest others, or all within ``radius``
    (rows of its own key excluded). Ties to smaller keys, null keys last; null
    vectors take no part. For the k nearest, each tile first finds them within
    itself, which bounds how far they are; only tiles that may be as near are
    compared with it, and leave each row's k best."""
    index = PivotIndex(df, key, vector)
    kind = index.kind

    def found(pair: _Pair, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if k is None:
            row, col, d = pair.within(np.full(len(pair.own), float(radius) ** 2))
            return row[d <= radius], col[d <= radius], d[d <= radius]
        limit, far = kth**2 * (1 + 1e-12), np.flatnonzero(np.isinf(kth))
        if len(far) and k < len(pair.others):
            limit[far] = np.partition(pair.d2[far], k - 1, axis=1)[:, k - 1]
        row, col, d = pair.within(limit)
        return best(row, col, d)

    def best(row: np.ndarray, col: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        by = np.lexsort((col, d, row))
        row, col, d = row[by], col[by], d[by]
        ok = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[ok], col[ok], d[ok]

    def out(tile: int, own: pa.Array, row: np.ndarray, others: pa.Array, d: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(row), tile, np.int64)), pa.array(row, pa.int32()), own.take(pa.array(row)), others, pa.array(d)], names=["tile", "at", key, "other", "distance"])

    schema = f"tile long, at int, `{key}` {kind}, other {kind}, distance double"

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                own = [batch.column(0)[r].as_py(), batch.column(1)[r].values, batch.column(2)[r].as_py()]
                pair = _Pair(own, own)
                row, col, d = found(pair, np.full(len(own[1]), np.inf))
                yield out(own[0], own[1], row, pair.others.take(pa.array(col)), d)

    def across(state: dict, own: list, others: list) -> Iterator[pa.RecordBatch]:
        n = len(own[1])
        if k is None:
            for other in others:
                pair = _Pair(own, other)
                row, col, d = found(pair, np.full(n, np.inf))
                yield out(own[0], own[1], row, pair.others.take(pa.array(col)), d)
            return
        kth = np.array([np.inf if v is None else v for v in own[3]])
        row, d, names = np.zeros(0, np.int64), np.zeros(0), own[1].slice(0, 0)
        for other in others:  # each row's k best of the block, which bound what comes
            pair = _Pair(own, other)
            more, col, far = found(pair, kth)
            if not len(more):
                continue
            row, d, names = np.concatenate([row, more]), np.concatenate([d, far]), pa.concat_arrays([names, pair.others.take(pa.array(col))])
            rank = np.empty(len(names), np.int64)
            rank[pc.array_sort_indices(names).to_numpy()] = np.arange(len(names))  # ties go to smaller keys
            row, rank, d = best(row, rank, d)
            names = names.take(pc.array_sort_indices(names)).take(pa.array(rank))
            full = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == k - 1)
            kth[row[full]] = np.minimum(kth[row[full]], d[full])
        yield out(own[0], own[1], row, names, d)

    tiles = index.tiles.select("tile", "keys", "data")
    if k is None:
        if index.one:
            return tiles.mapInArrow(inside, schema).select(key, "other", "distance")
        return index.meet(index.partners(radius, True), across, schema).select(key, "other", "distance")
    nearest = lambda rows: rows.withColumn("_nth", F.row_number().over(W.partitionBy("tile", "at").orderBy("distance", F.asc_nulls_last("other")))).where(F.col("_nth") <= k)
    own = tiles.mapInArrow(inside, schema)
    if index.one:
        return nearest(own).select(key, "other", "distance")
    own = settle(own)
    index.with_column("kth", own.groupBy("tile", "at").agg(F.when(F.count(F.lit(1)) == k, F.max("distance")).alias("value")))
    far = F.aggregate("kth", F.lit(0.0), lambda s, d: F.greatest(s, F.coalesce(d, F.lit(float("inf")))))
    partners = settle(index.partners(index.tiles.select("tile", far.alias("reach")), False))
    return nearest(own.unionByName(index.meet(partners, across, schema, "kth"))).select(key, "other", "distance")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``links`` (a, b) is
    linked with, by smallest labels of neighbours and pointer jumping."""
    links = settle(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = links.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    while True:
        low = links.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("low"))
        new = labels.join(low, F.col("node") == F.col("a"), "left").select("node", "root", F.least("root", "low").alias("new"))
        up = new.select(F.col("node").alias("p"), F.col("new").alias("up"))
        new = settle(new.join(up, F.col("new") == F.col("p"), "left").select("node", "root", F.least("new", F.coalesce("up", "new")).alias("new")))
        if new.where("new <> root").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", F.col("new").alias("root"))


class _Rows:
    """Rows of a tile by their places there; ``first`` of them come first."""

    def __init__(self, tile: int, keys: pa.Array, data: bytes, at: Sequence[int], first: int):
        self.tile, self.at, self.first, self.keys = tile, np.array(at), first, keys.to_pylist()
        self.x = np.frombuffer(data).reshape(len(self.at), -1)
        self.squares = (self.x * self.x).sum(1)
        self.most, self.different, self.sides = float(self.squares.max()), set(self.keys), {}

    def side(self, kind: type, left: bool) -> np.ndarray:
        """Matrices of which a left row times a right one is half their squared
        distance below 0."""
        if (kind, left) not in self.sides:
            half, one = -self.squares / 2, np.ones(len(self.x))
            self.sides[kind, left] = np.column_stack([self.x, *((half, one) if left else (one, half))]).astype(kind)
        return self.sides[kind, left]


def _within(own: _Rows, other: _Rows, eps: float, both_first: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``own`` and of ``other``, a few at a time, of the pairs within
    ``eps`` with a first row; without those of two first rows unless
    ``both_first``; of a tile with itself, those with a first row of ``own``. Rows
    of one key are no pair.

    Products are in single precision if that rounds by a small part of ``eps``,
    and pairs so near the limit that rounding may matter are measured one by one."""
    if not eps >= 0:
        return
    rounding = lambda kind: 4 * (own.x.shape[1] + 8) * float(np.finfo(kind).eps) * (own.most + other.most)
    kind = np.float32 if eps * eps > 1e-30 and own.most + other.most < 1e30 and rounding(np.float32) <= eps * eps / 64 else np.float64
    limit, slack = -eps * eps / 2, rounding(kind)
    codes = {k: i for i, k in enumerate(own.different & other.different)}
    if codes:
        mine, theirs = np.array([codes.get(k, -1) for k in own.keys]), np.array([codes.get(k, -2) for k in other.keys])
    n, m = len(own.x), len(other.x)
    parts = [(0, own.first, 0 if both_first else other.first, m), (own.first, n, 0, other.first)]
    for top, bottom, left, right in parts[: 1 if own.tile == other.tile else 2]:
        if left == right:
            continue
        for at in range(top, bottom, STRIP):
            near = (own.side(kind, True)[at : min(at + STRIP, bottom)] @ other.side(kind, False)[left:right].T).ravel()
            hit = np.flatnonzero(near >= limit - slack)
            if not len(hit):
                continue
            row, col = hit // (right - left) + at, hit % (right - left) + left
            ok = near[hit] >= limit + slack
            unsure = np.flatnonzero(~ok)
            for k in range(0, len(unsure), 1 << 14):
                some = unsure[k : k + (1 << 14)]
                ok[some] = np.sqrt(((own.x[row[some]] - other.x[col[some]]) ** 2).sum(1)) <= eps
            if codes:
                ok &= mine[row] != theirs[col]
            if ok.any():
                yield row[ok], col[ok]


def _arranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles (tile, keys, data, mark) with the rows marked 0, then those marked
    1, and no others: (tile, keys, data, at, first)."""
    for batch in batches:
        for r in range(batch.num_rows):
            marks = batch.column(3)[r].values.to_numpy()
            at = np.argsort(marks, kind="stable")[: int((marks < 2).sum())]
            if len(at):
                x = np.frombuffer(batch.column(2)[r].as_py()).reshape(len(marks), -1)[at]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), v) for v in (batch.column(1)[r].values.take(pa.array(at)), pa.array(at, pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), lists[0], pa.array([x.tobytes()], pa.binary()), lists[1], pa.array([int((marks == 0).sum())], pa.int32())], names=["tile", "keys", "data", "at", "first"])


def dbscan(df: DataFrame, key: str, vector: str, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """(key, cluster): clusters from 0 in the order of their smallest core key,
    noise -1; a border point joins the smallest cluster it touches.

    Rows are counted within their own tile first, which already tells many cores
    where rows are dense. One pass over half of the pairs of tiles counts what
    the others have within reach, and a second one, of rows that have any, takes
    links that join up what core rows of the two join up, fewer than rows, and
    the cores that border rows touch, who have fewer than ``min_samples``. Pairs
    of core rows within reach are never listed."""
    index = PivotIndex(df, key, vector)
    size = index.size  # rows are known by tile and place
    whole = settle(index.tiles) if index.one else index.tiles
    near = None if index.one else settle(index.halves(eps))

    def over(marks: DataFrame, work, schema: str, last=None) -> DataFrame:
        """``work(state, own, other)`` for pairs of tiles of the rows marked 0 or 1, with a 0 in one."""
        index.tiles = settle(whole.join(marks, "tile").select("tile", "keys", "data", "mark").mapInArrow(_arranged, f"tile long, keys array<{index.kind}>, data binary, at array<int>, first int"))
        pairs = near
        if not index.one:
            has = index.tiles.select("tile", "first")
            pairs = near.join(has, "tile").join(has.select(F.col("tile").alias("other_tile"), F.col("first").alias("more")), "other_tile").where("first + more > 0")

        def run(state: dict, own: list, others: list) -> Iterator[pa.RecordBatch]:
            rows = state.setdefault("rows", {})  # of the held tiles
            mine = _Rows(*own)
            for other in others:
                if other[0] not in rows:
                    rows[other[0]] = _Rows(*other)
                yield from work(state, mine, rows[other[0]])

        cells = 1 if index.one else index.blocks * (index.blocks + 1) // 2
        return index.meet(pairs, run, schema, "at", "first", last=last, parts=cells)

    def counted(counts: dict[int, np.ndarray]) -> pa.RecordBatch:
        found = [(tile, n.tobytes()) for tile, n in counts.items() if n.any()]
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.int64()), pa.array([n for _, n in found], pa.binary())], names=["tile", "n"])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                keys = batch.column(1)[r].values
                own = _Rows(batch.column(0)[r].as_py(), keys, batch.column(2)[r].as_py(), range(len(keys)), len(keys))
                n = np.zeros(len(keys), np.int64)
                for row, _ in _within(own, own, eps):
                    n += np.bincount(row, minlength=len(n))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), pa.array([n.tobytes()], pa.binary())], names=["tile", "n"])

    def across(state: dict, own: _Rows, other: _Rows) -> Iterator[pa.RecordBatch]:
        if own.tile != other.tile:
            for places in _within(own, other, eps):
                for rows, at in zip((own, other), places, strict=True):
                    n = state.setdefault("n", {}).setdefault(rows.tile, np.zeros(size, np.int64))
                    n += np.bincount(rows.at[at], minlength=size)
        return iter(())

    def marks(counts: DataFrame, core: int, some: int, none: int) -> DataFrame:
        """(tile, mark): of core rows, of others that have some within reach, and of those that have none."""

        def run(table: pa.Table) -> pa.Table:
            found = [np.frombuffer(n, np.int64) for n in table.column("n").to_pylist()]
            rows = min(map(len, found))  # the tile's own counts are as many as its rows
            n = sum(v[:rows] for v in found)
            mark = np.where(n + 1 >= min_samples, core, np.where(n > 0, some, none))
            return pa.table({"tile": table.column("tile").slice(0, 1), "mark": pa.array([mark.tolist()], pa.list_(pa.int32()))})

        return settle(counts.groupBy("tile").applyInArrow(run, "tile long, mark array<int>"))

    counts = settle(whole.select("tile", "keys", "data").mapInArrow(inside, "tile long, n binary"))
    if not index.one:
        counts = counts.unionByName(over(marks(counts, 1, 0, 0), across, "tile long, n binary", lambda state: iter([counted(state.get("n", {}))])))
    kinds = marks(counts, 0, 1, 2)

    def links(state: dict, own: _Rows, other: _Rows) -> Iterator[pa.RecordBatch]:
        root = state.setdefault("root", {})  # of a cell: it leaves fewer links than it has rows

        def top(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        def tops(rows: _Rows, at: np.ndarray) -> np.ndarray:
            found = np.zeros(len(rows.at), np.int64)
            for i in np.flatnonzero(np.bincount(at, minlength=len(found))).tolist():
                found[i] = top(rows.tile * size + int(rows.at[i]))
            return found[at]

        now = (top(rows.tile * size + i) for rows in (own, other) for i in rows.at[: rows.first].tolist())
        start = next(now, None)
        both = own.tile == other.tile or any(x != start for x in now)  # core rows that are joined up need no more links
        for row, col in _within(own, other, eps, both):
            mine, theirs = row < own.first, col < other.first
            ends = np.stack([tops(own, row[mine & theirs]), tops(other, col[mine & theirs])], 1)
            took = []
            for x, y in np.unique(ends[ends[:, 0] != ends[:, 1]], axis=0).tolist():
                x, y = top(x), top(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    took.append((x, y, True))
            for one, at, edge, rows in ((other, col[mine & ~theirs], row[mine & ~theirs], own), (own, row[~mine], col[~mine], other)):
                touch = np.stack([one.tile * size + one.at[at], tops(rows, edge)], 1)
                took.extend((x, y, False) for x, y in np.unique(touch, axis=0).tolist())
            if took:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*took, strict=True), (pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["a", "b", "core"])

    found = settle(over(kinds, links, "a long, b long, core boolean"))
    roots = components(found.where("core"))
    every = whole.join(kinds, "tile").select("tile", F.posexplode(F.arrays_zip("keys", "mark")).alias("at", "row"))
    every = every.select((F.col("tile") * size + F.col("at")).alias("node"), F.col("row.keys").alias("k"), F.col("row.mark").alias("mark"))
    cores = every.where("mark = 0").join(roots, "node", "left").select("node", "k", F.coalesce("root", "node").alias("root"))
    cores = settle(cores)
    named = cores.groupBy("root").agg(F.min("k").alias("label"))
    named = with_row_id(named, ["label", "root"], "cluster").select("root", F.col("cluster").cast("int").alias("cluster"))
    cores = settle(cores.join(named, "root").select("node", "cluster"))
    touched = found.where("not core").join(cores.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("cluster").alias("cluster"))
    out = every.join(cores.unionByName(touched), "node", "left").select(F.col("k").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    none = df.where(F.col(vector).isNull()).select(F.col(key), F.lit(-1).alias("cluster"))
    return out.unionByName(none)


def local_outlier_factor(df: DataFrame, key: str, vector: str, k: int = 20) -> DataFrame:
    """(key, lof) over exactly k neighbours."""
    near = settle(neighbours(df, key, vector, k=k))
    reach = near.groupBy(key).agg(F.max("distance").alias("kd"))
    pairs = near.join(reach.select(F.col(key).alias("other"), F.col("kd").alias("other_kd")), "other")
    density = pairs.groupBy(key).agg((1 / F.greatest(F.avg(F.greatest("distance", "other_kd")), F.lit(1e-12))).alias("lrd"))
    both = near.join(density, key).join(density.select(F.col(key).alias("other"), F.col("lrd").alias("other_lrd")), "other")
    return both.groupBy(key).agg((F.avg("other_lrd") / F.first("lrd")).alias("lof"))


def isolation_forest(df: DataFrame, vector: str, trees: int = 100, sample: int = 256, seed: int = 42, name: str = "anomaly") -> DataFrame:
    """Scores 2^(-E/c): trees are grown on the driver from a bounded sample (the
    first by a seeded hash) and go to the executors for scoring."""
    some = _matrix(pd.Series([r[0] for r in df.select(vector).orderBy(F.xxhash64(F.lit(seed), vector)).limit(sample * 16).collect()]))
    size, rng = min(sample, len(some)), np.random.default_rng(seed)
    average = lambda n: 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0

    def grow(x: np.ndarray, depth: int):
        low, high = x.min(0), x.max(0)
        wide = np.flatnonzero(high > low)
        if depth <= 0 or len(x) <= 1 or not len(wide):
            return average(len(x))
        j = int(rng.choice(wide))
        cut = rng.uniform(low[j], high[j])
        return j, cut, grow(x[x[:, j] < cut], depth - 1), grow(x[x[:, j] >= cut], depth - 1)

    forest = [grow(some[rng.permutation(len(some))[:size]], int(np.ceil(np.log2(max(size, 2))))) for _ in range(trees)]

    def depth(node, x: np.ndarray, level: int, out: np.ndarray, at: np.ndarray) -> None:
        if not isinstance(node, tuple):
            out[at] += level + node
            return
        j, cut, left, right = node
        below = x[at, j] < cut
        for child, part in ((left, at[below]), (right, at[~below])):
            if len(part):
                depth(child, x, level + 1, out, part)

    @F.pandas_udf("double")
    def run(column: pd.Series) -> pd.Series:
        x = _matrix(column)
        out = np.zeros(len(x))
        for tree in forest:
            depth(tree, x, 0, out, np.arange(len(x)))
        return pd.Series(2 ** (-out / trees / max(average(size), 1e-12)))

    return df.withColumn(name, run(vector))


def outlier_labels(df: DataFrame, score: str, contamination: float = 0.1, name: str = "label") -> DataFrame:
    """-1 for scores at or above the (1 - contamination) quantile, else 1."""
    cut = of_columns(df, {score: F.col(score)}, [1 - contamination])[score][0]
    return df.withColumn(name, F.when(F.col(score) >= F.lit(cut), -1).otherwise(1))


# ---- cluster quality ------------------------------------------------------------------


def silhouette(df: DataFrame, key: str, vector: str, label: str) -> float:
    """Mean silhouette by Euclidean distance; singleton clusters don't count,
    rows without a label or a vector take no part. Rows are dealt by label, so
    a block holds few of them and leaves few sums for each row of a tile."""
    rows = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull())
    kind = df.schema[label].dataType.simpleString()

    def run(state: dict, own: list, others: list) -> Iterator[pa.RecordBatch]:
        n, sums = len(own[1]), {}
        for other in others:
            d = np.sqrt(_squares(own[2], n, other[2], len(other[1]))[2])
            if own[0] == other[0]:
                np.fill_diagonal(d, 0.0)
            said = other[1].dictionary_encode()
            code = said.indices.to_numpy()
            for c, name in enumerate(said.dictionary.to_pylist()):
                sums[name] = sums.get(name, 0.0) + d[:, code == c].sum(1)
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, own[0], np.int64)), pa.array(np.arange(n), pa.int32()), own[1], pa.array([name] * n, own[1].type), pa.array(total)], names=["tile", "at", "own", "other", "s"])

    dealt = rows.repartitionByRange(label, key).sortWithinPartitions(label, key)
    made = tiles(dealt, vector, label)
    n, n_bytes = made.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("data")), F.lit(0))).first()
    blocks = _blocks(n_bytes)
    each, mine = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), F.floor(F.col("tile") * blocks / max(n, 1)).cast("int")
    made = made.select("tile", F.col(label).alias("keys"), "data")
    held, sent = made.select(each.alias("a"), mine.alias("b"), "*"), made.select(mine.alias("a"), each.alias("b"), "*", F.lit(None).cast("array<bigint>").alias("partners"))
    sums = _meet(held, sent, run, f"tile long, at int, own {kind}, other {kind}, s double")
    sizes = rows.groupBy(F.col(label).alias("other")).agg(F.count(F.lit(1)).alias("n"))
    sums = sums.groupBy("tile", "at", "own", "other").agg(F.sum("s").alias("s")).join(sizes, "other")
    same = F.col("own") == F.col("other")
    each = sums.groupBy("tile", "at").agg(
        F.max(F.when(same, F.col("n"))).alias("n"),
        F.max(F.when(same & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a"),
        F.coalesce(F.min(F.when(~same, F.col("s") / F.col("n"))), F.lit(float("inf"))).alias("b"),
    )
    most = F.greatest("a", "b")
    return each.where("n > 1").agg(F.avg(F.when(most > 0, (F.col("b") - F.col("a")) / most).otherwise(0.0))).first()[0]


def _dispersion(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(label, n, centre) of the clusters that aren't noise."""
    rows = df.where(F.col(label) >= 0).select(label, F.posexplode(vector).alias("pos", "v"))
    means = rows.groupBy(label, "pos").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return means.groupBy(label).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("center"))


def _square_gap(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def inertia(df: DataFrame, vector: str, label: str) -> DataFrame:
    centers = _dispersion(df, vector, label)
    return df.join(centers, label).agg(F.sum(_square_gap(F.col(vector), F.col("center"))).alias("inertia"))


def calinski_harabasz(df: DataFrame, vector: str, label: str) -> float:
    """Noise is left out of the means, but all rows count in n."""
    centers = _dispersion(df, vector, label).toPandas()
    n, k = df.count(), len(centers)
    c, m = np.stack(centers["center"]), centers["n"].to_numpy(float)
    grand = (c * m[:, None]).sum(0) / m.sum()
    between = (m * ((c - grand) ** 2).sum(1)).sum()
    within = inertia(df, vector, label).first()[0]
    return float(between / (k - 1) / (within / (n - k))) if k > 1 and within else 0.0


def davies_bouldin(df: DataFrame, vector: str, label: str) -> float:
    centers = _dispersion(df, vector, label)
    spread = df.join(centers, label).groupBy(label).agg(F.avg(F.sqrt(_square_gap(F.col(vector), F.col("center")))).alias("s"), F.first("center").alias("center")).toPandas()
    c, s = np.stack(spread["center"]), spread["s"].to_numpy()
    d = np.sqrt(((c[:, None] - c) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return float(((s[:, None] + s) / d).max(1).mean())


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index from the contingency table."""
    two = lambda n: n * (n - 1) / 2
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = cells.agg(F.sum(two(F.col("n"))).alias("both"), F.sum("n").alias("all"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("ra"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("rb"))
    out = one.join(F.broadcast(rows)).join(F.broadcast(cols))
    chance = F.col("ra") * F.col("rb") / two(F.col("all"))
    top = (F.col("ra") + F.col("rb")) / 2
    return out.select(F.when(top == chance, 1.0).otherwise((F.col("both") - chance) / (top - chance)).alias("ari"))


def contamination_ratio(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) < 0).cast("double")).alias("contamination"))
