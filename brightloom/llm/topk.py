"""Exact top-k search by tiled matrix products.

Vectors are quantised to integers, ``floor(scale * x)`` of each component as a
double, so inner products are exact in 64-bit floats (below 2**53). Candidates
and queries are packed into tiles of bounded numbers of rows, of 32-bit integers
where these hold them. The query blocks, which are the small side, are sent to
the tiles by an equi-join on the tile's number; one matrix product scores a
pair, each query keeps the tile's k best by partial selection, and the lists of
a query are merged in a tree of as many levels as the number of tiles asks for. Work
and bytes sent grow with queries times tiles, which is the task itself.

Ties go to the smaller id. Defined cases: vectors that are null, or hold null
or non-finite components, take no part; vectors of different lengths aren't
compared; rows with a query's own id are its own and no candidates; several
query rows of one id are answered each, and repeated candidates each count; null ids are candidates that come
last among ties and never queries; empty tables give an empty result; fewer
than k candidates give all; extra columns take no part. |x| must be below
2**53 / scale, which finite float32 embeddings in practice are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, small_or_plain

TILE, BLOCK, FAN = 4096, 1024, 16
#: Tiles that share a copy of a query block on its way, about.
GROUP = 256
NULL_ID = np.iinfo(np.int64).max


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """(id, v array<double>) -> (dim, n, ids, data): tiles of at most ``most``
    rows, one length of vectors each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def tile(dim: int, ids: list, parts: list) -> pa.RecordBatch:
            data = np.concatenate(parts)
            data = data.astype("<i4" if not data.size or np.abs(data).max() < 2**31 else "<f8")
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((dim, pa.int32()), (len(data), pa.int32()), (np.concatenate(ids).astype("<i8").tobytes(), pa.binary()), (data.tobytes(), pa.binary()))], names=["dim", "n", "ids", "data"])

        for whole in batches:
            for at in range(0, whole.num_rows, most):
                batch = whole.slice(at, most)
                ids = batch.column(0).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)
                vectors = batch.column(1)
                length = vectors.value_lengths().to_numpy(zero_copy_only=False)
                flat = vectors.flatten().to_numpy(zero_copy_only=False)
                start = np.cumsum(length) - length
                for dim in np.unique(length).tolist():
                    own = np.flatnonzero(length == dim)
                    part = flat[start[own][:, None] + np.arange(dim)]
                    if dim in held and sum(map(len, held[dim][1])) + len(own) > most:
                        yield tile(dim, *held.pop(dim))
                    some = held.setdefault(dim, ([], []))
                    some[0].append(ids[own])
                    some[1].append(part)
        for dim, some in held.items():
            yield tile(dim, *some)

    return rows.mapInArrow(run, "dim int, n int, ids binary, data binary")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Column indices of each row's k highest scores, ties to smaller ids;
    ``ids`` ascend."""
    k = min(k, scores.shape[1])
    if scores.shape[1] > 4 * k:
        # everything at or above the k-th score: ties among them by position
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        out = np.empty((len(scores), k), np.int64)
        for i, row in enumerate(scores):
            above = np.flatnonzero(row > least[i])
            level = np.flatnonzero(row == least[i])[: k - len(above)]
            at = np.concatenate([above, level])
            out[i] = at[np.lexsort((at, -row[at]))]
        return out
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def _merge(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc("score"), F.asc("cand"))
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query."""
    values = F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    sound = F.col(embedding).isNotNull() & F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.when(is_query, True).otherwise(False).alias("q"), F.when(sound, values).alias("v")).where("v is not null")
    rows = materialize(rows)
    blocks = _packed(rows.where("q and id is not null").select("id", "v"), BLOCK).withColumn("block", F.monotonically_increasing_id())
    blocks = materialize(blocks)
    tiles = materialize(_packed(rows.select("id", "v"), TILE).withColumn("tile", F.monotonically_increasing_id()))
    # a block goes to groups of tiles, and from there to the tiles
    n_tiles = tiles.count()
    groups = max(1, -(-n_tiles // GROUP))
    sent = blocks.select("dim", "block", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    some, _ = small_or_plain(tiles.select("dim", "tile", F.pmod(F.xxhash64("tile"), F.lit(groups)).cast("int").alias("group")))
    sent = sent.join(some, ["dim", "group"]).drop("group")
    both = sent.drop("dim").join(tiles.drop("n"), "tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block, dim, ids, data, q_ids, q_data, tile = (c[r].as_py() for c in batch.columns)
                ids, q_ids = np.frombuffer(ids, "<i8"), np.frombuffer(q_ids, "<i8")
                shape = lambda x, n: np.frombuffer(x, "<i4" if len(x) == 4 * n * dim else "<f8").reshape(n, dim).astype(np.float64)
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                scores = shape(q_data, len(q_ids)) @ shape(data, len(ids))[order].T
                low, high = np.searchsorted(ids, q_ids, "left"), np.searchsorted(ids, q_ids, "right")
                for i in np.flatnonzero(high > low):
                    scores[i, low[i] : high[i]] = -np.inf
                at = best(scores, ids, k)
                found = np.take_along_axis(scores, at, 1)
                row, col = np.nonzero(found > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(len(row), block), row, q_ids[row], ids[at[row, col]], found[row, col].astype(np.int64), np.full(len(row), tile))], names=["block", "row", "query_id", "cand", "score", "part"])

    scored = both.select("block", "dim", "ids", "data", "q_ids", "q_data", "tile").mapInArrow(run, "block long, row long, query_id long, cand long, score long, part long")
    # about FAN lists meet at a time, level by level
    while n_tiles > FAN:
        n_tiles = -(-n_tiles // FAN)
        scored = _merge(scored.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(n_tiles))), ["block", "row", "part"], k).drop("rank")
    done = _merge(scored, ["block", "row"], k)
    return done.select("query_id", "rank", F.when(F.col("cand") != int(NULL_ID), F.col("cand")).alias("vec_id"), "score")
