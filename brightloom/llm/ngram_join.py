"""Exact Jaccard self-join of documents on their sets of word n-grams.

Two documents link when ``100 * |A & B| >= percent * |A | B|``. The join runs
over distinct sets; equal sets are one node.

1. One pass gives each document its set size, a digest of its set, a hashed
   bitmap signature (a power of two of bits, two or more for each n-gram), and
   counts all n-grams in a fixed number of hashed counters.
2. A second pass emits each set's prefix: its ``n - ceil(t n) + 1`` rarest
   n-grams by those counters. Linked sets share an n-gram of their prefixes,
   whatever the order, so the counters steer the work and not the result.
3. Sets that share a prefix n-gram form a list. Short lists give their pairs of
   compatible size. Longer ones, and all of n-grams that may be very common
   (their rows are dealt out by set from the start), are cut into tiles: by
   size band, and large bands by hash. Tiles meet only within a band and with
   the band above, as sets two bands apart are never compatible. In a tile pair
   bit counts bound each overlap from above (the number of bits set only in A
   bounds |A - B| from below), and a union-find keeps at most sets - 1 of the
   pairs that the bound lets pass.
4. Components of those pairs are clusters: every link lies within one.
   The clusters are cut into size-banded tiles again, now with the sorted
   arrays of 64-bit n-gram hashes, computed again for their sets only. Pairs
   that pass the bit-count bound are intersected exactly; a tile pair returns a
   number of links for each set and at most sets - 1 links that join them up, so
   no step makes rows in proportion to the pairs of a group.
5. Components of those links are the classes.

``n_links`` is the number of other distinct sets that a document's set links
with; documents of equal sets are one set in it. Counting every link compares
all pairs of a cluster that the bounds let pass. Without ``counted``, pairs
already joined up are skipped: clusters of more than one tile first have the
pairs of step 3 verified, and only those that these links leave apart are
compared in tiles.

Defined cases: null, empty and blank texts have the empty set (n_shingles 0)
and link with nothing; a text of fewer words than ``width`` has one n-gram, the
whole sequence; very long texts are one set like any other; rows that repeat a
doc_id are separate rows; null ids are ignored in the smallest id of a
component, unless it has no other; an empty table gives an empty result; extra
columns of the input take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_heavy, join_salted, materialize, small_or_plain
from .graph import components
from .hashing import digest64, give_back, raw_texts, shingle_sets

WIDTH = 5
PERCENT = 75
COUNTER_BITS = 17
#: Counters travel in so many pieces for each task.
CHUNKS = 128
#: A list whose n-gram's counter is above this, and above 5/4 of the mean, is
#: dealt out by set from the start.
HOT = 1024
SHORT_LIST = 4
#: Sets of a tile at most, about; and their n-grams.
TILE = 1024
TILE_GRAMS = 1 << 19


def _in_arrow(rows: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers return their memory when a task is done:
    they outlive it, and the next stages run beside them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return rows.mapInArrow(task, schema)


def _table(schema: dict[str, pa.DataType], **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in schema.items()], names=list(schema))


def signature(values: np.ndarray) -> bytes:
    """Hashed bitmap of a set: the next power of two from 2n bits on."""
    size = max(64, 1 << (2 * len(values) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(values & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """Signatures (rows of 64-bit words) folded down to ``size`` words."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def most_overlap(one: np.ndarray, n_one: int, many: np.ndarray, n_many: np.ndarray) -> np.ndarray:
    """Upper bounds of |A & B| for a set against many, by bit counts."""
    size = min(one.shape[-1], many.shape[-1])
    one, many = fold(one, size), fold(many, size)
    only_one = np.bitwise_count(one & ~many).sum(1, dtype=np.int64)
    only_many = np.bitwise_count(many & ~one).sum(1, dtype=np.int64)
    return np.minimum(n_one - only_one, n_many - only_many)


def _slices(batches: Iterator[pa.RecordBatch], most: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole runs of equal leading columns, of a stream that is
    sorted by them."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            col = batch.column(k).to_numpy(zero_copy_only=False)
            last[1:] |= col[1:] != col[:-1]
        cut = np.flatnonzero(last)
        same = rest and all(rest[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in range(keys))
        if rest and not same:
            yield pa.Table.from_batches(rest)
            rest = []
        if len(cut):
            yield pa.Table.from_batches([*rest, batch.slice(0, int(cut[-1]))])
            rest = [batch.slice(int(cut[-1]))]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def node_rows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text) -> rows (doc_id, n, node, bits) for each document, and of
    each task the hashed n-gram counters in rows (chunk, seen)."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = {"n": pa.int64(), "node": pa.int64(), "bits": pa.binary(), "chunk": pa.int32(), "seen": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, id_type = np.zeros(1 << COUNTER_BITS, "<i8"), None
        for batch in _slices(batches):
            ids, id_type = batch.column(0), batch.column(0).type
            n, nodes, bits = [], [], []
            for s in shingle_sets(raw_texts(batch.column(1)), width):
                n.append(len(s))
                nodes.append(digest64(s))
                bits.append(signature(s) if len(s) else b"")
                np.add.at(counters, (s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), 1)
            none = [None] * len(n)
            rest = _table(schema, n=n, node=nodes, bits=bits, chunk=none, seen=none)
            yield pa.RecordBatch.from_arrays([ids, *rest.columns], names=["doc_id", *schema])
        parts = {k: x.tobytes() for k, x in enumerate(counters.reshape(CHUNKS, -1)) if x.any()}
        none = [None] * len(parts)
        rest = _table(schema, n=none, node=none, bits=none, chunk=list(parts), seen=list(parts.values()))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(parts), id_type), *rest.columns], names=["doc_id", *schema])

    return _in_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n long, node long, bits binary, chunk int, seen binary")


def gram_counts(first: DataFrame) -> np.ndarray:
    """The counters of all tasks, summed piece by piece on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, seen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(seen, "<i8")
        yield _table({"chunk": pa.int32(), "seen": pa.binary()}, chunk=list(sums), seen=[x.tobytes() for x in sums.values()])

    counts = np.zeros((CHUNKS, (1 << COUNTER_BITS) // CHUNKS), np.int64)
    parts = first.where("chunk is not null").select("chunk", "seen").repartition("chunk")
    for row in _in_arrow(parts, run, "chunk int, seen binary").collect():  # of fixed size
        counts[row["chunk"]] = np.frombuffer(row["seen"], "<i8")
    return counts.ravel()


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def postings(docs: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """(gram, salt, n, node): the prefix of each set; sets that occur again
    within a task are left out there. salt is 0, or from 1 on for an n-gram that
    may be very common."""
    schema = {"gram": pa.int64(), "salt": pa.int32(), "n": pa.int64(), "node": pa.int64()}
    shift = np.uint64(64 - COUNTER_BITS)
    hot = counts > max(HOT, 1.25 * counts.mean())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in _slices(batches):
            grams, salts, sizes, nodes = [], [], [], []
            for s in shingle_sets(raw_texts(batch.column(0)), width):
                if not len(s) or (node := digest64(s)) in met:
                    continue
                met.add(node)
                n = len(s)
                p = prefix_length(n, percent)
                own = (s >> shift).astype(np.int64)
                order = np.argsort(counts[own], kind="stable")[:p]  # ties by hash
                grams.append(s[order])
                salts.append(np.where(hot[own[order]], 1 + (node & 63), 0))
                sizes.append(np.full(p, n))
                nodes.append(np.full(p, node))
            if grams:
                yield _table(schema, gram=np.concatenate(grams).view(np.int64), salt=np.concatenate(salts), n=np.concatenate(sizes), node=np.concatenate(nodes))

    return _in_arrow(docs.select("text"), run, "gram long, salt int, n long, node long")


def list_pairs(post: DataFrame, percent: int) -> DataFrame:
    """Pairs of short lists (gram null), and the sets of other lists (b null)."""
    schema = {"gram": pa.int64(), "a": pa.int64(), "na": pa.int64(), "b": pa.int64(), "nb": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for rows in _runs(batches, 2):
            gram, salt, n, node = (rows.column(k).to_numpy() for k in range(4))
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (node[1:] != node[:-1]) | (n[1:] != n[:-1])
            gram, salt, n, node = gram[new], salt[new], n[new], node[new]
            edge = np.append(True, (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1]))
            start = np.flatnonzero(edge)
            size = np.diff(np.append(start, len(gram)))
            if len(seen) > 100_000:
                seen.clear()
            pairs: list[tuple[int, int, int, int]] = []
            short = (size > 1) & (size <= SHORT_LIST) & (salt[start] == 0)
            for s, g in zip(start[short].tolist(), size[short].tolist(), strict=True):
                for i in range(s, s + g):
                    for j in range(i + 1, s + g):
                        if 100 * n[i] >= percent * n[j]:  # sizes ascend
                            x, y = (i, j) if node[i] < node[j] else (j, i)
                            key = (int(node[x]), int(node[y]))
                            if key not in seen:
                                seen.add(key)
                                pairs.append((key[0], int(n[x]), key[1], int(n[y])))
            if pairs:
                a, na, b, nb = zip(*pairs, strict=True)
                yield _table(schema, gram=[None] * len(pairs), a=a, na=na, b=b, nb=nb)
            at = np.repeat((size > SHORT_LIST) | (salt[start] > 0), size)
            if at.any():
                none = [None] * int(at.sum())
                yield _table(schema, gram=gram[at], a=node[at], na=n[at], b=none, nb=none)

    dealt = post.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "n", "node")
    return _in_arrow(dealt, run, "gram long, a long, na long, b long, nb long")


def may_link(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose signatures allow enough overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                o = most_overlap(np.frombuffer(x, np.uint64), na[i], np.frombuffer(y, np.uint64)[None], nb[i : i + 1])[0]
                keep[i] = 100 * o >= percent * (na[i] + nb[i] - o)
            yield batch.filter(pa.array(keep)).select([0, 1, 2, 3])

    for end in ("a", "b"):
        some = nodes.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("bits").alias(f"bits_{end}"))
        pairs = pairs.join(some, [end, f"n{end}"])
    return _in_arrow(pairs.select("a", "na", "b", "nb", "bits_a", "bits_b"), run, "a long, na long, b long, nb long")


def gram_sets(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, n, bits, grams) of the sets in ``wanted`` (node, n), and of some
    others; a set may occur again."""
    carriers = materialize(nodes.join(wanted, ["node", "n"], "left_semi").select(F.col("doc_id").alias("carrier")).distinct())
    carriers, _ = small_or_plain(carriers)
    some = docs.select("doc_id", "text").join(carriers, F.col("doc_id").eqNullSafe(F.col("carrier")), "left_semi")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [s for s in shingle_sets(raw_texts(batch.column(0)), width) if len(s)]
            schema = {"node": pa.int64(), "n": pa.int64(), "bits": pa.binary(), "grams": pa.binary()}
            yield _table(schema, node=[digest64(s) for s in sets], n=[len(s) for s in sets], bits=[signature(s) for s in sets], grams=[s.tobytes() for s in sets])

    # written once: read more than once, and one Python function a stage
    return materialize(_in_arrow(some.select("text"), arrays, "node long, n long, bits binary, grams binary"))


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by exact intersection of sorted arrays."""
    wanted = pairs.select(F.col("a").alias("node"), F.col("na").alias("n")).union(pairs.select("b", "nb")).distinct()
    sets = gram_sets(wanted, docs, nodes, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 500):
            na, nb = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            both = np.zeros(batch.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both[i] = (y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()
            yield batch.filter(pa.array(100 * both >= percent * (na + nb - both))).select([0, 2])

    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("grams").alias(f"grams_{end}")), [end, f"n{end}"])
    return _in_arrow(pairs.select("a", "na", "b", "nb", "grams_a", "grams_b"), run, "a long, b long").distinct()


def tiled(rows: DataFrame, group: str, percent: int) -> DataFrame:
    """``rows`` (group, node, n) once for each pair of size-banded tiles (low,
    high) of their group that they belong to, with their own tile."""
    rows = rows.withColumn("band", F.floor(F.log("n") / F.lit(log(100 / min(percent, 99))) + F.lit(1e-9)).cast("long"))
    fits = lambda sets, grams: F.greatest(F.ceil(sets / TILE), F.ceil(grams / TILE_GRAMS)).cast("long")
    shape = rows.groupBy(group, "band").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("grams"))
    # as many bands as the logarithm of the largest size
    parts = F.map_from_entries(F.collect_list(F.struct("band", fits(F.col("sets"), F.col("grams")))))
    shape = shape.groupBy(group).agg(F.sum("sets").alias("sets"), F.sum("grams").alias("grams"), parts.alias("parts"))
    shape = shape.where("sets > 1").select(group, F.when(fits(F.col("sets"), F.col("grams")) > 1, F.col("parts")).alias("parts"))
    rows = join_salted(rows, shape, [group], "node")
    own, below, above = (F.coalesce(F.col("parts")[F.col("band") + k], F.lit(0)) for k in (0, -1, 1))
    tile = lambda k, part: (F.col("band") + k) * F.lit(1 << 20) + part
    mine = tile(0, F.pmod(F.xxhash64("node"), own))

    def meets(k: int, n) -> object:
        other = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(other, lambda q: F.struct(F.least(mine, tile(k, q)).alias("low"), F.greatest(mine, tile(k, q)).alias("high"), mine.alias("tile")))

    zero = F.lit(0).cast("long")
    whole = F.array(F.struct(zero.alias("low"), zero.alias("high"), zero.alias("tile")))
    pairs = F.when(F.col("parts").isNull(), whole).otherwise(F.concat(meets(0, own), meets(-1, below), meets(1, above)))
    names = [c for c in rows.columns if c not in ("band", "parts")]
    return rows.select(*names, F.explode(pairs).alias("t")).select(*names, "t.low", "t.high", "t.tile")


class Sets:
    """The sets of a pair of tiles."""

    def __init__(self, node: np.ndarray, n: np.ndarray, tile: np.ndarray, bits: list[bytes], one: bool, percent: int):
        self.node, self.n, self.tile, self.one, self.percent = node, n, tile, one, percent
        self.bits = [np.frombuffer(x, np.uint64) for x in bits]
        self.root = np.arange(len(node))

    def near(self, skip: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each set, and others whose bit counts allow a link with it, with the
        bounds of their overlaps: each pair once, or with ``skip`` not at all if
        the two are joined up already."""
        n, size = self.n, np.array([len(x) for x in self.bits])
        for w in np.unique(size):
            at = np.flatnonzero(size == w)
            many = np.stack([self.bits[i] for i in at])
            # each set against those of its own width, and wider ones against these
            for i in np.flatnonzero((size >= w) & (self.percent * size <= 200 * w)).tolist():
                ok = 100 * np.minimum(n[at], n[i]) >= self.percent * np.maximum(n[at], n[i])
                if size[i] == w:
                    ok &= at < i
                if not self.one:
                    ok &= self.tile[at] != self.tile[i]
                if skip:
                    ok &= self.root[at] != self.root[i]
                if ok.any():
                    o = most_overlap(self.bits[i], n[i], many[ok], n[at[ok]])
                    may = 100 * o >= self.percent * (n[i] + n[at[ok]] - o)
                    if may.any():
                        yield i, at[ok][may], o[may]

    def join(self, i: int, others: np.ndarray) -> list[tuple[int, int]]:
        """Joins a set up with others; the links that it took."""
        took = []
        for root, k in zip(*np.unique(self.root[others], return_index=True), strict=True):
            if root != self.root[i]:
                self.root[self.root == root] = self.root[i]
                took.append((i, int(others[k])))
        return took


def _tile_sets(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[tuple[Sets, list[bytes]]]:
    """The sets of each (group, low, high) with what the last column holds, of
    rows (group, low, high, tile, node, n, bits, ...) sorted by these."""
    for rows in _runs(batches, 3):
        keys = np.stack([rows.column(k).to_numpy().astype(np.int64) for k in range(3)])
        start = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0))).tolist()
        for s, e in zip(start, [*start[1:], rows.num_rows], strict=True):
            some = rows.slice(s, e - s)
            tile, node, n = (some.column(k).to_numpy() for k in (3, 4, 5))
            _, at = np.unique(node, return_index=True)  # a set may come again
            if len(at) > 1:
                some = some.take(pa.array(at))
                yield Sets(node[at], n[at], tile[at], some.column(6).to_pylist(), keys[1, s] == keys[2, s], percent), some.column(some.num_columns - 1).to_pylist()


def _dealt(rows: DataFrame, group: str, *more: str) -> DataFrame:
    names = [group, "low", "high", "tile", "node", "n", "bits", *more]
    return rows.select(*names).repartition(group, "low", "high").sortWithinPartitions(group, "low", "high")


def list_links(left: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of (gram, node, n): pairs that may link and join up all sets of a
    list that such pairs join up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for sets, _ in _tile_sets(batches, percent):
            if len(seen) > 100_000:
                seen.clear()
            took = [x for i, others, _ in sets.near(skip=True) for x in sets.join(i, others)]
            ends = {(min(x), max(x)) for x in ((int(sets.node[i]), int(sets.node[j])) for i, j in took)} - seen
            seen |= ends
            if ends:
                a, b = zip(*sorted(ends), strict=True)
                yield _table({"a": pa.int64(), "b": pa.int64()}, a=a, b=b)

    rows = tiled(left, "gram", percent).join(nodes.select("node", "n", "bits"), ["node", "n"])
    return _in_arrow(_dealt(rows, "gram"), run, "a long, b long").distinct()


class Overlaps:
    """Exact |A & B| of the sorted arrays of a pair of tiles."""

    def __init__(self, arrays: list[bytes]):
        sets = [np.frombuffer(x, np.uint64) for x in arrays]
        self.start = np.cumsum([0, *map(len, sets)])
        grams, self.codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.inside = np.zeros(len(grams), bool)

    def of(self, i: int, others: np.ndarray) -> np.ndarray:
        part = lambda k: self.codes[self.start[k] : self.start[k + 1]]
        self.inside[part(i)] = True
        if 8 * len(others) < len(self.start):
            found = np.array([np.count_nonzero(self.inside[part(j)]) for j in others])
        else:
            found = np.add.reduceat(self.inside[self.codes], self.start[:-1], dtype=np.int64)[others]
        self.inside[part(i)] = False
        return found


def cluster_links(rows: DataFrame, percent: int, counted: bool) -> DataFrame:
    """(node, other, n_links) of (root, low, high, tile, node, n, bits, grams,
    known): links that join up what links join up, and, if ``counted``, numbers
    of links (other null)."""
    schema = {"node": pa.int64(), "other": pa.int64(), "n_links": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets, more in _tile_sets(batches, percent):
            exact = Overlaps([x["grams"] for x in more])
            _, sets.root = np.unique([x["known"] for x in more], return_inverse=True)
            seen, took = np.zeros(len(sets.node), np.int64), []
            for i, others, _ in sets.near(skip=not counted):
                both = exact.of(i, others)
                linked = others[100 * both >= percent * (sets.n[i] + sets.n[others] - both)]
                seen[i] += len(linked)
                seen[linked] += 1
                took += sets.join(i, linked)
            if took:
                i, j = map(list, zip(*took, strict=True))
                yield _table(schema, node=sets.node[i], other=sets.node[j], n_links=[0] * len(took))
            if counted and (at := np.flatnonzero(seen)).size:
                yield _table(schema, node=sets.node[at], other=[None] * len(at), n_links=seen[at])

    return _in_arrow(_dealt(rows.withColumn("own", F.struct("grams", "known")), "root", "own"), run, "node long, other long, n_links long")


def link_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, counted: bool = True) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, n_links, component_id), one row for
    each row. n_links counts all sets that the document's set links with; it is
    left out unless ``counted``."""
    docs = docs.select("doc_id", "text")
    first = materialize(node_rows(docs, width))
    rows = first.where("chunk is null").select("doc_id", "n", "node")
    nodes = first.where("chunk is null and n > 0").groupBy("node", "n")
    nodes = materialize(nodes.agg(F.min("doc_id").alias("doc_id"), F.first("bits").alias("bits"), F.count(F.lit(1)).alias("copies")))

    found = materialize(list_pairs(postings(docs, gram_counts(first), width, percent), percent))
    pairs = may_link(found.where("gram is null").select("a", "na", "b", "nb").distinct(), nodes, percent)
    left = found.where("gram is not null").select("gram", F.col("a").alias("node"), F.col("na").alias("n"))
    edges = materialize(pairs.select("a", "b").union(list_links(left, nodes, percent)))
    members = materialize(components(edges).join(nodes.select("node", "n"), "node"))
    known, links = members.select("node", F.col("node").alias("known")), None
    if not counted:
        large = members.groupBy("root").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") > TILE).select("root")
        sets = materialize(members.join(large, "root", "left_semi").select("node", "n"))
        if not sets.isEmpty():
            some = edges.join(sets.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(sets.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
            links = materialize(verified(some.select("a", "na", "b", "nb"), docs, nodes, width, percent))
            known = known.join(components(links), "node", "left").select("node", F.coalesce("root", "known").alias("known"))
    members = materialize(members.join(known, "node"))
    apart = members
    if not counted:
        several = members.groupBy("root").agg(F.min("known").alias("low"), F.max("known").alias("high")).where("low <> high").select("root")
        apart = materialize(members.join(several, "root", "left_semi"))
    sets = gram_sets(apart.select("node", "n"), docs, nodes, width)
    rows_of = tiled(apart.select("root", "node", "n", "known"), "root", percent)
    exact = materialize(cluster_links(rows_of.join(sets, ["node", "n"]), percent, counted))
    new = exact.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    roots = components(new if links is None else new.union(links))

    classes = nodes.select("node", "n", "doc_id", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = classes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = join_salted(classes, whole, ["root"], "node").select("node", "n", "copies", "component_id")
    columns = ["doc_id", F.col("n").alias("n_shingles"), *(["n_links"] if counted else []), "component_id"]
    if counted:
        counts = exact.where("other is null").groupBy("node").agg(F.sum("n_links").alias("n_links"))
        classes = classes.join(counts, "node", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
    classes = materialize(classes)
    discard(*[x for x in (nodes, found, edges, members, apart, sets, exact, links) if x is not None])
    some = join_heavy(rows.where("n > 0"), classes, ["node", "n"], "copies").select(*columns)
    none = rows.where("n = 0").select("doc_id", "n", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id")).select(*columns)
    return some.unionByName(none)
