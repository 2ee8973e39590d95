"""Periodic runs of words: found exactly, and collapsed to one period.

A run is a stretch of words with smallest period q that no neighbouring word
extends keeping that period, of at least ``least`` words and ``times`` periods.
All runs of a text come from its longest previous factors:

1. Prefix doubling ranks all stretches of 2^k words, level by level, until all
   suffixes differ: the suffix array. The levels tell in a few steps how far two
   places agree, to the right and to the left, so also the LCP of neighbours in
   the suffix array.
2. Of the nearest smaller positions before and after a suffix in the suffix
   array, the one that agrees longer gives its longest previous factor (LPF) and
   where that is; leaping along the LPF array gives the LZ blocks.
3. Main's extensions: a run that begins before or at a block's start and ends in
   the block reaches less than the block before and a period to the left, or else
   that block would have been longer. So at each block's start, periods below the
   two blocks' length over ``times - 1`` are enough: from there, and from one
   period to the left, the text is compared with itself shifted by the period, in
   both directions. Of the periods of one stretch the smallest stays.
4. Runs strictly inside a block are copies of runs inside its previous
   occurrence; buckets of runs by start, gone through in order, copy them, also
   where the occurrence overlaps the block.

A sieve goes before: every stretch of a few words (five, for six words and four
periods) in a run occurs in it again, so runs lie within maximal stretches of
words whose five-grams aren't alone in their text, and again not alone in their
stretch. Hashed counts, which err to one side only, leave out all other
words; texts of a slice go through the steps above together.

Words are runs of anything but ASCII white space, compared byte by byte. Defined
cases: null, empty and blank texts have no words, no runs and an empty collapsed
text; very long texts take the same path; repeated rows are each judged; an
empty table gives an empty result; other columns are passed through, whatever
their names, but for ones with the names of the results, which are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import chunks, give_back, mix64, raw_texts

LEAST, TIMES = 6, 4
#: Texts of so many bytes are taken together; a longer one is taken alone.
AT_ONCE = 1 << 20
ROUNDS = 3

Runs = list[tuple[int, int, int]]  # (start, length, period)


def sieve_width(least: int, times: int) -> int:
    """The longest stretches of words of which each one in a run occurs in it
    twice: a run of period q has at least 2q + width - 1 words."""
    return max(1, min(max(least, times * q) - 2 * q + 1 for q in range(1, least + 1)))


def lively(ids: np.ndarray, bounds: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Ranges of words that together hold all runs; ``bounds`` are the starts of
    texts and the end. Ranges of one text share less than ``least`` words."""
    width = sieve_width(least, times) if times > 2 else 1
    n = len(ids) - width + 1
    if n < 2:
        return []
    gram = np.zeros(n, np.uint64)
    for k in range(width):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64)
    alive = np.ones(n, bool)
    for b in bounds[1:-1].tolist():
        alive[max(b - width + 1, 0) : b] = False
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
    fewest = max(least, times) - width + 1
    bits = max(10, int(4 * n).bit_length())
    for _ in range(ROUNDS):
        at = np.flatnonzero(alive)
        key = (mix64(gram[at] ^ mix64(owner[at].astype(np.uint64))) >> np.uint64(64 - bits)).astype(np.int64)
        again = np.bincount(key, minlength=1 << bits)[key] > 1
        alive[at[~again]] = False
        edge = np.flatnonzero(np.diff(alive, prepend=False, append=False))
        start, end = edge[0::2], edge[1::2]
        # stretches of different texts may touch
        cut = bounds[1:-1][alive[np.minimum(bounds[1:-1], n - 1)] & (bounds[1:-1] < n) & (bounds[1:-1] > 0)]
        cut = cut[alive[cut - 1]]
        start, end = np.sort(np.append(start, cut)), np.sort(np.append(end, cut))
        short = end - start < fewest
        for s, e in zip(start[short].tolist(), end[short].tolist(), strict=True):
            alive[s:e] = False
        start, end = start[~short], end[~short]
        owner = np.zeros(n, np.int64)
        for k, (s, e) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
            owner[s:e] = k
        if not short.any() and again.all():
            break
    return list(zip(start.tolist(), (end + width - 1).tolist(), strict=True))


class Ranks:
    """Ranks of all stretches of 2^k symbols, and what they tell. The symbols
    end in one that occurs nowhere else."""

    def __init__(self, symbols: np.ndarray):
        _, rank = np.unique(symbols, return_inverse=True)
        self.n, self.levels = len(rank), [rank.astype(np.int64)]
        while self.levels[-1].max() + 1 < self.n:
            step, low = 1 << (len(self.levels) - 1), self.levels[-1]
            high = np.zeros(self.n, np.int64)
            high[:-step] = low[step:] + 1
            _, rank = np.unique(low * (self.n + 1) + high, return_inverse=True)
            self.levels.append(rank)

    def suffixes(self) -> np.ndarray:
        order = np.empty(self.n, np.int64)
        order[self.levels[-1]] = np.arange(self.n)
        return order

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols agree from i and from j on (i <> j)."""
        i, j, agreed = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            inside = np.maximum(i, j) < self.n
            same = inside & (self.levels[k][np.minimum(i, self.n - 1)] == self.levels[k][np.minimum(j, self.n - 1)])
            step = same.astype(np.int64) << k
            i += step
            j += step
            agreed += step
        return agreed

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols agree up to i and up to j, these included (i <> j)."""
        i, j, agreed = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - (1 << k) + 1, j - (1 << k) + 1
            same = (np.minimum(a, b) >= 0) & (self.levels[k][np.maximum(a, 0)] == self.levels[k][np.maximum(b, 0)])
            step = same.astype(np.int64) << k
            i -= step
            j -= step
            agreed += step
        return agreed


def previous_factors(ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """LPF: the longest stretch from each position that also starts earlier, and
    where it does (-1: nowhere)."""
    before, after = [-1] * ranks.n, [-1] * ranks.n
    stack: list[int] = []
    for at in ranks.suffixes().tolist():
        while stack and stack[-1] > at:
            after[stack.pop()] = at
        if stack:
            before[at] = stack[-1]
        stack.append(at)
    here = np.arange(ranks.n)
    best, source = np.zeros(ranks.n, np.int64), np.full(ranks.n, -1)
    for other in (np.array(before), np.array(after)):
        some = other >= 0
        agreed = np.zeros(ranks.n, np.int64)
        agreed[some] = ranks.ahead(here[some], other[some])
        better = agreed > best
        best[better], source[better] = agreed[better], other[better]
    return best, source


def find_runs(parts: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[Runs]:
    """The runs of each sequence of word numbers."""
    if not parts:
        return []
    sizes = np.array([len(p) for p in parts])
    base = np.cumsum(sizes + 1) - sizes - 1
    most = max(int(p.max(initial=0)) for p in parts) + 2
    symbols = np.concatenate([np.append(p.astype(np.int64) + 1, 0) + k * most for k, p in enumerate(parts)])
    ranks = Ranks(symbols)
    longest, source = (x.tolist() for x in previous_factors(ranks))

    blocks: list[list[tuple[int, int, int]]] = []  # (start, length, previous occurrence)
    edges, low, high, reach = [], [], [], []
    for first, size in zip(base.tolist(), sizes.tolist(), strict=True):
        own, at, before = [], first, 0
        while at < first + size:
            length = max(1, longest[at])
            own.append((at, length, source[at] if longest[at] else -1))
            edges.append(at)
            reach.append(before + length)
            before = length
            at += length
        edges.append(first + size)
        reach.append(before)
        low += [first] * (len(own) + 1)
        high += [first + size] * (len(own) + 1)
        blocks.append(own)

    periods = (np.array(reach, np.int64) + times - 2) // (times - 1)
    at = np.repeat(np.array(edges, np.int64), periods)
    low, high = np.repeat(np.array(low, np.int64), periods), np.repeat(np.array(high, np.int64), periods)
    period = np.arange(len(at)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    found: dict[int, dict[int, int]] = defaultdict(dict)  # start -> length -> period
    for shift in (0, 1):
        left = at - shift * period
        fits = (left >= low) & (left + period <= high)
        left, p = left[fits], period[fits]
        back = np.zeros(len(left), np.int64)
        some = left > 0
        back[some] = ranks.behind(left[some] - 1, left[some] - 1 + p[some])
        length = ranks.ahead(left, left + p) + back + p
        good = length >= np.maximum(least, times * p)
        for s, n, q in zip((left - back)[good].tolist(), length[good].tolist(), p[good].tolist(), strict=True):
            found[s][n] = min(q, found[s].get(n, q))

    out: list[Runs] = []
    for first, size, own in zip(base.tolist(), sizes.tolist(), blocks, strict=True):
        for at, length, source_at in own:
            if source_at >= 0 and length > least:
                for s in range(source_at + 1, source_at + length - least):
                    if s in found:
                        for n, q in list(found[s].items()):
                            if s + n < source_at + length:
                                found[s + at - source_at][n] = q
        own_runs = [(s - first, n, q) for s in range(first, first + size) if s in found for n, q in found[s].items()]
        out.append(sorted(own_runs, key=lambda r: (r[0], r[2])))
    return out


def numbered(raw: bytes, number: dict[bytes, int]) -> np.ndarray:
    """The words of a text as numbers, piece by piece."""
    parts = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in pieces(raw)]
    return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.int64), *parts])


def pieces(raw: bytes, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of parts of a text, cut at a blank."""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + most) if len(raw) - at > most else -1
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def kept_words(n: int, runs: Runs) -> np.ndarray | None:
    """Which words stay: all but those after the first period of a run."""
    if not runs:
        return None
    stay = np.ones(n, bool)
    for start, length, period in runs:
        stay[start + period : start + length] = False
    return stay


def collapsed(raw: bytes, stay: np.ndarray | None) -> bytes:
    parts, at = [], 0
    for words in pieces(raw):
        if stay is not None:
            at, words = at + len(words), list(compress(words, stay[at : at + len(words)].tolist()))
        if words:
            parts.append(b" ".join(words))
    return b" ".join(parts)


def strongest(runs: Runs) -> dict | None:
    """The run of the greatest length / period; ties: smallest start, then period."""
    best = None
    for start, length, period in runs:
        if best is None or length * best["period"] > best["length"] * period:
            best = {"start": start, "length": length, "period": period}
    return best


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
MADE = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("best", RUN), T.StructField("collapsed", T.StringType())])
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def collapse(docs: DataFrame, least: int = LEAST, times: int = TIMES, text: str = "text", doc_id: str = "doc_id", reading: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """``docs`` with n_words, all ``runs`` (start and length in words, period; by
    start, then period), the ``best`` of them, and ``collapsed``: the words but
    for those of a run after its first period, joined by a space.

    ``reading`` may give, for an id and a number of words, another order in which
    the words are read (their numbers from 0, repeats allowed); None: as they are."""
    rows = docs.drop(*[c for c in MADE.names if c != text])
    schema = T.StructType([*rows.schema.fields, *MADE.fields])
    names, where = rows.columns, (rows.columns.index(text), rows.columns.index(doc_id))

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        raw = raw_texts(batch.column(where[0]))
        number: dict[bytes, int] = defaultdict(count().__next__)
        ids = [numbered(x, number) for x in raw]
        if reading:
            for k, key in enumerate(batch.column(where[1]).to_pylist()):
                order = reading(key, len(ids[k])) if len(ids[k]) else None
                if order is not None:
                    own = raw[k].split()
                    ids[k], raw[k] = ids[k][order], b" ".join([own[i] for i in order.tolist()])
        bounds = np.cumsum([0, *map(len, ids)])
        flat = np.concatenate([np.empty(0, np.int64), *ids])
        ranges = lively(flat, bounds, least, times)
        runs: list[Runs] = [[] for _ in raw]
        for (s, e), found in zip(ranges, find_runs([flat[s:e] for s, e in ranges], least, times), strict=True):
            k = int(np.searchsorted(bounds, s, "right")) - 1
            runs[k] += [(s - int(bounds[k]) + start, n, q) for start, n, q in found]
        runs = [sorted(set(x), key=lambda r: (r[0], r[2])) for x in runs]
        made = [collapsed(x, kept_words(len(n), r)) for x, n, r in zip(raw, ids, runs, strict=True)]
        told = [[{"start": s, "length": n, "period": q} for s, n, q in x] for x in runs]
        return [pa.array([len(x) for x in ids], pa.int64()), pa.array(told, pa.list_(_RUN)), pa.array([strongest(x) for x in runs], _RUN), pa.array(made, pa.binary()).cast(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = [x or 0 for x in pc.binary_length(whole.column(where[0]).cast(pa.binary())).to_pylist()]
            for low, high in chunks([range(n) for n in sizes], AT_ONCE):
                batch = whole.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*batch.columns, *work(batch)], names=[*names, *MADE.names])
        give_back()

    return rows.mapInArrow(run, schema)


def digest(runs) -> object:
    """Each run as ``start,length,period`` and a line feed."""
    said = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return F.sha2(F.array_join(said, ""), 256)
