"""Line dedup by deletion neighbourhoods.

A line is compared in normal form: its words joined by single spaces, A-Z in
lower case. A line goes if an earlier one (by document id, then line number)
is equal, or within the edit bound: one character put in, left out or replaced,
if both lines have at least ``PER_EDIT`` characters. (The bound is one edit for
that many characters, one at most: "page 1" and "page 2" are different lines.)

Equal lines are grouped by a 128-bit hash of the line; only the first of each
group goes on. Emitting every line's deletion variants would multiply the
corpus by the length of its lines, so a lossless sieve comes first: an
edit touches one of two halves of a line, so two lines within the bound
share a hash of the other one. Lines that share none have no neighbour. A key
of the sieve may belong to any number of lines (of one template, say), so keys
are aggregated first, and the join with those that several lines share deals
out the lines of a key. The lines left emit all variants with one character
deleted, and themselves, as hashed keys; variants that are equal at equal
positions come from a replacement, a variant that equals a whole line from an
insertion. Lines of one variant differ in one character that was put into it, so
however large the corpus is, they are no more than its length times the
alphabet. Of each key only the earliest line counts; each remaining pair (line,
earliest neighbour) is verified with the edit distance of the texts.

Defined cases: lines without a word are kept and never compared; null and
empty texts stay as they are, with no lines; rows with the same id and the same
text count as one document and each keep what it keeps; null ids come first;
lines of any length take the same path; an empty table gives an empty result;
other columns are passed through, whatever their names, but for ones with the
names of the results, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_salted, materialize, packed, small_or_plain
from .hashing import Ranges, chunks, give_back, mix64, raw_texts, slices

PER_EDIT = 24
SEGMENTS = 2
KEYS = [f"key{k}" for k in range(2 * SEGMENTS)]


def normal(line: bytes) -> bytes:
    """bytes.split() and lower() know ASCII only, as is wanted."""
    return b" ".join(line.split()).lower()


class Lines:
    """The normal forms of all lines with a word of some texts, hashed."""

    def __init__(self, raw: list[bytes]):
        text, number, forms = [], [], []
        for k, x in enumerate(raw):
            for i, line in enumerate(x.split(b"\n")):
                if form := normal(line):
                    text.append(k)
                    number.append(i)
                    forms.append(form)
        self.text, self.number, self.forms = np.array(text, np.int64), np.array(number, np.int64), forms
        codes = np.frombuffer((b"\n".join(forms) + b"\n").decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        self.end = np.flatnonzero(codes == 10) if forms else np.empty(0, np.int64)
        self.start = np.append(0, self.end[:-1] + 1) if forms else self.end
        self.size = self.end - self.start
        self.hash = Ranges(mix64(codes.astype(np.uint64) + np.uint64(77)))
        self.check = Ranges(mix64(codes.astype(np.uint64) + np.uint64(7_777_777)))

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(mix64(r.of(self.start, self.end) + self.size.astype(np.uint64)).view(np.int64) for r in (self.hash, self.check))

    def sieve(self, some: np.ndarray) -> np.ndarray:
        """(2 * SEGMENTS, lines) keys of all but one segment: with the line's
        own length, and with a length less by one, as a line that has one
        character more than its neighbour must match it."""
        start, end, keys = self.start[some], self.end[some], []
        for less in (0, 1):
            size = end - start - less
            for j in range(SEGMENTS):
                low, high = size * j // SEGMENTS, size * (j + 1) // SEGMENTS
                left, right = self.hash.of(start, start + low), self.hash.of(end - (size - high), end)
                keys.append(mix64(left ^ mix64(right + np.uint64(31 * j + 1)) ^ mix64(size.astype(np.uint64))))
        return np.stack(keys).view(np.int64)

    def variants(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of line k without each of its characters, then of the whole
        line: equal keys for equal contents."""
        s, e = int(self.start[k]), int(self.end[k])
        at = np.arange(s, e)
        out = []
        for r in (self.hash, self.check):
            left, right = r.sums[at] - r.sums[s], (r.sums[e] - r.sums[at + 1]) * r.down[1]
            content = np.append(left + right, r.sums[e : e + 1] - r.sums[s]) * r.down[s]
            size = np.append(np.full(e - s, e - s - 1), e - s).astype(np.uint64)
            out.append(mix64(content + size * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
        return out[0], out[1]


def _batches(batch: pa.RecordBatch, position: int):
    raw = raw_texts(batch.column(position))
    for first, last in chunks(raw):
        yield first, Lines(raw[first:last])


def line_rows(docs: DataFrame, id_type: str) -> DataFrame:
    """(doc_id, th, line, h1, h2, size, key0, ...): every line with a word, and
    its keys of the sieve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            for first, lines in _batches(batch, 2):
                at = pa.array(lines.text + first)
                keys = lines.sieve(np.arange(len(lines.size))) if len(lines.size) else np.empty((len(KEYS), 0), np.int64)
                values = [lines.number, *lines.ids(), lines.size.astype(np.int64), *keys]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, values)], names=["doc_id", "th", "line", "h1", "h2", "size", *KEYS])
        give_back()

    return docs.mapInArrow(run, f"doc_id {id_type}, th long, line long, h1 long, h2 long, size long, {', '.join(f'{k} long' for k in KEYS)}")


def variant_rows(docs: DataFrame, id_type: str) -> DataFrame:
    """(doc_id, th, text, wanted: array of line, h1, h2) -> (key, check, pos,
    doc_id, th, line, form): pos -1 and the text for the whole line."""
    names = ["key", "check", "pos", "doc_id", "th", "line", "form"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for r in range(whole.num_rows):
                batch = whole.slice(r, 1)
                wanted = {(w["line"], w["h1"], w["h2"]) for w in batch.column(3)[0].as_py()}
                for _, lines in _batches(batch, 2):
                    h1, h2 = lines.ids()
                    for k, own in enumerate(zip(lines.number.tolist(), h1.tolist(), h2.tolist(), strict=True)):
                        if own not in wanted:
                            continue
                        key, check = lines.variants(k)
                        n = len(key)
                        pos = np.append(np.arange(n - 1), -1)
                        form = pa.array([None] * (n - 1) + [lines.forms[k].decode("utf-8", "replace")], pa.string())
                        at = pa.array(np.zeros(n, np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(check), pa.array(pos.astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at), pa.array(np.full(n, own[0])), form], names=names)
        give_back()

    return docs.mapInArrow(run, f"key long, check long, pos int, doc_id {id_type}, th long, line long, form string")


def near_copies(docs: DataFrame, firsts: DataFrame, id_type: str) -> DataFrame:
    """(doc_id, th, line) of first occurrences that lie within the bound of an
    earlier one."""
    long_enough = firsts.where(F.col("size") >= PER_EDIT)
    keyed = lambda *more: long_enough.select("h1", F.explode(F.array(*KEYS)).alias("key"), *more)
    shared = keyed().groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("key")
    shared = materialize(shared)
    involved = join_salted(keyed("doc_id", "th", "line", "h2"), shared, ["key"], "h1").drop("key").distinct()
    wanted = involved.groupBy(F.col("doc_id").alias("w_id"), F.col("th").alias("w_th")).agg(F.collect_list(F.struct("line", "h1", "h2")).alias("wanted"))
    wanted, _ = small_or_plain(materialize(wanted))
    some = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th"))).select("doc_id", "th", "text", "wanted")
    rows = variant_rows(some.dropDuplicates(["doc_id", "th"]), id_type)

    first = F.struct("doc_id", "th", "line")
    own = W.partitionBy("key", "check")
    # the earliest whole line, and the earliest variant, of equal contents; the earliest of equal position
    rows = rows.withColumn("first", first).withColumn("full", F.min(F.when(F.col("pos") < 0, first)).over(own)).withColumn("cut", F.min(F.when(F.col("pos") >= 0, first)).over(own))
    rows = rows.withColumn("same", F.min("first").over(W.partitionBy("key", "check", "pos")))
    other = F.when(F.col("pos") < 0, F.col("cut")).otherwise(F.least("full", "same"))
    found = rows.where(other < F.col("first")).groupBy("first").agg(F.min(other).alias("other"))
    found = materialize(found)
    forms, _ = small_or_plain(materialize(rows.where("pos < 0").select("first", "form")))
    for end in ("first", "other"):
        said = forms.select(F.col("first").alias("f"), F.col("form").alias(f"form_{end}"))
        found = found.join(said, (F.col(f"{end}.doc_id").eqNullSafe(F.col("f.doc_id"))) & (F.col(f"{end}.th") == F.col("f.th")) & (F.col(f"{end}.line") == F.col("f.line"))).drop("f")
    return found.where(F.levenshtein("form_first", "form_other", 1) >= 0).select("first.doc_id", "first.th", "first.line")


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``text`` reduced to the lines that stay, and n_lines,
    n_kept (lines with a word before and after) and n_near (lines that went
    for a near copy only)."""
    docs = docs.drop("n_lines", "n_kept", "n_near")
    names, id_type = docs.columns, dict(docs.dtypes)[doc_id]
    docs, rest = packed(docs, doc_id, text)
    docs = docs.withColumnsRenamed({doc_id: "doc_id", text: "text"}).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    slim = docs.select("doc_id", "th", "text")
    rows = line_rows(slim, id_type)
    firsts = rows.groupBy("h1", "h2", "size").agg(F.min(F.struct("doc_id", "th", "line")).alias("f"), *[F.first(k).alias(k) for k in KEYS])
    firsts = materialize(firsts.select("f.doc_id", "f.th", "f.line", "h1", "h2", "size", *KEYS))
    near = near_copies(slim, firsts, id_type).withColumn("near", F.lit(True))
    marks = firsts.select("doc_id", "th", "line").alias("a").join(near.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th")) & (F.col("a.line") == F.col("b.line")), "left")
    kept = marks.groupBy(F.col("a.doc_id").alias("k_id"), F.col("a.th").alias("k_th")).agg(F.collect_list(F.when(F.col("near").isNull(), F.col("a.line"))).alias("k_lines"), F.count("near").alias("k_near"))
    out = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("th") == F.col("k_th")), "left")
    out = out.select("doc_id", "text", *(["__rest"] if rest else []), "k_lines", "k_near")
    position, width = 1, len(out.columns) - 2
    schema = T.StructType([*out.schema.fields[:width], *[T.StructField(n, T.LongType()) for n in ("n_lines", "n_kept", "n_near")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            texts, counts = [], []
            for raw, lines in zip(batch.column(position).cast(pa.binary()).to_pylist(), batch.column(width).to_pylist(), strict=True):
                stay, parts, n = set(lines or ()), [], 0
                for i, line in enumerate((raw or b"").split(b"\n")):
                    word = bool(line.split())
                    n += word
                    if not word or i in stay:
                        parts.append(line)
                texts.append(None if raw is None else b"\n".join(parts) if stay or not n else b"")
                counts.append((n, len(stay)))
            columns = list(batch.columns[:width])
            columns[position] = pa.array(texts, pa.binary()).cast(pa.string())
            columns += [pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1)] + [batch.column(width + 1).fill_null(0)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])
        give_back()

    done = out.mapInArrow(run, schema)
    back = {doc_id: F.col("doc_id").alias(doc_id), text: F.col("text").alias(text)} | {n: c for n, c in zip([n for n in names if n not in (doc_id, text)], rest, strict=True)}
    return done.select(*[back[n] for n in names], "n_lines", "n_kept", "n_near")
