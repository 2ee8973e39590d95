"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters and digits to the
letters they imitate, everything else that is no letter or digit to a word
break. The lexicon is learned from labelled documents: whole words and word
beginnings of 4 to 6 letters whose document frequency among toxic documents is
significantly higher, each weighted by its smoothed log odds. At each word the
longest entry counts once. Exception phrases (a word before or after an entry)
that are known from clean documents only, or are given, cancel the entries in
them. The sum of weights is divided by the logarithm of the length and mapped
to 0..1 by a logistic curve fitted on the same labelled documents.

Labels are read of at most ``MAX_TOXIC`` + ``MAX_CLEAN`` documents (the first by
a hash of their ids) whose crc32(doc_id) mod 5 isn't 0; every document is scored,
over its whole text. lang, source, labels and ids are no inputs of a score. The
lexicon and the exceptions have no limit of their own; that of the labelled
documents bounds them. The curve takes each labelled id once, with the mean of
its rows.

Defined cases: null, empty and blank texts have no matches and get the score
of a text without any; without labels of both kinds every score is 0; repeated
rows are scored alike; very long texts are matched in one pass like any others;
an id labelled both ways counts as toxic; an empty table gives an empty result;
other columns are passed through, but for one with the name of the result, which
is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import first_by_hash, materialize
from .hashing import raw_texts

MAX_TOXIC, MAX_CLEAN = 8_000, 16_000
PREFIXES = (4, 5, 6)

#: Characters that imitate others.
IMITATED = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ο": "o", "ε": "e", "ι": "i", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "κ": "k", "χ": "x", "ı": "i",
}


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        if 0xFF01 <= code <= 0xFF5E:  # full width
            c = chr(code - 0xFEE0).lower()
        c = IMITATED.get(c, c)
        if 0x200B <= code <= 0x200D or code == 0xAD:  # invisible
            c = ""
        self[code] = c = c if not c or c.isalnum() else " "
        return c


_fold = _Fold()


def fold(text: str) -> list[str]:
    """The folded words of a text."""
    return text.lower().translate(_fold).split()


def features(words: list[str]) -> set[str]:
    """Entries that a text could match: ``" word "`` and ``" begin"``."""
    found = set()
    for w in set(words):
        if len(w) > 2:
            found.add(f" {w} ")
            found.update(f" {w[:n]}" for n in PREFIXES if len(w) >= n)
    return found


def training_ids(labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> DataFrame:
    """(train_id, toxic) of a bounded number of labelled rows."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    known = known.withColumn("h", F.xxhash64("doc_id"))
    some = [first_by_hash(known.where(F.col("toxic") == k), n, "h", "doc_id") for k, n in ((1, max_toxic), (0, max_clean))]
    return some[0].union(some[1]).select(F.col("doc_id").alias("train_id"), F.col("toxic").cast("int").alias("toxic"))


def _counted(docs: DataFrame, items) -> DataFrame:
    """Document frequency of each item in toxic and in clean documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter, Counter] = Counter(), Counter()
            for raw, toxic in zip(raw_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                counts[toxic].update(items(fold(raw.decode("utf-8", "replace"))))
            keys = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([counts[k][x] for x in keys], pa.int64()) for k in (0, 1)]], names=["item", "clean", "toxic"])

    return docs.select("text", "toxic").mapInArrow(run, "item string, clean long, toxic long").groupBy("item").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


class Model:
    """Lexicon, exceptions and the logistic curve."""

    def __init__(self, entries: dict[str, float], exceptions: list[str], slope: float = 0.0, offset: float = -30.0):
        self.entries, self.exceptions, self.slope, self.offset = entries, exceptions, slope, offset
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            made = ahocorasick.Automaton()
            for entry, weight in self.entries.items():
                made.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                made.add_word("  ".join(["", *phrase.split(), ""])[1:-1], (0, 0.0))
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def raw(self, text: str) -> float:
        """Sum of weights over the logarithm of the length."""
        words = fold(text)
        if not words or not (self.entries or self.exceptions):
            return 0.0
        spread = f" {'  '.join(words)} "
        return sum(value[1] for _, value in self.automaton.iter_long(spread)) / log(8 + len(words))

    def score(self, text: str) -> float:
        return 1 / (1 + exp(-min(max(self.slope * self.raw(text) + self.offset, -60), 60)))


def around(entries: dict[str, float]):
    """Phrases of an entry and the word before or after it, of a text."""

    def items(words: list[str]) -> set[str]:
        found = set()
        for k, w in enumerate(words):
            if f" {w} " in entries or any(f" {w[:n]}" in entries for n in PREFIXES):
                if k:
                    found.add(f"{words[k - 1]} {w}")
                if k + 1 < len(words):
                    found.add(f"{w} {words[k + 1]}")
        return found

    return items


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a lightly regularised logistic regression, by
    Newton's method, both classes weighing the same."""
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    design, beta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - 1e-2 * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        beta = beta + np.linalg.solve(hessian, gradient)
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = ()) -> Model:
    """A model of the labelled ones among ``docs`` (doc_id, text)."""
    known = F.broadcast(training_ids(labels).limit(MAX_TOXIC + MAX_CLEAN))
    some = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("train_id")).select("train_id", "text", "toxic").persist()
    try:
        size = {r["toxic"]: r["n"] for r in some.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        clean, toxic = size.get(0, 0), size.get(1, 0)
        if not clean or not toxic:
            return Model({}, list(exceptions))
        p, q = (F.col("toxic") + 0.5) / (toxic + 1.0), (F.col("clean") + 0.5) / (clean + 1.0)
        both = (F.col("toxic") + F.col("clean") + 1.0) / (toxic + clean + 2.0)
        g = 2 * (F.col("toxic") * F.log(p / both) + F.col("clean") * F.log(q / both))
        tested = materialize(_counted(some, features).where("toxic + clean >= 3"))
        least_g = 2 * log(max(tested.count(), 2))  # about one entry by chance
        found = tested.where("toxic >= 3").select("item", F.log(p / q).alias("weight"), g.alias("g")).where((F.col("weight") > 1) & (F.col("g") >= least_g))
        entries = {r["item"]: r["weight"] for r in found.orderBy(F.desc("g"), "item").collect()}
        least = max(3, clean // 2000)
        known_clean = _counted(some, around(entries)).where((F.col("toxic") == 0) & (F.col("clean") >= least))
        learned = [r["item"] for r in known_clean.orderBy(F.desc("clean"), "item").collect()]
        model = Model(entries, [*exceptions, *learned])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [model.raw(t.decode("utf-8", "replace")) for t in raw_texts(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.float64()), batch.column(2)], names=["train_id", "raw", "toxic"])

        kind = dict(some.dtypes)["train_id"]
        scored = some.mapInArrow(run, f"train_id {kind}, raw double, toxic int").groupBy("train_id").agg(F.avg("raw").alias("raw"), F.max("toxic").alias("toxic"))
        rows = sorted((r["raw"], r["toxic"]) for r in scored.select("raw", "toxic").collect())  # a row for each training id
        model.slope, model.offset = fit_curve(np.array([x for x, _ in rows]), np.array([float(y) for _, y in rows]))
        return model
    finally:
        some.unpersist()


def score(docs: DataFrame, model: Model, text: str = "text", target: str = "score") -> DataFrame:
    """``docs`` with a double column ``target`` in 0..1."""
    docs = docs.drop(target)
    position = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(target, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [round(model.score(t.decode("utf-8", "replace")), 9) for t in raw_texts(batch.column(position))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)
