"""Personal data: pattern spans, and more from a character-level tagger.

Four kinds are found: email, ip, card, phone. The base spans are those of fixed
patterns with checks (parts of an address up to 255, Luhn's sum, numbers of
digits). A bidirectional LSTM with CRF transitions adds spans that the patterns
miss because they are written around (``name (at) host dot org``, a
phone number without its plus sign, card groups joined by dots). It is trained
in numpy from labelled spans: snippets of a bounded sample of documents into
which spans made by rule, and look-alikes that are none, were set, besides
the base spans found in the snippets. Every tagged span must pass the check of
its kind and must not touch a base span.

Texts are read in windows of 48 characters every 24. The emissions of
overlapping windows are averaged, a window weighing most in its middle, and one
likeliest path runs over all of them, so the windows are reconciled globally.
Every span that passes its check has a digit, an at sign or the word ``at``:
first come all windows that hold one, in stretches of neighbouring windows, and
a stretch whose first or last 24 characters have a tag doubles on that side
until none has. Windows beyond hold no span and aren't read.

Positions are code points, ends exclusive. Defined cases: a null text is
empty; empty and blank texts have no spans; very long texts are tagged in
batches of bounded size; rows are independent, so repeated rows have repeated
results; other columns are passed through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bilstm_crf import Tagger, best_paths
from .common import first_by_hash

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

WINDOW, STRIDE = 48, 24
BATCH = 1024
SNIPPETS, SNIPPET = 600, 160


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, low, at = [], 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        low = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            low = m.end()
        at = text.find("@", low)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    found = [(0, s, e) for s, e in emails(text)]
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((3, m.start(), m.end()))
    return found


# ---- the tagger --------------------------------------------------------------

#: Character classes: 1 to 95 printable ASCII, 96 other letters, 97 the rest.
CLASSES = 98


def char_classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = np.where(codes >= 0xC0, 96, 97).astype(np.int64)
    plain = (codes >= 32) & (codes < 127)
    out[plain] = codes[plain] - 31
    out[(codes >= 9) & (codes <= 13)] = 1
    return out


TAGS = 1 + 2 * len(KINDS)  # none; of each kind first and further characters


def tag_ids(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for kind, s, e in spans:
        tags[s:e] = 2 + 2 * kind
        tags[s : s + 1] = 1 + 2 * kind
    return tags


AT = re.compile(r"\s?(?:@|\(at\)|\[at\]|\sat\s)\s?", re.I)
DOT = re.compile(r"\s?(?:\.|\(dot\)|\[dot\]|\sdot\s)\s?", re.I)


def plausible(kind: int, found: str) -> bool:
    """The check that a tagged span of a kind has to pass."""
    digits = "".join(c for c in found if "0" <= c <= "9")
    if kind == 0:
        sides = AT.split(found)
        if len(sides) != 2:
            return False
        hosts = DOT.split(sides[1])
        plain = re.compile(r"[A-Za-z0-9._%+-]+")
        return len(hosts) > 1 and bool(plain.fullmatch(sides[0])) and all(re.fullmatch(r"[A-Za-z0-9-]+", h) for h in hosts) and len(hosts[-1]) in (2, 3, 4)
    if kind == 1:
        parts = re.split(r"\s?(?:\[?\.\]?|\(\.\)|\[dot\]|\(dot\)|\sdot\s)\s?", found)
        return len(parts) == 4 and all(re.fullmatch(r"[0-9]{1,3}", x) and int(x) <= 255 for x in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(r"[0-9](?:[ ._/-]{0,2}[0-9])+", found))
    groups = re.findall(r"[0-9]+", found)
    return 9 <= len(digits) <= 15 and len(groups) >= 3 and max(map(len, groups)) <= 4 and bool(re.fullmatch(r"(?:\+|00)?[0-9(][ ().0-9/-]+[0-9]", found))


def made_span(rng: np.random.Generator, letters: list[str]) -> tuple[int, str]:
    """A kind and a span of it, by rule; kind -1 is a look-alike that is none."""
    word = lambda: letters[rng.integers(len(letters))]
    number = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    pick = lambda *x: x[rng.integers(len(x))]
    kind = int(rng.choice([-1, 0, 1, 2, 3], p=[0.28, 0.2, 0.16, 0.16, 0.2]))
    if kind == 0:
        at, dot = pick(("@", "."), ("@", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", "."))
        return kind, f"{word()}{pick('', '.', '_')}{pick(word(), number(2))}{at}{word()}{dot}{pick('com', 'org', 'net', 'example.com', 'de', 'fr')}"
    if kind == 1:
        return kind, pick(".", ".", "[.]", " . ", "(.)").join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        body = number(15)
        digits = next(body + c for c in "0123456789" if luhn(body + c))
        return kind, pick(" ", "-", "", ".", "/", "_").join(digits[k : k + 4] for k in range(0, 16, 4))
    if kind == 3:
        a, b, c, d = number(pick(1, 2)), number(3), number(3), number(4)
        return kind, pick(f"+{a} ({b}) {c}-{d}", f"+{a} {b} {c} {d}", f"({b}) {c}-{d}", f"{b}-{c}-{d}", f"{b}.{c}.{d}", f"00{a} {b} {c} {d}")
    return kind, pick(f"{rng.integers(1990, 2030)}-{number(2)}-{number(2)}", f"{number(2)}:{number(2)}", f"{number(1)}.{number(1)}.{number(2)}", number(pick(2, 4, 6, 12)), f"{number(3)}.{number(2)}", f"key={number(3)}{word()}{number(5)}", f"{word()}@{word()}", f"#{number(5)}", f"{number(2)},{number(3)}", f"at {word()}", f"{number(3)}-{number(4)}")


def train(snippets: list[str], seed: int = 3, windows: int = 1500) -> Tagger:
    """A tagger from labelled windows made of snippets of real text."""
    rng = np.random.default_rng(seed)
    snippets = [s for s in snippets if len(s) >= 8] or ["the quick brown fox jumps over the lazy dog and runs away again"]
    letters = [w for s in snippets for w in re.findall(r"[A-Za-z]{3,9}", s)] or ["anna", "mail", "host"]
    ids, tags = np.full((windows, WINDOW), 1, np.int64), np.zeros((windows, WINDOW), np.int64)
    for k in range(windows):
        around = snippets[rng.integers(len(snippets))]
        text, spans = around, []
        if rng.random() < 0.85:
            kind, made = made_span(rng, letters)
            cut = int(rng.integers(0, len(around)))
            cut = max(around.rfind(" ", 0, cut), around.rfind("\n", 0, cut)) + 1
            text = f"{around[:cut]}{made}{' '[: rng.integers(2)] or ', '}{around[cut:]}"
            if kind >= 0:
                spans = [(kind, cut, cut + len(made))]
            middle = cut + int(rng.integers(0, max(1, len(made))))
        else:
            middle = int(rng.integers(0, len(text)))
        spans += [x for x in base_spans(text) if all(x[2] <= s or x[1] >= e for _, s, e in spans)]
        start = max(0, min(middle - int(rng.integers(8, WINDOW - 8)), len(text) - WINDOW))
        part = slice(start, start + WINDOW)
        found = char_classes(text)[part]
        ids[k, : len(found)] = found
        tags[k, : len(found)] = tag_ids(len(text), spans)[part]
    # a further character follows a first or further one of its kind
    unlike = tuple((a, b) for b in range(2, TAGS, 2) for a in range(TAGS) if a not in (b - 1, b))
    tagger = Tagger(CLASSES, TAGS, unlike=unlike)
    tagger.fit(ids, tags)
    return tagger


def fit(docs: DataFrame, text: str = "text") -> Tagger:
    """Train on snippets of at most ``SNIPPETS`` documents, the first by a hash
    of their texts; each snippet starts at a hashed offset."""
    some = docs.select(F.coalesce(text, F.lit("")).alias("t")).where(F.length("t") > 0)
    some = some.select(F.xxhash64("t").alias("h"), F.substring("t", F.pmod(F.xxhash64("t"), F.greatest(F.length("t") - SNIPPET, F.lit(1))).cast("int") + 1, F.lit(SNIPPET)).alias("s"))
    return train([r["s"] for r in first_by_hash(some, SNIPPETS, "h", "s").collect()])


TRIGGER = re.compile(r"[0-9@]|\bat\b", re.I)
WEIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a trigger."""
    starts: dict[int, None] = {}
    last = -1
    for m in TRIGGER.finditer(text):
        k = m.start() // STRIDE
        if k != last:
            last = k
            starts[max(0, (k - 1) * STRIDE)] = None
            starts[k * STRIDE] = None
    return list(starts)


def stretches(size: int, windows: dict[int, np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """(start, emissions) of each run of neighbouring windows of a text."""
    starts = sorted(windows)
    cut = [k for k in range(1, len(starts)) if starts[k] != starts[k - 1] + STRIDE]
    out = []
    for low, high in zip([0, *cut], [*cut, len(starts)], strict=True):
        first = starts[low]
        total = np.zeros((starts[high - 1] - first + WINDOW, TAGS), np.float32)
        weight = np.zeros((len(total), 1), np.float32)
        for s in starts[low:high]:
            total[s - first : s - first + WINDOW] += windows[s] * WEIGHT
            weight[s - first : s - first + WINDOW] += WEIGHT
        out.append((first, (total / weight)[: size - first]))
    return out


def tag_texts(texts: list[str], tagger: Tagger) -> list[list[tuple[int, np.ndarray]]]:
    """Of each text the tags of its stretches, by start."""
    windows: list[dict[int, np.ndarray]] = [{} for _ in texts]
    tags: list[list[tuple[int, np.ndarray]]] = [[] for _ in texts]
    jobs = [(k, s) for k, t in enumerate(texts) for s in window_starts(t)]
    while jobs:
        for at in range(0, len(jobs), BATCH):
            some = jobs[at : at + BATCH]
            ids = np.full((len(some), WINDOW), 1, np.int64)
            for i, (k, s) in enumerate(some):
                found = char_classes(texts[k][s : s + WINDOW])
                ids[i, : len(found)] = found
            for (k, s), e in zip(some, tagger.emissions(ids), strict=True):
                windows[k][s] = e
        changed = dict.fromkeys(k for k, _ in jobs)
        parts = [(k, s, e) for k in changed for s, e in stretches(len(texts[k]), windows[k])]
        ends = np.cumsum([len(e) for _, _, e in parts])
        path = best_paths(np.concatenate([e for _, _, e in parts]), np.append(0, ends[:-1]), ends, tagger.p["move"])
        jobs = []
        for k in changed:
            tags[k] = []
        for (k, s, e), end in zip(parts, ends.tolist(), strict=True):
            own = path[end - len(e) : end]
            tags[k].append((s, own))
            more = len(own) // STRIDE  # doubled, so that long runs take few rounds
            if own[:STRIDE].any():
                jobs += [(k, x) for x in range(s - STRIDE, max(s - more * STRIDE, 0) - 1, -STRIDE)]
            if s + len(own) < len(texts[k]) and own[-STRIDE:].any():
                last = s + len(own) - WINDOW
                jobs += [(k, x) for x in range(last + STRIDE, min(last + more * STRIDE + 1, len(texts[k]) - STRIDE), STRIDE)]
        jobs = list(dict.fromkeys(x for x in jobs if x[1] not in windows[x[0]]))
    return tags


def tagged_spans(text: str, tags: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int]]:
    """Runs of tags that pass their checks."""
    runs: list[list[int]] = []
    for start, own in tags:
        for j in np.flatnonzero(own).tolist():
            at, kind, first = start + j, (int(own[j]) - 1) // 2, own[j] % 2
            if runs and runs[-1][2] == at and runs[-1][0] == kind and not first:
                runs[-1][2] = at + 1
            else:
                runs.append([kind, at, at + 1])
    found = []
    for kind, s, e in runs:
        e = min(e, len(text))
        while s < e and text[s].isspace():
            s += 1
        while e > s and (text[e - 1].isspace() or text[e - 1] in ".,;:"):
            e -= 1
        edge = (s == 0 or not text[s - 1].isalnum()) and (e == len(text) or not text[e].isalnum())
        if e > s and edge and plausible(kind, text[s:e]):
            found.append((kind, s, e))
    return found


def find(docs: DataFrame, tagger: Tagger, text: str = "text", target: str = "spans") -> DataFrame:
    """``docs`` with ``target``: all spans as an array of (kind, start, end,
    base), by kind in the order of ``KINDS`` and by start."""
    docs = docs.drop(target)
    position = docs.columns.index(text)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])
    schema = T.StructType([*docs.schema.fields, T.StructField(target, T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [t or "" for t in batch.column(position).to_pylist()]
                made = []
                for t, tags in zip(texts, tag_texts(texts, tagger), strict=True):
                    base = base_spans(t)
                    more = [x for x in tagged_spans(t, tags) if all(x[2] <= s or x[1] >= e for _, s, e in base)]
                    both = sorted([(*x, True) for x in base] + [(*x, False) for x in more])
                    made.append([{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in both])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, arrow)], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)
