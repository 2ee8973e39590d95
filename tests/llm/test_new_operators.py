"""Decontamination, periodic runs and whitening against brute force."""

import hashlib
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.llm import decontaminate, queries, runs, whitening

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- 11: runs -----------------------------------------------------------------------------


def brute_runs(w, least=6, times=4):
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def some_words(rng, most=60):
    w = [str(rng.randrange(rng.choice([1, 2, 4, 40]))) for _ in range(rng.randint(0, most))]
    for _ in range(rng.randint(0, 3)):
        unit = [str(rng.randrange(5)) for _ in range(rng.randint(1, 6))]
        at = rng.randint(0, len(w))
        w[at:at] = (unit * rng.randint(3, 8))[: rng.randint(1, 50)]
    return w + w[rng.randint(0, len(w)) :] + w if rng.random() < 0.3 else w


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (4, 3), (9, 2)])
def test_runs_of_words(least, times):
    rng = random.Random(least)
    for _ in range(60):
        many = [some_words(rng) for _ in range(rng.randint(1, 6))]
        flat = np.array([int(x) for w in many for x in w], np.int64)
        bounds = np.cumsum([0, *map(len, many)])
        assert runs.find_runs([flat[s:e] for s, e in zip(bounds, bounds[1:], strict=False)], least, times) == [brute_runs(w, least, times) for w in many]
        # nothing is lost by the sieve
        found = [set() for _ in many]
        ranges = runs.lively(flat, bounds, least, times)
        for (s, e), own in zip(ranges, runs.find_runs([flat[s:e] for s, e in ranges], least, times), strict=True):
            k = int(np.searchsorted(bounds, s, "right")) - 1
            found[k] |= {(s - bounds[k] + a, n, q) for a, n, q in own}
        assert [sorted(x) for x in found] == [sorted(brute_runs(w, least, times)) for w in many]


def test_longest_previous_factors():
    rng = random.Random(3)
    for _ in range(30):
        w = [rng.randrange(3) for _ in range(rng.randint(1, 40))]
        got, source = runs.previous_factors(runs.Ranks(np.array([*w, 9])))
        for i in range(len(w)):
            agreed = [next((k for k in range(len(w) - i) if w[i + k] != w[j + k]), len(w) - i) for j in range(i)]
            assert got[i] == max([0, *agreed]) and (got[i] == 0 or agreed[source[i]] == got[i])


def test_collapse_on_awkward_texts(spark, monkeypatch):
    monkeypatch.setattr(runs, "AT_ONCE", 300)
    rng = random.Random(7)
    texts = [None, "", " \t\n", "one", "a " * 6, "a " * 5, " ".join(some_words(rng, 4000)), "x  y\tx\ny x y x y", "é ü é ü é ü é ü", "a b " * 9]
    texts += [" ".join(some_words(rng)) for _ in range(80)]
    texts += [texts[6]] * 2
    df = spark.createDataFrame([(k if k % 11 else None, t, "s", k) for k, t in enumerate(texts)], "doc_id long, text string, runs string, place long").repartition(3)
    got = {r.place: r for r in runs.collapse(df).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        w = SPACE.findall(t or "")
        want = brute_runs(w)
        assert (got[k].n_words, [tuple(r) for r in got[k].runs], got[k].collapsed) == (len(w), want, brute_collapsed(w, want))
        assert (tuple(got[k].best) if got[k].best else None) == (max(want, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if want else None)
    assert runs.collapse(df.limit(0)).count() == 0


def test_op11_query(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(some_words(rng, 200)) + " " + " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(0, 300)))) for i in range(200)] + [(None, "a b " * 7), (400, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    from zlib import crc32

    want = []
    for i, t in rows:
        w = SPACE.findall(t or "")
        h, n = crc32(str(i).encode()), len(w)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
        found = brute_runs(w)
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else (None, None, None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(brute_collapsed(w, found))))
    got = queries.op11_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


# ---- 12: decontamination ------------------------------------------------------------------


def brute_hits(doc, items, window):
    hit, found = set(), set()
    for item, words in items:
        m = min(window, len(words))
        spans = {tuple(words[k : k + m]) for k in range(len(words) - m + 1)} if words else set()
        for k in range(len(doc) - m + 1 if spans else 0):
            if tuple(doc[k : k + m]) in spans:
                hit |= set(range(k, k + m))
                found.add(item)
    return hit, found


def tokens(text):
    return TOKEN.findall((text or "").translate(LOWER))


@pytest.mark.parametrize("part", [1 << 16, 40])
def test_decontaminate(spark, monkeypatch, part):
    monkeypatch.setattr(decontaminate, "PART_WORDS", part)  # also in many parts, with items cut
    monkeypatch.setattr(decontaminate, "AT_ONCE", 2000)
    monkeypatch.setattr(decontaminate, "PIECE", 50)
    rng = random.Random(part)
    word = lambda: rng.choice(["ab", "Cd", "é", "x1", "日本", "ß", "q"]) + str(rng.randrange(4))
    items = [(k, rng.choice([" ", ", ", "\n"]).join(word() for _ in range(rng.choice([0, 1, 3, 7, 12, 30])))) for k in range(25)] + [(3, "ab1 Cd2 é3 x11"), (50, None), (None, "null item here")]
    texts = [None, "", "...", items[4][1], "null item here", "AB1!!cd2 -- É3 é3 X11 ab1 cd2 é3 x11"]
    for _ in range(60):
        parts = [word() for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            own = (rng.choice(items)[1] or "").split()
            at, cut = rng.randint(0, len(parts)), rng.randint(0, len(own))
            parts[at:at] = own[cut : cut + rng.randint(0, 25)]
        texts.append(rng.choice([" ", " - "]).join(parts))
    texts += [" ".join(texts[9:60]), texts[20], texts[20]]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, spans string, item_id int").repartition(3)
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(df, tests, window=10).collect()}
    for k, t in enumerate(texts):
        w = tokens(t)
        hit, found = brute_hits(w, [(i, tokens(x)) for i, x in items], 10)
        r = got[k]
        assert (r.n_words, r.n_hit, r.item_ids) == (len(w), len(hit), sorted(str(i) for i in found if i is not None))
        assert {i for s in r.spans for i in range(s.first, s.end)} == hit and r.item_id == 1
        assert tokens(r.text) == [x for i, x in enumerate(w) if i not in hit] or any(s.first for s in r.spans)
        if not hit:
            assert r.text == t
    half = decontaminate.decontaminate(df, tests, most_covered=0.5).collect()
    assert all((r.text is None) == (r.n_hit > 0.5 * r.n_words or texts[r.doc_id] is None) for r in half)
    none = decontaminate.decontaminate(df, tests.limit(0)).collect()
    assert {r.n_hit for r in none} == {0} and all(r.text == texts[r.doc_id] for r in none)
    assert decontaminate.decontaminate(df.limit(0), tests).count() == 0


def test_automaton_tells_longest_matches():
    rng = random.Random(2)
    for _ in range(100):
        items = [[b"%d" % rng.randrange(3) for _ in range(rng.randint(3, 9))] for _ in range(4)]
        one = decontaminate.Automaton(3)
        own = [("i", one.add(x)) for x in items]
        one.finish(own)
        match = decontaminate.Matcher(one.packed())
        doc = [b"%d" % rng.randrange(4) for _ in range(25)]
        longest = max((n for n in range(1, 10) for k in range(25 - n + 1) if any(x[j : j + n] == doc[k : k + n] for x in items for j in range(len(x)))), default=0)
        assert match.walk(match.numbers(b" ".join(doc)).tolist(), 0, [], set()) == longest
        assert len(one.next) <= 2 * sum(map(len, items)) + 1


def test_removed_spans_take_their_separators(spark):
    item = " ".join(f"t{k}" for k in range(12))
    df = spark.createDataFrame([(1, f"Before it. {item.upper()}! After, it.")], "doc_id long, text string")
    got = decontaminate.decontaminate(df, spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert got.text == "Before it. ! After, it." and got.longest == 12


# ---- 13: whitening ------------------------------------------------------------------------


def brute_whitening(x, k):
    x = np.array(x, dtype=object)
    n, s = len(x), x.sum(0)
    c = np.array((x * n - s), dtype=float) / n
    values, u = np.linalg.eigh(c.T @ c / n)
    values, u = values[::-1], u[:, ::-1]
    return [int(v) for v in ((x * n - s) ** 2).sum(1)], (c @ u / np.sqrt(np.maximum(values, 1e-300)))[:, :k], values / values.sum(), values


@pytest.mark.parametrize(("spectrum", "expanded"), [("steep", False), ("flat", True)])
def test_whitening(spark, spectrum, expanded):
    rng = np.random.default_rng(1)
    d, n, k = 24, 700, 6
    scale = 0.35 ** np.arange(d) * 100 if spectrum == "steep" else np.linspace(3, 2.5, d)
    basis = np.linalg.qr(rng.standard_normal((d, d)))[0]
    data = ((rng.standard_normal((n, d)) * scale) @ basis).astype(np.float32) + 5
    rows = [(i, v.tolist(), "s") for i, v in enumerate(data)] + [(3, data[3].tolist(), "s"), (None, data[4].tolist(), "s")]
    odd = [(900, None, "s"), (901, [None] * d, "s"), (902, [float("nan")] * d, "s"), (903, [float("inf"), *[0.0] * (d - 1)], "s"), (904, [1.0], "s"), (905, [], "s")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n string").repartition(4)
    got = whitening.whiten(df, k, oversample=4, passes=12).collect()
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v, _ in rows]
    deviation, whitened, share, _ = brute_whitening(x, k)
    assert len(got) == len(rows) * k
    place = {i: p for p, (i, _, _) in enumerate(rows)}
    signs = {}
    for r in got:
        p = place[r.vec_id]
        sign = signs.setdefault(r.component, np.sign(r.whitened * whitened[p, r.component - 1]))
        assert r.n == len(rows) and r.deviation == deviation[p] and r.identity_error < 1e-9
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
        assert sign * r.whitened == pytest.approx(whitened[p, r.component - 1], abs=1e-7)
    model = whitening.fit(whitening.quantised(df.where("vec_id < 900"), 64, 1_000_000, "vec_id", "embedding"), k, 4, 12)
    assert model.expanded == expanded and (spectrum != "steep" or model.passes < 13)


def test_whitening_of_few_and_equal_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 5, schema)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(10)], schema)
    got = whitening.whiten(line).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1) and got[0].identity_error < 1e-9
    far = spark.createDataFrame([(1, [-3e13]), (2, [3e13])], schema)
    assert {(r.deviation, round(abs(r.whitened), 9)) for r in whitening.whiten(far).collect()} == {(None, 1.0)}


def test_deviations_beyond_64_bits_are_exact_or_null():
    x = np.array([[1 << 40, 5], [0, 7], [3, 6]], np.int64)
    sums = [int(s) for s in x.sum(0)]
    whole = np.array([s // 3 for s in sums], np.int64)
    want = [sum((3 * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]
    assert whitening.deviations(x, whole, sums, 3) == [v if v < 1 << 63 else None for v in want]


def test_new_queries_have_their_columns(spark, tmp_path):
    spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.5 * i]) for i in range(60)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op13_whitening(spark, str(tmp_path))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 180
    assert json.loads(got.select(F.to_json(F.struct("n")).alias("j")).first().j) == {"n": 60}
