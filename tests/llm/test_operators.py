"""Each operator against brute force and on awkward inputs."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brightloom.llm import bilstm_crf, bpe, chat, line_dedup, mixing, ngram_join, pii, quality, topk, toxicity, url_filter
from brightloom.llm.common import first_by_hash, n_words
from brightloom.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


def plain(seed, n):
    """Words of letters only."""
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(("ba", "ke", "li", "mo", "nu", "ra", "se", "ti", "vo", "du", "fa", "gi")) for _ in range(rng.randint(1, 4))) for _ in range(n))


def variant(text, seed, share):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else f"x{rng.randint(0, 10**6)}" for w in text.split())


@pytest.fixture(scope="module")
def texts():
    base = prose(1, 120)
    rows = [base, base, base.upper(), None, "", " \t\n ", "one two", "ONE  two", "one"]
    rows += [variant(base, s, 0.02) for s in range(30)]
    rows += [prose(s, 60) for s in range(100, 130)]
    rows += [prose(7, 40) + " " + prose(s, 10) for s in range(200, 225)]
    rows += [" ".join(prose(3, 3000).split()), "é ü 日本 " * 30]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "node", 5) for i, t in enumerate(texts)], "doc_id long, text string, node string, n long").repartition(3)


# ---- 1 ----------------------------------------------------------------------------------


def brute_components(texts):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return {i: (len(s), root[i]) for i, s in enumerate(sets)}


def test_ngram_join(docs, texts, monkeypatch):
    want = brute_components(texts)
    assert len({r for _, r in want.values()}) < len(texts) - 15
    for short, tile, hot, counted in ((4, 1024, 1024, True), (1, 8, 2, False)):  # with tiny limits all steps are taken
        monkeypatch.setattr(ngram_join, "HOT", hot)
        monkeypatch.setattr(ngram_join, "SHORT_LIST", short)
        monkeypatch.setattr(ngram_join, "TILE", tile)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(docs, counted=counted).collect()}
        assert got == want


def test_ngram_join_counts_all_links(spark, monkeypatch):
    near = prose(21, 300)
    rows = [near] + [variant(near, s, 0.012) for s in range(150)] + [near.upper(), prose(22, 60), None]
    chain = prose(23, 400).split()
    rows += [" ".join(chain[k : k + 120]) for k in range(0, 200, 8)]  # neighbours link, ends don't
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in ((t or "").lower().split() for t in rows)]
    alone = {frozenset(s) for s in sets}
    want = [sum(bool(s) and s != o and 100 * len(s & o) >= 75 * len(s | o) for o in alone) for s in sets]
    assert max(want) > 100 and want[151] == want[0] and len(set(want)) > 20
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(ngram_join, "TILE", 16)
    monkeypatch.setattr(ngram_join, "TILE_GRAMS", 4000)
    got = {r.doc_id: r.n_links for r in ngram_join.link_components(df).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_ngram_join_repeats_and_nothing(spark):
    schema = "doc_id long, text string"
    assert ngram_join.link_components(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, None)], schema)
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_join.link_components(rows).collect() if r.n_shingles)
    assert got == [(-1, 2, 5), (5, 2, 5), (5, 2, 5)]


def test_signature_bound_is_safe():
    rng = np.random.default_rng(0)
    for n, m in ((40, 60), (300, 390), (5, 6)):
        pool = rng.integers(0, 2**63, n + m, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[n // 2 : n // 2 + m])
        bound = ngram_join.most_overlap(np.frombuffer(ngram_join.signature(a), np.uint64), len(a), np.frombuffer(ngram_join.signature(b), np.uint64)[None], np.array([len(b)]))[0]
        assert len(np.intersect1d(a, b)) <= bound


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 140)} == {100}


# ---- 2 ----------------------------------------------------------------------------------


def test_chat_collapse(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (3, 1, "assistant", "hello"), (4, 0, "user", "hi"), (4, 1, "assistant", "bye"), (None, None, None, None), (5, 0, "assistant", "hi")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, position string")
    got = {r.conv_id: (r.n_turns, r.n_same, r.text) for r in chat.render(df).collect()}
    assert set(got) == {1, 4, None, 5}
    assert got[1] == (2, 2, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n")
    assert got[None] == (1, 1, "<|im_start|>unknown\n<|im_end|>\n")
    assert chat.render(df.limit(0)).count() == 0
    plan = chat.render(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- 3 ----------------------------------------------------------------------------------

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [(3, m.start(), m.end()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(5)
    cases = ["".join(rng.choice("a@.-+0123456789  ()_%é") for _ in range(rng.randint(1, 60))) for _ in range(20_000)]
    cases += ["4111 1111 1111 1111", "x@y.z@w.v", "1.2.3.4.5.6.7.8", "+1 (743) 555-3824", "+" + "1" * 50, "a" * 5000 + "@", "1" * 5000]
    assert all(pii.base_spans(t) == brute_spans(t) for t in cases)


def test_windows_without_triggers_hold_no_spans(monkeypatch):
    rng = random.Random(8)
    made = ["write to jo at mail dot com now", "4 0 0 5 5 5 4 4 4 4 4 4 1 1 1 4", "ip 10 . 20 . 30 . 40", "call +49 (30) 123-4567", "x@y", "at noon"]
    texts = [" ".join(plain(1000 + 9 * k + i, rng.randint(0, 60)) + " " + (rng.choice(made) if rng.random() < 0.5 else "") for i in range(rng.randint(0, 4))) for k in range(120)]
    tagger = pii.train([plain(s, 30) for s in range(40)])
    some = [pii.tagged_spans(t, x) for t, x in zip(texts, pii.tag_texts(texts, tagger), strict=True)]
    monkeypatch.setattr(pii, "window_starts", lambda t: list(range(0, max(len(t), 1), pii.STRIDE)))
    every = [pii.tagged_spans(t, x) for t, x in zip(texts, pii.tag_texts(texts, tagger), strict=True)]
    assert some == every and sum(map(len, some)) > 10


def test_first_by_hash(spark):
    df = spark.range(30_000).select("id", F.xxhash64("id").alias("h")).repartition(3)
    want = [r.id for r in df.orderBy("h").limit(50).collect()]
    assert [r.id for r in first_by_hash(df, 50, "h").orderBy("h").collect()] == want
    same = df.withColumn("h", F.lit(2**62))  # all above any bound
    assert [r.id for r in first_by_hash(same, 50, "h", "id").collect()] == list(range(50))
    assert first_by_hash(df.limit(0), 5, "h").count() == 0


def test_toxicity_of_repeated_ids(spark):
    rows = [(i, ("vilexa grumpish " if i % 2 else "kind ") + prose(i, 20, 300)) for i in range(300)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    once, twice = (toxicity.fit(x, marks) for x in (df.dropDuplicates(["doc_id"]), df))
    assert set(once.entries) <= set(twice.entries) and " vilexa " in once.entries
    assert all((twice.score(t) >= 0.5) == bool(i % 2) for i, t in rows[:300])


def test_tagger_learns_and_finds(spark):
    tagger = pii.train([plain(s, 30) for s in range(40)])
    card = next(f"411111111111{x}" for x in range(1000, 10_000) if pii.luhn(f"411111111111{x}"))
    rows = [(1, "please write to anna@example.org or call +1 743 555 3824 today"), (2, None), (3, ""), (4, "nothing here"), (5, "bake limonu " + ".".join(card[k : k + 4] for k in range(0, 16, 4)) + ", rase tivo du"), (6, "word " * 20_000 + "10.0.0.1")]
    df = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, spans string")
    got = {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.spans] for r in pii.find(df, tagger).collect()}
    assert got[1] == [("email", 16, 32, True), ("phone", 41, 56, True)]
    assert got[2] == got[3] == got[4] == [] and got[6] == [("ip", 100_000, 100_008, True)]
    assert got[5] == [("card", 12, 31, False)]
    again = [tuple(r.spans) for r in pii.find(df.where("doc_id = 5").union(df.where("doc_id = 5")), tagger).collect()]
    assert len(again) == 2 and again[0] == again[1]
    assert pii.find(df.limit(0), tagger).count() == 0
    # spans made of other words, in other text, which the patterns miss
    rng, words = np.random.default_rng(8), [f"zo{c}an" for c in "bcdfgklmprst"]
    rows, truth = [], []
    while len(rows) < 400:
        kind, made = pii.made_span(rng, words)
        text = f"{plain(500 + len(rows), 12)} {made}, {plain(900 + len(rows), 12)}"
        start = text.index(f" {made}, ") + 1
        if not pii.base_spans(text):
            rows.append(text)
            truth.append((kind, start, start + len(made)))
    found = [pii.tagged_spans(t, x) for t, x in zip(rows, pii.tag_texts(rows, tagger), strict=True)]
    caught = sum(t in x for t, x in zip(truth, found, strict=True) if t[0] >= 0)
    assert caught > 0.8 * sum(k >= 0 for k, *_ in truth) and sum(bool(x) for t, x in zip(truth, found, strict=True) if t[0] < 0) < 0.05 * len(rows)


def test_written_around_addresses_are_tagged_at_every_offset(spark):
    class Plain:  # tags all but the signs around
        p = {"move": np.zeros((9, 9), np.float32)}

        def emissions(self, ids):
            e = np.zeros((*ids.shape, 9), np.float32)
            e[..., 2] = np.where(ids == 96, -3, 3)
            return e

    addresses = ("john.doe (at) example (dot) com", "anna.smith at mailhost dot org", "maria.hofmann (at) universitaet (dot) de", "a" * 70 + " at " + "b" * 70 + " dot org")
    rows = [("\u20ac" * offset + a + "\u20ac" * after, offset, offset + len(a)) for a in addresses for offset in range(50) for after in (0, 1, 60)]
    got = pii.find(spark.createDataFrame(rows, "text string, s int, e int"), Plain()).collect()
    assert len(got) == len(rows) and all([tuple(x) for x in r.spans] == [("email", r.s, r.e, False)] for r in got)


def test_best_paths_equal_exhaustive_search():
    rng = np.random.default_rng(4)
    for case in range(60):
        n, tags = int(rng.integers(1, 7)), 3
        e = (rng.standard_normal((2 * n, tags)) * 3).astype(np.float32)
        e[:, 0] += rng.random(2 * n) * (12 if case % 2 else 0)  # some are sure
        move = rng.standard_normal((tags, tags)).astype(np.float32)
        got = bilstm_crf.best_paths(e, np.array([0, n]), np.array([n, 2 * n]), move, cells=4)
        for part, own in ((e[:n], got[:n]), (e[n:], got[n:])):
            value = lambda path: sum(part[t, k] for t, k in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:]))  # noqa: B023, E731
            assert value(tuple(own)) == pytest.approx(max(value(x) for x in itertools.product(range(tags), repeat=n)), abs=1e-4)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    model = bilstm_crf.Tagger(7, 3)
    model.p = {k: v.astype(float) for k, v in model.p.items()}
    ids, tags = rng.integers(0, 7, (2, 6)), rng.integers(0, 3, (2, 6))
    _, g = model.gradients(ids, tags)
    for name in model.p:
        at = tuple(int(rng.integers(s)) for s in model.p[name].shape)
        if name == "embed":
            at = (int(ids[0, 0]), 0)
        old, step = model.p[name][at], 1e-5
        model.p[name][at] = old + step
        up = model.gradients(ids, tags)[0]
        model.p[name][at] = old - step
        down = model.gradients(ids, tags)[0]
        model.p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-6)


# ---- 4 ----------------------------------------------------------------------------------


def test_toxicity(spark):
    rng, rows, labels = random.Random(3), [], []
    for i in range(600):
        words, bad = prose(i, 40, 500).split(), i % 3 == 0
        if bad:
            words[rng.randint(0, 39)] = rng.choice(["vilexa", "vilexon", "Grumpish", "gr1mpal"])
            words[rng.randint(0, 39)] = "grumpish"
        rows.append((i, " ".join(words), 9.9))
        labels.append((i, int(bad)))
    df = spark.createDataFrame([*rows, (1000, None, 1.0), (1001, "", 1.0), (1002, "gr\u0443mpish GRUMP1SH " + prose(9, 30, 500), 1.0)], "doc_id long, text string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, marks)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    held = [(i, t) for i, t in labels if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == bool(t) for i, t in held]) > 0.95
    assert got[1000] == got[1001] < 0.5 <= got[1002]
    assert toxicity.Model({" grumpish ": 5.0}, ["not grumpish"], 1.0, 0.0).raw("not grumpish at all") == 0
    nothing = toxicity.fit(df, marks.limit(0))
    assert {r.score < 0.5 for r in toxicity.score(df, nothing).collect()} == {True}
    assert toxicity.score(df.limit(0), model).count() == 0
    again = [r.score for r in toxicity.score(df.where("doc_id = 1002").union(df.where("doc_id = 1002")), model).collect()]
    assert len(again) == 2 and again[0] == again[1] == got[1002]


def brute_toxicity(text, entries, exceptions):
    """At each word the longest entry, left to right; words in an exception don't count."""
    words, total, k = toxicity.fold(text), 0.0, 0
    while k < len(words):
        fits = [(len(e), w, 1) for e, w in entries.items() if (f" {words[k]} " == e if e.endswith(" ") else f" {words[k]}".startswith(e))]
        fits += [(len(e) + 3, 0.0, len(e.split())) for e in exceptions if words[k : k + len(e.split())] == e.split()]
        if fits:
            _, weight, step = max(fits)
            total += weight
            k += step
        else:
            k += 1
    return total / np.log(8 + len(words)) if words else 0.0


def test_toxicity_equals_brute_force():
    rng = random.Random(12)
    entries, exceptions = {" ab ": 2.0, " abba": 1.5, " abbad": 3.0, " cad ": 0.5, " dab ": 1.25}, ["no ab", "cad ab", "dab cad"]
    model = toxicity.Model(entries, exceptions, 1.0, 0.0)
    pool = ["ab", "abba", "abbado", "abbad", "cad", "dab", "no", "cab", "4b", "c@d", "\u0430b", "x", "abc"]
    cases = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["ab " * 50_000, "", "...", "ab,cad;dab"]
    for text in cases:
        assert model.raw(text) == pytest.approx(brute_toxicity(text, entries, exceptions)), text


# ---- 5 ----------------------------------------------------------------------------------


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE", 16)
    monkeypatch.setattr(topk, "BLOCK", 3)
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in np.float32(rng.integers(-3, 4, 4) / 4)]) for i in range(150)]
    vectors += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan"), 0.0, 0.0, 0.0]), (203, [1.0, 1.0]), (None, [5.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*v, 3) for v in vectors], "vec_id long, embedding array<float>, rank int").repartition(4)
    got = {}
    for r in topk.search(df, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    good = {i: np.floor(256 * np.array(v, float)) for i, v in vectors if v is not None and None not in v and np.isfinite(v).all() and len(v) == 4}
    for q in range(0, 150, 10):
        scored = sorted((-int(good[q] @ v), 10**9 if i is None else i) for i, v in good.items() if i != q)[:5]
        assert [got[q][k + 1] for k in range(5)] == [(None if i == 10**9 else i, -s) for s, i in scored]
    assert topk.search(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    # repeated rows, and components beyond 32 bits
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [3.0e7, 0.0]), (1, [3.0e7, 0.0]), (2, [-1.0, 0.0])]
    twice = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    want = [(1, 1, 256 * 256 * 30_000_000), (2, 1, 256 * 256 * 30_000_000), (3, 2, -256 * 256)]
    assert sorted((r["rank"], r.vec_id, r.score) for r in twice) == sorted(2 * want)


# ---- 6 ----------------------------------------------------------------------------------


def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    p = 0
    while p < len(a) and a[p] == b[p]:
        p += 1
    return len(b) - len(a) <= 1 and (a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :])


def brute_lines(rows):
    norm = lambda l: b" ".join(l.split()).lower().decode()
    first = {}
    for i, x in rows:
        for k, line in enumerate((x or "").encode().split(b"\n")):
            if norm(line):
                first.setdefault(norm(line), (i, k))
    near = {f for f in first if len(f) >= 24 and any(len(g) >= 24 and first[g] < first[f] and within_one(f, g) for g in first)}
    out = {}
    for i, x in rows:
        lines = (x or "").encode().split(b"\n")
        stay = [(j, w) for j, w in enumerate(lines) if not norm(w) or first[norm(w)] == (i, j) and norm(w) not in near]
        kept, n = sum(bool(norm(w)) for _, w in stay), sum(bool(norm(w)) for w in lines)
        out[i] = (n, kept, None if x is None else b"\n".join(w for _, w in stay).decode() if kept or not n else "")
    return out


def test_line_dedup(spark):
    rng, alphabet = random.Random(2), "abcdé "
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(20, 60))) for _ in range(40)]
    for line in pool[:20]:
        k = rng.randint(0, len(line) - 1)
        pool += [line[:k] + line[k + 1 :], line[:k] + "z" + line[k:], line[:k] + "z" + line[k + 1 :], line[:k] + "zz" + line[k:]]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))) for i in range(80)]
    rows += [(90, None), (91, ""), (92, "\n \n"), (93, "short"), (94, "Short\r\nshort"), (95, "x" * 40_000 + "\n" + "x" * 40_001), (96, "x" * 39_999)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, text string, th string").repartition(3)
    got = {r.doc_id: (r.n_lines, r.n_kept, r.text) for r in line_dedup.dedup(df).collect()}
    assert got == brute_lines(rows)
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_line_dedup_repeated_rows(spark):
    df = spark.createDataFrame([(1, "same line"), (1, "same line"), (None, "same line"), (2, "other")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_kept) for r in line_dedup.dedup(df).collect())
    assert got == [(0, 1), (1, 0), (1, 0), (2, 1)]


# ---- 7 ----------------------------------------------------------------------------------


def brute_targets(sizes, weights):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while True:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "b", "b", "b", "c", None, "zé"]), rng.randint(0, 50)) for i in range(500)] + [(900, "tiny", 1), (901, "zero", 0), (902, "a", 5000), (7, "b", 9)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, size long, bin int").repartition(4)
    got = mixing.mix(df).collect()
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    want = brute_targets(sizes, (5, 2, 1))
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size and r.bin == 1
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(df.repartition(2)).collect()
    assert sorted((r.doc_id, r.size, r.taken) for r in got) == sorted((r.doc_id, r.size, r.taken) for r in again)
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_repeated_and_null_ids(spark):
    rows = [(None, "a", 5)] * 300 + [(None, "a", 7)] * 40 + [(3, "b", 4)] * 200 + [(i, "c", i % 9) for i in range(50)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, source string, size long, place long").repartition(5)
    got = mixing.mix(df).collect()
    want = brute_targets({"a": 1780, "b": 800, "c": sum(i % 9 for i in range(50))}, (5, 2, 1))
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size + r.part
        taken[r.source] += r.taken
    assert sorted(r.place for r in got) == list(range(len(rows))) and all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert all(sum(0 < r.part < r.size for r in got if r.source == s) <= 1 for s in want)


def test_word_counts(spark):
    texts = ["", None, " ", "a", " a\n\nb\x0bc ", "\u00a0x\u2003y z", "x" * 3000 + " " * 3000 + "y", "\x1c\x85 q\r\n"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    got = {r.k: r.n for r in df.select("k", n_words(F.col("text")).alias("n")).collect()}
    assert got == {k: len(WORD.findall(t or "")) for k, t in enumerate(texts)}


# ---- 8 ----------------------------------------------------------------------------------


def test_url_filter(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr", "allow"), ("a.org", "", "block")]
    urls = ["http://x.net/a?b", "https://EXAMPLE.net/en/1#t", "https://m.example.net/enx", "http://a.org/fr", "http://b.org/frx", "no url", None, "http://net", "x://y.net/?q=http://z.org/fr/", "http://www.a.org", "http://" + "a." * 300 + "net/", ""]
    df = spark.createDataFrame([(i, u, "h", "p", 1) for i, u in enumerate(urls)] + [(0, urls[0], "h", "p", 1)], "page_id long, url string, host string, won_path string, size int")

    def brute(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.translate(LOWER)
        fits = [(len(h + p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, *(max(fits)[:0:-1] if fits else (None, "allow"))

    out = url_filter.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(out) == 13 and all((r.host, r.path, r.rule, r.verdict) == brute(r.url) and r.won_path == "p" for r in out)
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in url_filter.judge(df, none).collect()} == {"allow"}
    assert url_filter.judge(df.limit(0), none).count() == 0


# ---- 9 ----------------------------------------------------------------------------------


def test_quality(spark, docs, texts):
    def brute(x):
        x = x or ""
        w = WORD.findall(x)
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        inside = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [line for line in x.split("\n") if WORD.search(line)]
        return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in x), len(lines) - len(set(lines)), len(inside)

    more = [*texts, "a b c d e f g h a b c d e f g h i", "x " * 30, "l1 w\nl1 w\n\nl1 w\r\n#|<>", prose(5, 30) + " ***" * 10 + "\v\f"]
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(more)], "doc_id long, text string, kept boolean")
    labels = spark.createDataFrame([(i, 1) for i in range(40, 60)] + [(3, 1), (3, 0)], "doc_id long, quality int")
    judged = quality.judge(df, quality.trusted_ids(labels))
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    for r in judged.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(more[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed)
    assert quality.judge(df.limit(0), quality.trusted_ids(labels)).count() == 0
    assert {r.llr for r in quality.judge(df, quality.trusted_ids(labels.limit(0))).collect()} == {0.0}


def test_ratio_finds_junk(spark):
    good = [(i, prose(i, 60, 20)) for i in range(80)]
    junk = [(100 + i, " ".join(w + "***" for w in prose(i, 60, 20).split())) for i in range(10)]
    df = spark.createDataFrame(good + junk, "doc_id long, text string")
    kept = {r.doc_id for r in quality.judge(df, quality.trusted_ids(spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int"))).where("kept").collect()}
    assert kept == {i for i, _ in good}


# ---- 10 ---------------------------------------------------------------------------------


def test_codec_equals_library():
    from tokenizers import Tokenizer

    library, codec, rng = Tokenizer.from_file(bpe.default_path()), bpe.codec(bpe.default_path()), random.Random(6)
    alphabet = "ab'sretvmld \n\t\u00a0\u3000é日.!<|endoftext|>0 1qxzj\x85\x1c\u200b"
    cases = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    cases += ["don't we'll 'se x'rexx", "<|endoftext|> a<|endoftext|>", "x" * 3000, "日本語 テキスト　全角", prose(1, 2000), "\x00\x01 a", "A'S 'Re", "e\u0301 \u0345 ١٢٣ ⅷ ²"]
    for text in cases:
        want = library.encode(text, add_special_tokens=False).ids
        ids = codec.encode([text.encode()])[0]
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert codec.decode(ids) == library.decode(want, skip_special_tokens=False) == text


def test_codec_columns(spark, docs, texts):
    df = bpe.decode(bpe.encode(docs.withColumn("ids", F.lit(1))))
    for r in df.collect():
        assert r.decoded == (texts[r.doc_id] or "") and r.node == "node"
    assert bpe.encode(docs.limit(0)).count() == 0


# ---- the pipeline -------------------------------------------------------------------------


def test_codec_in_one_pass(spark, docs, tmp_path):
    import corpus_pipeline

    both = lambda df: sorted((r["doc_id"], r["text"], bytes(r["ids"]), r["decoded"]) for r in df.collect())
    key = lambda rows: [(i, t or "", x, d) for i, t, x, d in rows]
    clashing = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(1).alias("ids"), F.lit(2).alias("decoded"))
    assert key(both(bpe.encode_decode(clashing))) == key(both(bpe.decode(bpe.encode(clashing))))
    assert bytes(bpe.encode_decode(docs.where("text is null")).first()["ids"]) == b""
    stage = corpus_pipeline.encode(spark, docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")), str(tmp_path))
    assert stage._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # one worker a task


class Mapped:
    """In place of a DataFrame: keeps the function that is to map its batches."""

    def mapInArrow(self, function, schema):
        self.function = function


def test_lines_of_a_large_batch_are_taken_in_parts(monkeypatch):
    texts = [f"line {k} {plain(k, 8)}\n{plain(k % 7, 9)}" for k in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(range(3000)), pa.array(texts)], names=["doc_id", "th", "text"])
    sizes, docs = [], Mapped()
    raw_texts = line_dedup.raw_texts
    monkeypatch.setattr(line_dedup, "raw_texts", lambda column: sizes.append(len(column)) or raw_texts(column))
    line_dedup.line_rows(docs, "long")
    rows = pa.Table.from_batches(docs.function(iter([batch]))).to_pydict()
    assert sum(sizes) == 3000 and max(sizes) <= 512
    assert list(zip(rows["doc_id"], rows["line"], strict=True)) == [(k, i) for k in range(3000) for i in (0, 1)]
    assert len({(h, g) for h, g in zip(rows["h1"], rows["h2"], strict=True)}) == 3007


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from brightloom.llm.common import materialize

    lines = [prose(s, 25) for s in range(60)]
    rows = [(i, "\n".join(lines[i : i + 3]) if i < 40 else "\n".join([lines[0], prose(900 + i, 30), prose(800 + i, 30)]), "en", f"src{i % 4}", 1) for i in range(60)]
    near = prose(77, 120)
    extra = ["q_counts", "n_words", "llr", "kept", "n_lines", "n_kept", "kept_id", "kept_n", "size", "times", "nth", "taken", "target", "copies", "__rest"]
    rows += [(70, near, "en", "src0", 1), (71, variant(near, 4, 0.01), "en", "src0", 1), (72, "too short", "en", "src1", 1), (73, None, None, None, None), (74, near, "en", "src2", 1)]
    rows = [(*r, *[f"{c} {r[0]}" for c in extra]) for r in [*rows, rows[3]]]  # a repeated row too
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(72)] + [(74, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    before_docs = docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, str(tmp_path)))
        seen[name] = (before.collect(), docs.collect())
        if name != "BPE encoding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *extra]
            assert all(r[c] == f"{c} {r.doc_id}" for r in seen[name][1] for c in extra)
    raw, kept = seen["quality rules"]
    assert {r.doc_id for r in raw} - {r.doc_id for r in kept} == {72, 73}
    before, after = seen["line dedup"]
    want = brute_lines(sorted({(r.doc_id, r.text) for r in before}))
    assert {r.doc_id: r.text for r in after} == {i: t for i, (n, k, t) in want.items() if k}
    assert all(r.n_chars == len(r.text) for r in after) and 74 not in {r.doc_id for r in after}
    before, after = seen["n-gram Jaccard join"]
    text = {r.doc_id: r.text for r in before}
    ids = sorted(text)
    root = brute_components([text[i] for i in ids])
    assert sorted(r.doc_id for r in after) == [i for k, i in enumerate(ids) if root[k][1] == k] and 71 not in {r.doc_id for r in after}
    before, after = seen["mixing sources"]
    times = Counter(r.doc_id for r in after)
    assert max(times.values()) <= 3 and set(times) <= {r.doc_id for r in before}
    nothing = before_docs.limit(0)
    assert [stage(spark, nothing, str(tmp_path)).count() for _, stage in corpus_pipeline.STAGES] == [0] * 5
    before, after = seen["BPE encoding"]
    assert len(before) == len(after)
    full = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in before}
    assert all(r.decoded_sha256 == full[r.doc_id] and r.n_tokens * 4 == len(r.ids) for r in after)
