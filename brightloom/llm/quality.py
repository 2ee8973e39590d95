"""Quality rules: simple measures, and a hashed n-gram likelihood ratio.

The ratio compares two multinomials over hashed unigrams and bigrams of tokens
(runs of letters and digits; runs of other characters): one of the trusted
documents, one of the whole raw corpus. A document's score is the mean, over
its n-grams, of log p_trusted - log p_raw; a document is kept if it passes the
base rules and its score isn't below a fixed threshold. Everything is built-in
SQL functions; the multinomials have a fixed number of buckets, so what goes
through the driver has a fixed size.

The raw counts cover every document. The trusted ones come from at most
``max_trusted`` labelled documents, the first by a hash of their ids.

Defined cases: a null text has no words and counts as an empty one, which the
base rules reject; without any trusted document every score is 0; repeated
rows and ids are judged alike; an id labelled both ways isn't trusted; very
long texts take the same path; an empty table gives an empty result; other
columns are passed through, whatever their names, but for ones with the names of
the results, which are replaced.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, ASCII_SPACE, packed, words

BUCKETS = 1 << 14
MAX_TRUSTED = 50_000
THRESHOLD = -0.3
PRIOR = 8.0
#: A power of two.
WINDOW = 8
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
TOKEN = r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\x20\x09-\x0D]+)"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(found: Column, window: int = WINDOW) -> Column:
    """How many of the words lie in a window of ``window`` words that occurs
    twice or more in the same array, the first occurrence included."""

    def doubled(value: Column, step: int) -> Column:
        """Hashes of twice as many words from each place on; the last ones
        lack words and are cut off below."""
        later = lambda h: F.slice(h, step + 1, F.greatest(F.size(h) - step, F.lit(0)))
        return let(value, lambda h: F.zip_with(h, later(h), lambda a, b: F.xxhash64(a, b)))

    def windows(h: Column) -> Column:
        whole, step = h, 1
        while step < window:
            whole, step = doubled(whole, step), 2 * step
        return F.when(F.size(h) > window, F.slice(whole, 1, F.greatest(F.size(h) - window + 1, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))

    def covered(own: Column) -> Column:
        by_hash = F.sort_array(F.transform(own, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(by_hash, lambda s: F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])))
        at = F.sort_array(F.array_compact(twice))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(window), p - acc["last"])).alias("n"), p.alias("last"))
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")), step, lambda acc: acc["n"])

    own = let(F.transform(found, lambda w: F.xxhash64(w)), windows)
    return let(own, lambda a: F.when(F.size(F.array_distinct(a)) == F.size(a), F.lit(0)).otherwise(covered(a))).cast("long")


def base_measures(text: Column) -> dict[str, Column]:
    """n_words is to be a column before repeated_words is taken."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "word_chars": F.length(F.translate(text, " " + ASCII_SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def ngram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    hashes = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(1)), lambda t: F.xxhash64(t))
    bucket = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    two = lambda h: F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), bucket(F.xxhash64(a, b))))
    return let(hashes, lambda h: F.concat(F.transform(h, bucket), F.array_compact(two(h))))


def trusted_ids(labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """At most ``max_trusted`` ids of documents of quality 1."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where((F.col("quality") == 1) & F.col("doc_id").isNotNull())
    return first_by_hash(good.select("doc_id", F.xxhash64("doc_id").alias("h")), max_trusted, "h", "doc_id").select("doc_id")


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> list[float]:
    """log p_trusted - log p_raw of each bucket. Both counts get ``PRIOR`` more
    n-grams, dealt as the raw corpus is, so rare buckets weigh little and
    a bucket that is as common in either weighs nothing at any size."""
    marked = docs.select("doc_id", "text").join(F.broadcast(trusted.limit(max_trusted).select(F.col("doc_id").alias("good_id"))), F.col("doc_id") == F.col("good_id"), "left")
    grams = marked.select(F.col("good_id").isNotNull().alias("good"), F.explode(ngram_buckets(F.col("text"), buckets)).alias("bucket"))
    rows = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("t")).collect()  # at most `buckets` rows
    n, t = sum(r["n"] for r in rows), sum(r["t"] for r in rows)
    weights = [0.0] * buckets
    if t:
        for r in rows:
            weights[r["bucket"]] = log((r["t"] + PRIOR * t / n) / ((r["n"] + PRIOR) * t / n))
    return weights


def score(text: Column, weights: list[float]) -> Column:
    """Mean log-likelihood ratio of the n-grams of a text; 0 without any."""
    table = F.split(F.lit(",".join(f"{w:.6f}" for w in weights)), ",").cast("array<double>")
    mean = lambda b: F.aggregate(b, F.lit(0.0), lambda a, i: a + F.get(table, i)) / F.greatest(F.size(b), F.lit(1))
    return F.round(let(ngram_buckets(text, len(weights)), mean), 6)


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, llr and kept."""
    weights = fit(docs, trusted, buckets)
    docs = docs.drop(*RESULTS)
    names = docs.columns
    docs, rest = packed(docs, "doc_id", "text")
    text = F.col("text")
    count = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    out = docs.withColumns(base_measures(text) | {"llr": score(text, weights), "counts": count})
    out = out.withColumns({"n_words": F.col("counts.n"), "n_repeat_words": F.col("counts.r")})
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(threshold)))
    back = dict(zip([n for n in names if n not in ("doc_id", "text")], rest, strict=True))
    return out.select(*[back.get(n, n) for n in names], *RESULTS)
