"""URL filters by expansion into hashed host-suffix / path-prefix expressions.

Each URL is expanded into the expressions ``suffix + prefix`` that a rule of the
given list could have: host suffixes on label boundaries, as many labels long
as some rule's host, and path prefixes as long as some rule's path. The
expressions are joined with the rules on the first 32 bits of their SHA-256,
the full digests confirm, and of the confirmed rules the longest wins (of
equally long ones a block, then the first by code point).

Distinct (host, path) pairs are judged once, so a host or URL that holds a
third of all rows costs one judgement. The rules are broadcast only if counted
small; otherwise the equi-join on hash prefixes is a shuffle join of distinct
expressions.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and gets ``default``; an empty rule table or URL table is fine; repeated rows
and ids are judged alike; other columns are passed through, but for ones with
the names of the result, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, packed, small_or_plain


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with host, path, rule (the winning rule, or null) and verdict.

    ``rules``: host, path (a prefix; may be empty) and verdict (allow or block).
    """
    rows, rest = packed(urls, url)
    rows = rows.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    clean = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict")).where(F.col("rule_host").isNotNull())
    clean = clean.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))  # block over allow
    shape = clean.agg(F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"), F.collect_set(F.length("rule_path")).alias("lengths")).first()
    labels, lengths = sorted(shape["labels"]) or [1], sorted(shape["lengths"]) or [0]  # a few small integers

    pairs = rows.select("host", "path").where(F.col("host") != "").distinct()
    n = F.size(F.split("host", r"\."))
    suffixes = F.array_compact(F.array(*[F.when(n >= k, F.substring_index("host", ".", -k)) for k in labels]))
    prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= k, F.substring(F.col("path"), 1, k)) for k in lengths]))
    shown = pairs.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
    shown = shown.withColumn("digest", _digest(F.concat("suffix", "prefix"))).withColumn("short", _short(F.col("digest"))).select("host", "path", "digest", "short")

    clean = clean.withColumn("rule", F.concat("rule_host", "rule_path"))
    clean = clean.withColumn("rule_digest", _digest(F.col("rule"))).withColumn("rule_short", _short(F.col("rule_digest")))
    clean, _ = small_or_plain(clean.select("rule", "rule_verdict", "rule_digest", "rule_short"))
    hits = shown.join(clean, F.col("short") == F.col("rule_short")).where(F.col("digest") == F.col("rule_digest"))
    best = F.max(F.struct(F.length("rule").alias("size"), F.col("rule_verdict").alias("verdict"), F.col("rule")))
    won = hits.groupBy("host", "path").agg(best.alias("won")).select(F.col("host").alias("won_host"), F.col("path").alias("won_path"), F.col("won.rule").alias("rule"), F.col("won.verdict").alias("won_verdict"))
    out = rows.join(won, (F.col("host") == F.col("won_host")) & (F.col("path") == F.col("won_path")), "left")
    made = ["host", "path", "rule", F.coalesce("won_verdict", F.lit(default)).alias("verdict")]
    kept = [c for c, n in zip(rest, [c for c in urls.columns if c != url], strict=True) if n not in ("host", "path", "rule", "verdict")]
    return out.select(*kept, url, *made)
