"""The queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, line_dedup, mixing, ngram_join, pii, quality, runs, topk, toxicity, url_filter, whitening
from .common import n_words, table

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

SQL_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents"))


OP1_SQL = f"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS k, doc_id, list_transform({SQL_WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
d AS (
  SELECT k, doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
n AS (SELECT s, row_number() OVER () AS node, len(s) AS size, min(doc_id) AS low FROM d WHERE len(s) > 0 GROUP BY s),
g AS (SELECT node, size, unnest(s) AS gram FROM n),
l AS (
  SELECT a.node AS a, b.node AS b FROM g a JOIN g b ON a.gram = b.gram AND a.node <> b.node
  GROUP BY a.node, b.node, a.size, b.size HAVING 100 * count(*) >= 75 * (a.size + b.size - count(*))),
r(node, other) AS (
  SELECT node, node FROM n UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT r.node, min(o.low) AS component_id FROM r JOIN n o ON o.node = r.other GROUP BY r.node),
m AS (SELECT a AS node, count(*) AS n_links FROM l GROUP BY a)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(m.n_links, 0)::BIGINT AS n_links, coalesce(c.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n ON d.s = n.s LEFT JOIN c ON c.node = n.node LEFT JOIN m ON m.node = n.node"""


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


OP2_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         md5(role || chr(1) || text) AS h FROM t),
r AS (
  SELECT conv_id, k, md5(string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY k)) AS so_far,
         k = max(k) OVER (PARTITION BY conv_id) AS whole FROM p),
w AS (
  SELECT k AS n_turns, so_far, min(conv_id) AS conv_id, count(*) AS n_same FROM r WHERE whole GROUP BY ALL),
m AS (
  SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE NOT r.whole AND r.k = w.n_turns AND r.so_far = w.so_far))
SELECT m.conv_id, m.n_turns, m.n_same,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY p.k) AS text
FROM m JOIN p ON p.conv_id IS NOT DISTINCT FROM m.conv_id GROUP BY ALL"""


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs)).drop("text")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    scored = toxicity.score(docs, model).withColumn("held_out", held_out)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_kept", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS raw, generate_subscripts(lines, 1) AS line FROM t),
f AS (
  SELECT *, translate(array_to_string(regexp_extract_all(raw, '[^\x20\x09-\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS form FROM l),
o AS (
  SELECT *, form <> '' AND row_number() OVER (PARTITION BY form ORDER BY doc_id NULLS FIRST, line) = 1 AS new,
         row_number() OVER (ORDER BY doc_id NULLS FIRST, line) AS k FROM f),
a AS (SELECT k, form, length(form) AS n FROM o WHERE new AND length(form) >= 24),
s AS (SELECT k, form, n, unnest([n, n - 1]) AS m FROM a),
h AS (SELECT *, left(form, m // 2) AS half, 0 AS side FROM s UNION ALL SELECT *, right(form, m - m // 2), 1 FROM s),
near AS (
  SELECT DISTINCT y.k FROM h x JOIN h y ON x.m = y.m AND x.side = y.side AND x.half = y.half AND x.k < y.k
  WHERE abs(x.n - y.n) <= 1 AND levenshtein(x.form, y.form) <= 1),
p AS (SELECT o.*, near.k IS NOT NULL AS is_near, new AND near.k IS NULL AS stays FROM o LEFT JOIN near USING (k))
SELECT doc_id, count(*) FILTER (form <> '') AS n_lines, count(*) FILTER (stays) AS n_kept, count(*) FILTER (is_near) AS n_near,
       sha256(CASE WHEN count(*) FILTER (stays) > 0 OR count(*) FILTER (form <> '') = 0
                   THEN coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (stays OR form = ''), '') ELSE '' END) AS text_sha256
FROM p GROUP BY doc_id"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "part")


OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len({SQL_WORDS})::BIGINT AS size,
         ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, 3.0::DOUBLE * source_size AS clamp,
         row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST) AS k FROM s),
q AS (
  SELECT *, ((SELECT sum(source_size) FROM l)::DOUBLE - coalesce(sum(clamp) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l),
f AS (SELECT min(k) AS k FROM q WHERE level * weight < clamp),
t AS (
  SELECT source, source_size,
         CASE WHEN q.k >= f.k THEN least((SELECT level FROM q q2 WHERE q2.k = f.k) * weight, clamp) ELSE clamp END AS target
  FROM q, f),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
w AS (SELECT *, greatest(0, round(target - whole * source_size))::BIGINT AS want FROM p),
j AS (
  SELECT d.doc_id, d.size, w.source_size, w.target, w.whole, w.want,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source),
e AS (SELECT *, greatest(0, least(size, want - spent))::BIGINT AS extra FROM j)
SELECT doc_id, size, source_size, target, whole * size + extra AS taken,
       whole + CASE WHEN extra = size AND size > 0 THEN 1 ELSE 0 END AS copies,
       CASE WHEN extra = size THEN 0 ELSE extra END AS part
FROM e"""


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = """
WITH u AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', ['host', 'path']) AS m FROM pages),
p AS (SELECT row_number() OVER () AS k, page_id, translate(m.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, m.path AS path FROM u),
r(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
h AS (
  SELECT p.k, max_by({'rule': r.host || r.path, 'verdict': r.verdict}, length(r.host || r.path)) AS won
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.k)
SELECT p.page_id, p.host, p.path, h.won.rule AS rule, coalesce(h.won.verdict, 'allow') AS verdict
FROM p LEFT JOIN h USING (k)"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = quality.trusted_ids(table(spark, sf_dir, "labels"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"]
    return quality.judge(docs, trusted).select(*columns)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs).drop("text"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def planted_runs(doc_id: int | None, n: int) -> np.ndarray | None:
    """The order in which a text of ``n`` words is read: for a tenth of the ids,
    from some word on, over and over from there."""
    h = crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return order


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.collapse(table(spark, sf_dir, "documents").select("doc_id", "text"), reading=planted_runs)
    best = F.col("best")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        runs.digest(F.col("runs")).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL_TOKENS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP12_SQL = f"""
WITH i AS (SELECT item_id::VARCHAR AS item_id, {SQL_TOKENS} AS w FROM benchmark),
t AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS row, doc_id, {SQL_TOKENS} AS w FROM documents),
g AS (
  SELECT row, m, k, array_to_string(w[k:k + m - 1], ' ') AS s
  FROM (SELECT row, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM t))),
h AS (SELECT g.row, g.k, g.m, t.item_id FROM g JOIN t ON g.m = t.m AND g.s = t.s),
n AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(k, k + m)) AS p FROM h) GROUP BY row),
o AS (SELECT row, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (row) LEFT JOIN o USING (row)"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_chat": op2_chat,
    "op3_pii": op3_pii,
    "op4_toxicity": op4_toxicity,
    "op5_topk": op5_topk,
    "op6_line_dedup": op6_line_dedup,
    "op7_mixing": op7_mixing,
    "op8_url_filter": op8_url_filter,
    "op9_quality": op9_quality,
    "op10_bpe": op10_bpe,
    "op11_runs": op11_runs,
    "op12_decontamination": op12_decontamination,
    "op13_whitening": op13_whitening,
}
ORACLES = {
    "op1_ngram_join": OP1_SQL,
    "op2_chat": OP2_SQL,
    "op5_topk": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
    "op7_mixing": OP7_SQL,
    "op8_url_filter": OP8_SQL,
    "op12_decontamination": OP12_SQL,
}
