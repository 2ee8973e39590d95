"""Files, databases and deferred chains: tables written out and read back; and
splits, curves and word vectors."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import embeddings as emb
from ..functions import series as se
from ..operators import calibration as cal
from ..operators import evaluation as ev
from ..operators import preprocessing as pp
from ..operators import windows
from ..plans import lazy
from ..sources import databases, files
from .analysis import DAILY, daily, rounded
from .registry import Tables, query


def place(t: Tables) -> str:
    """A new path in the folder that all processes share."""
    shared = t.spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="brightloom-")
    return f"{shared.rstrip('/')}/exchange-{uuid.uuid4().hex}"


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN 'a \"' || c_mktsegment || '\", ' || c_custkey END AS said, c_acctbal, c_custkey % 2 = 0 AS even FROM customer")
def csv_round_trip(t: Tables):
    said = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit('a "'), "c_mktsegment", F.lit('", '), F.col("c_custkey").cast("string")))
    path = place(t)
    files.write_csv(t.customer.select("c_custkey", said.alias("said"), "c_acctbal", (F.col("c_custkey") % 2 == 0).alias("even")), path)
    return files.read_csv(t.spark, path)


@query("SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders WHERE o_totalprice > 200000")
def csv_lazy(t: Tables):
    path = place(t)
    files.write_csv(t.orders.select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("day")), path)
    return lazy.lazy_csv(t.spark, path).filter("o_totalprice > 200000").select("o_orderkey", "day").plan().withColumn("day", F.col("day").cast("string"))


@query("SELECT n_nationkey, n_name, '{\"region\":' || n_regionkey || '}' AS at FROM nation")
def json_array(t: Tables):
    path = place(t)
    one = F.struct("n_nationkey", "n_name", F.struct(F.col("n_regionkey").alias("region")).alias("at"))
    t.nation.agg(F.to_json(F.collect_list(one)).alias("value")).write.text(path)  # one document by its format
    return files.read_json(t.spark, path).select("n_nationkey", "n_name", "at")


@query("SELECT doc_id, source, text || chr(13) || chr(10) || '\"' || lang || '\", ' || doc_id AS said FROM documents")
def csv_quoted_breaks(t: Tables):
    """Whole texts with their line breaks, quotes and delimiters."""
    path = place(t)
    said = F.concat("text", F.lit('\r\n"'), "lang", F.lit('", '), F.col("doc_id").cast("string"))
    files.write_csv(t.documents.select("doc_id", "source", said.alias("said")), path, single=True)
    return files.read_csv(t.spark, path, null_values=("",), infer=False, kinds={"doc_id": "bigint"})


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def feather_round_trip(t: Tables):
    path = place(t)
    files.write_feather(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), path)
    return files.read_feather(t.spark, path)


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem")
def feather_columns(t: Tables):
    """Three columns of a table in many batches."""
    path = place(t)
    files.write_feather(t.lineitem, path, compression="zstd")
    return files.read_feather(t.spark, path, ["l_orderkey", "l_linenumber", "l_shipdate"], split_bytes=1 << 18)


@query("SELECT n.n_name, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier JOIN nation n ON s_nationkey = n_nationkey GROUP BY 1")
def sqlite_query(t: Tables):
    url = "sqlite://" + os.path.join(tempfile.mkdtemp(prefix="brightloom-"), "t.db")
    databases.write_sql(t.supplier.select("s_nationkey", "s_acctbal"), "supplier", url, "replace")
    databases.write_sql(t.nation.select("n_nationkey", "n_name"), "nation", url, "replace")
    return databases.read_sql(t.spark, "SELECT n_name, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1", url)


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice > 100000")
def jdbc_query(t: Tables):
    """Through JDBC, read in parts, from Derby databases that all executors can open."""
    urls = databases.write_derby(t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), "orders", place(t))
    most = t.orders.agg(F.max("o_orderkey")).first()[0]
    parts = [databases.read_sql(t.spark, 'SELECT * FROM orders WHERE "o_totalprice" > 100000', url, ("o_orderkey", 0, most, 4)) for url in urls]
    found = reduce(DataFrame.union, parts)
    return found.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


@query("""WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS r, count(*) OVER () AS n FROM events), f AS (SELECT *, i, n - (3 - i) * (n // 4) AS cut FROM e, range(3) x(i))
 SELECT i::INTEGER AS fold, CASE WHEN r < cut THEN 'train' ELSE 'test' END AS part, event_id FROM f WHERE r < cut + n // 4""")
def time_series_split(t: Tables):
    parts = [df.select(F.lit(i).alias("fold"), F.lit(name).alias("part"), "event_id") for i, both in enumerate(ev.time_series_split(t.events.select("event_id"), "event_id", 3)) for name, df in zip(("train", "test"), both, strict=True)]
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out


@query("""WITH g AS (SELECT l_quantity AS x, avg(l_discount) AS m, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT a.x AS lo, b.x AS hi, sum(c.m * c.n) / sum(c.n) AS m FROM g a JOIN g b ON a.x <= b.x JOIN g c ON c.x BETWEEN a.x AND b.x GROUP BY ALL),
 l AS (SELECT g.x, b.lo, min(b.m) AS m FROM g JOIN b ON b.lo <= g.x AND b.hi >= g.x GROUP BY ALL), i AS (SELECT x, max(m) AS m FROM l GROUP BY x) SELECT max(x) AS upto, round(m, 8) AS mean FROM i GROUP BY 2""")
def isotonic(t: Tables):
    return cal.isotonic_blocks(t.lineitem, "l_quantity", "l_discount").select("upto", F.round("mean", 8).alias("mean"))


@query(f"WITH d AS ({DAILY}), l AS (SELECT day, list(n::DOUBLE) OVER (ORDER BY day) AS l FROM d) SELECT day, round(list_reduce(l, lambda a, x: 0.1::DOUBLE * x + 0.9::DOUBLE * a), 6) AS mean FROM l")
def ewma_series(t: Tables):
    """One series, without groups."""
    return windows.ewma(daily(t), "n", 0.1, "day").select("day", F.round("`n_ewma_0.10`", 6).alias("mean"))


@query(f"""WITH d AS (SELECT n - (SELECT avg(n) FROM ({DAILY})) AS d, row_number() OVER (ORDER BY day) AS t FROM ({DAILY})), r AS (SELECT k, sum(a.d * b.d) / (SELECT sum(d * d) FROM d) AS r FROM range(1, 3) r(k), d a JOIN d b ON b.t + k = a.t GROUP BY 1),
 p AS (SELECT (SELECT r FROM r WHERE k = 1) AS r1, (SELECT r FROM r WHERE k = 2) AS r2) SELECT unnest([0, 1, 2]) AS lag, round(unnest([1.0::DOUBLE, r1, (r2 - r1 * r1) / (1 - r1 * r1)]), 8) AS pacf FROM p""")
def partial_autocorrelation(t: Tables):
    y = [r["n"] for r in daily(t).orderBy("day").select("n").collect()]  # a day a row
    return t.spark.createDataFrame([(k, round(float(v), 8)) for k, v in enumerate(se.pacf(y, 2))], "lag int, pacf double")


@query("SELECT unnest(list_filter(['l_quantity', 'l_discount', 'l_tax', 'l_extendedprice'], lambda x: {'l_quantity': var_pop(l_quantity), 'l_discount': var_pop(l_discount), 'l_tax': var_pop(l_tax), 'l_extendedprice': var_pop(l_extendedprice)}[x] > 1)) AS name FROM lineitem".replace("{'l_quantity': var_pop", "map {'l_quantity': var_pop"))
def variance_threshold(t: Tables):
    return t.spark.createDataFrame([(c,) for c in pp.variance_threshold(t.lineitem, ["l_quantity", "l_discount", "l_tax", "l_extendedprice"], 1.0)], "name string")


@query("""WITH v AS (SELECT 'v' || vec_id AS word, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.word, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a, v b WHERE b.word = 'v7' AND a.word <> 'v7' ORDER BY list_cosine_similarity(a.e, b.e) DESC, a.word LIMIT 10""")
def most_similar(t: Tables):
    path = place(t)
    values = F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), " ")
    t.embeddings.select(F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.lit(" "), values).alias("value")).write.text(path)
    return rounded(emb.most_similar(emb.read_word_vectors(t.spark, path), "v7", 10))
