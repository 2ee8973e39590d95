"""Statistics, preprocessing, evaluation, text, vectors, series, models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quantiles
from ..functions import series as se
from ..functions import statistics as st
from ..functions import text as tx
from ..operators import evaluation as ev
from ..operators import models as ml
from ..operators import preprocessing as pp
from ..operators import trees
from ..operators import vectors as vec
from ..streaming import streams
from .registry import Tables, query


def rounded(df: DataFrame, digits: int = 6, besides: tuple[str, ...] = ()) -> DataFrame:
    """All double columns rounded; names may hold dots."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if k == "double" and c not in besides else F.col(f"`{c}`") for c, k in df.dtypes])


def one_row(t: Tables, values: dict) -> DataFrame:
    kinds = {float: "double", int: "bigint", str: "string"}
    clean = {k: v.item() if isinstance(v, np.generic) else v for k, v in values.items()}
    return t.spark.createDataFrame([tuple(clean.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in clean.items()))


# ---- statistics -------------------------------------------------------------------------



@query("""WITH x AS (SELECT value AS x FROM events), m AS (SELECT avg(x) AS m, stddev_samp(x) AS s FROM x)
 SELECT count(x) AS count, 0::BIGINT AS null_count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(var_samp(x), 4) AS variance, min(x) AS min,
 round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q75, max(x) AS max, round(max(x) - min(x), 6) AS range,
 round(avg(pow((x - m) / s, 3)), 6) AS skewness, round(avg(pow((x - m) / s, 4)) - 3, 6) AS kurtosis FROM x, m""")
def stats_column(t: Tables):
    rows = st.describe_column(t.events, "value")
    return rounded(rows.withColumn("variance", F.round("variance", 4)))


@query("""SELECT statistic, round(q, 4) AS l_quantity, round(d, 4) AS l_discount FROM (
 SELECT unnest(['count', 'mean', 'std', 'min', '25%', '50%', '75%', 'max']) AS statistic,
 unnest([count(l_quantity)::DOUBLE, avg(l_quantity), stddev_samp(l_quantity), min(l_quantity), quantile_cont(l_quantity, 0.25), quantile_cont(l_quantity, 0.5), quantile_cont(l_quantity, 0.75), max(l_quantity)]) AS q,
 unnest([count(l_discount)::DOUBLE, avg(l_discount), stddev_samp(l_discount), min(l_discount), quantile_cont(l_discount, 0.25), quantile_cont(l_discount, 0.5), quantile_cont(l_discount, 0.75), max(l_discount)]) AS d FROM lineitem)""")
def describe_frame(t: Tables):
    return rounded(st.describe(t.lineitem, ["l_quantity", "l_discount"]), 4)


@query("SELECT p_brand, round(quantile_cont(p_retailprice, 0.1), 6) AS p10, round(median(p_retailprice), 6) AS p50, round(quantile_cont(p_retailprice, 0.9), 6) AS p90 FROM part GROUP BY 1")
def percentiles(t: Tables):
    found = quantiles.grouped(t.part, ["p_brand"], "p_retailprice", [0.1, 0.5, 0.9])
    return rounded(found.select("p_brand", *[F.col("values")[k].alias(n) for k, n in enumerate(("p10", "p50", "p90"))]))


@query("WITH c AS (SELECT l_quantity, count(*) AS count FROM lineitem GROUP BY 1) SELECT * FROM c WHERE count = (SELECT max(count) FROM c)")
def mode(t: Tables):
    return st.modes(t.lineitem, "l_quantity")


@query("SELECT event_type, round(var_pop(value), 6) AS var0, round(var_samp(value), 6) AS var1, round(var_pop(value) * count(*) / (count(*) - 2), 6) AS var2 FROM events GROUP BY 1")
def variance_ddof(t: Tables):
    return rounded(t.events.groupBy("event_type").agg(*[st.variance(F.col("value"), k).alias(f"var{k}") for k in (0, 1, 2)]))


@query("SELECT round(corr(l_quantity, l_extendedprice), 8) AS pearson, round(covar_samp(l_quantity, l_discount), 8) AS cov1, round(covar_pop(l_quantity, l_discount), 8) AS cov0 FROM lineitem")
def pearson_covariance(t: Tables):
    return rounded(t.lineitem.agg(F.corr("l_quantity", "l_extendedprice").alias("pearson"), F.covar_samp("l_quantity", "l_discount").alias("cov1"), F.covar_pop("l_quantity", "l_discount").alias("cov0")), 8)


@query("""WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS a,
 rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0::DOUBLE AS b FROM part) SELECT round(corr(a, b), 8) AS spearman FROM r""")
def spearman(t: Tables):
    return rounded(st.spearman(t.part, "p_size", "p_retailprice"), 8)


@query("""SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS variable, round(unnest([1.0::DOUBLE, corr(l_quantity, l_discount), corr(l_quantity, l_tax)]), 8) AS l_quantity,
 round(unnest([corr(l_quantity, l_discount), 1.0::DOUBLE, corr(l_discount, l_tax)]), 8) AS l_discount, round(unnest([corr(l_quantity, l_tax), corr(l_discount, l_tax), 1.0::DOUBLE]), 8) AS l_tax FROM lineitem""")
def correlation_matrix(t: Tables):
    return rounded(st.correlation_matrix(t.lineitem, ["l_quantity", "l_discount", "l_tax"]), 8)


@query("""SELECT a.vec_id, round(list_dot_product(a.e, b.e), 6) AS dot, round(sqrt(list_dot_product(a.e, a.e)), 6) AS l2, round(list_sum(list_transform(a.e, lambda x: abs(x))), 6) AS l1,
 round(list_max(list_transform(a.e, lambda x: abs(x))), 6) AS linf, round(list_cosine_similarity(a.e, b.e), 6) AS cosine
 FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings)""")
def vector_algebra(t: Tables):
    a = t.embeddings.select("vec_id", F.col("embedding").alias("a"), ((F.col("vec_id") + 1) % t.embeddings.count()).alias("o"))
    rows = a.join(t.embeddings.select(F.col("vec_id").alias("o"), F.col("embedding").alias("b")), "o")
    x, y = F.col("a"), F.col("b")
    return rounded(rows.select("vec_id", st.dot(x, y).alias("dot"), st.norm(x).alias("l2"), st.norm(x, "l1").alias("l1"), st.norm(x, "inf").alias("linf"), st.cosine(x, y).alias("cosine")))


@query("""SELECT round((avg(o_totalprice) - 150000) / (stddev_samp(o_totalprice) / sqrt(count(*))), 6) AS statistic, count(*) - 1 AS df, round((avg(o_totalprice) - 150000) / stddev_samp(o_totalprice), 8) AS cohen_d FROM orders""")
def t_test_one_sample(t: Tables):
    r = st.t_test(t.orders, "o_totalprice", 150000)
    return rounded(one_row(t, {"statistic": round(r["statistic"], 6), "df": r["df"], "cohen_d": round(r["cohen_d"], 8)}), 8)


@query("""WITH g AS (SELECT o_orderstatus AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1), a AS (SELECT * FROM g WHERE g = 'F'), b AS (SELECT * FROM g WHERE g = 'O')
 SELECT round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS statistic, round(pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 4) AS df FROM a, b""")
def t_test_welch(t: Tables):
    r = st.t_test_two(t.orders, "o_totalprice", "o_orderstatus", "F", "O")
    return one_row(t, {"statistic": round(r["statistic"], 6), "df": round(r["df"], 4)})


@query("SELECT round(avg(l_tax - l_discount) / (stddev_samp(l_tax - l_discount) / sqrt(count(*))), 5) AS statistic FROM lineitem")
def t_test_paired(t: Tables):
    return one_row(t, {"statistic": round(st.t_test_paired(t.lineitem, "l_discount", "l_tax")["statistic"], 5)})


@query("""WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1), w AS (SELECT sum(n * m) / sum(n) AS grand, sum(n) AS n, count(*) AS k, sum(n * v) AS within FROM g)
 SELECT round((sum(g.n * pow(m - grand, 2)) / (any_value(k) - 1)) / (any_value(within) / (any_value(w.n) - any_value(k))), 6) AS statistic FROM g, w""")
def anova(t: Tables):
    return one_row(t, {"statistic": round(st.anova(t.orders, "o_totalprice", "o_orderpriority")["statistic"], 6)})


@query("WITH c AS (SELECT count(*)::DOUBLE AS n FROM events GROUP BY event_type) SELECT round(sum(pow(n - (SELECT avg(n) FROM c), 2) / (SELECT avg(n) FROM c)), 6) AS statistic FROM c")
def chi_square_fit(t: Tables):
    counts = [r["count"] for r in t.events.groupBy("event_type").count().collect()]
    return one_row(t, {"statistic": round(st.chi2_fit(counts)["statistic"], 6)})


@query("""WITH r AS (SELECT o_orderstatus AS g, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0::DOUBLE AS r FROM orders WHERE o_orderstatus IN ('F', 'O'))
 SELECT round(sum(r) - count(*) * (count(*) + 1) / 2.0, 2)::DOUBLE AS u FROM r WHERE g = 'F'""")
def mann_whitney(t: Tables):
    return one_row(t, {"u": float(round(st.mann_whitney(t.orders, "o_totalprice", "o_orderstatus", "F", "O")["statistic"], 2))})


@query()
def ks_normal(t: Tables):
    return one_row(t, {k: float(v) for k, v in st.ks_normal(t.part, "p_retailprice").items()})


@query()
def shapiro_wilk(t: Tables):
    return one_row(t, st.shapiro_wilk_column(t.supplier, "s_acctbal"))


LIVES = "SELECT (event_id % 50) AS d, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS e FROM events"


@query(f"""WITH c AS (SELECT d AS time, sum(e)::BIGINT AS events, count(*) AS n FROM ({LIVES}) GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY time DESC) AS at_risk FROM c)
 SELECT time, at_risk::BIGINT AS at_risk, events, n - events AS censored, round(CASE WHEN sum((events = at_risk)::INT) OVER (ORDER BY time) > 0 THEN 0 ELSE exp(sum(CASE WHEN events = at_risk THEN 0 ELSE ln(1 - events / at_risk) END) OVER (ORDER BY time)) END, 8) AS survival FROM r""")
def kaplan_meier(t: Tables):
    rows = t.events.select((F.col("event_id") % 50).alias("d"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(1).alias("e"))
    return rounded(st.kaplan_meier(rows, "d", "e"), 8)


@query()
def cox_hazards(t: Tables):
    rows = t.events.select((F.col("event_id") % 50 + 1).alias("d"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(1).alias("e"), (F.col("value") / 100).alias("x"))
    return one_row(t, {"beta": float(st.cox_ph(rows, "d", "e", ["x"])[0])})


@query()
def cox_durations(t: Tables):
    """Nearly as many durations as rows."""
    rows = t.events.select((F.col("value") + 1).alias("d"), (F.col("event_id") % 3 > 0).cast("int").alias("e"), (F.col("user_id") % 10 / 10).alias("x"), (F.col("event_type") == "click").cast("int").alias("z"))
    beta = st.cox_ph(rows, "d", "e", ["x", "z"])
    return one_row(t, {"x": round(float(beta[0]), 8), "z": round(float(beta[1]), 8)})


# ---- preprocessing -----------------------------------------------------------------------


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal FROM customer")
def scale_standard(t: Tables):
    rows = t.customer.select("c_custkey", "c_acctbal")
    return rounded(pp.standard_scaler(rows, ["c_acctbal"]).transform(rows))


@query("SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) * 2 - 1, 6) AS c_acctbal FROM customer")
def scale_min_max(t: Tables):
    rows = t.customer.select("c_custkey", "c_acctbal")
    return rounded(pp.min_max_scaler(rows, ["c_acctbal"], -1, 1).transform(rows))


@query("WITH q AS (SELECT quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS q FROM customer) SELECT c_custkey, round((c_acctbal - q[2]) / (q[3] - q[1]), 6) AS c_acctbal FROM customer, q")
def scale_robust(t: Tables):
    rows = t.customer.select("c_custkey", "c_acctbal")
    return rounded(pp.robust_scaler(rows, ["c_acctbal"]).transform(rows))


for _norm, _size in (("l1", "abs(q) + abs(x)"), ("l2", "sqrt(q * q + x * x)"), ("max", "greatest(abs(q), abs(x))")):
    query(f"SELECT k, n, round(q / ({_size}), 6) AS q, round(x / ({_size}), 6) AS x FROM (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q, l_tax AS x FROM lineitem)", f"normalize_{_norm}")(
        lambda t, norm=_norm: rounded(pp.normalize_rows(t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), F.col("l_tax").alias("x")), ["q", "x"], norm))
    )


@query("SELECT c_custkey, c_mktsegment, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INTEGER AS c_mktsegment_code FROM customer")
def encode_label(t: Tables):
    rows = t.customer.select("c_custkey", "c_mktsegment")
    return pp.fit_codes(rows, ["c_mktsegment"]).transform(rows)


@query("SELECT event_id, (event_type = 'click')::INT::DOUBLE AS event_type_click, (event_type = 'error')::INT::DOUBLE AS event_type_error, (event_type = 'purchase')::INT::DOUBLE AS event_type_purchase, (event_type = 'signup')::INT::DOUBLE AS event_type_signup, (event_type = 'view')::INT::DOUBLE AS event_type_view FROM events")
def encode_one_hot(t: Tables):
    rows = t.events.select("event_id", "event_type")
    return pp.fit_codes(rows, ["event_type"]).one_hot(rows, "event_type").drop("event_type")


@query("SELECT event_id, round((count(*) OVER w * avg(value) OVER w + 10 * avg(value) OVER ()) / (count(*) OVER w + 10), 6) AS event_type_target FROM events WINDOW w AS (PARTITION BY event_type)")
def encode_target(t: Tables):
    return rounded(pp.target_encode(t.events.select("event_id", "event_type", "value"), "event_type", "value").select("event_id", "event_type_target"))


@query("SELECT event_id, round(count(*) OVER (PARTITION BY event_type) / count(*) OVER (), 8) AS event_type_freq FROM events")
def encode_frequency(t: Tables):
    return rounded(pp.frequency_encode(t.events.select("event_id", "event_type"), "event_type").select("event_id", "event_type_freq"), 8)


GAPS = "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events"


def gaps(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))


for _strategy, _sql in (("mean", "(SELECT avg(v) FROM g)"), ("median", "(SELECT median(v) FROM g)"), ("mostFrequent", "(SELECT v FROM g WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)"), ("constant", "7.5::DOUBLE")):
    query(f"WITH g AS ({GAPS}) SELECT event_id, round(coalesce(v, {_sql}), 6) AS v FROM g", f"impute_{_strategy.lower()}")(
        lambda t, s=_strategy: rounded(pp.imputer(gaps(t), ["v"], s, 7.5).transform(gaps(t)))
    )


@query(f"SELECT event_id, v, (v IS NULL)::INTEGER AS v_missing FROM ({GAPS})")
def missing_indicator(t: Tables):
    return pp.missing_indicator(gaps(t), ["v"], only_missing=True)


@query("""WITH r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS a, s_nationkey::DOUBLE AS b FROM supplier),
 p AS (SELECT x.s_suppkey, y.a, row_number() OVER (PARTITION BY x.s_suppkey ORDER BY abs(x.b - y.b), y.a) AS n FROM r x, r y WHERE x.a IS NULL AND y.a IS NOT NULL), m AS (SELECT s_suppkey, avg(a) AS m FROM p WHERE n <= 3 GROUP BY 1)
 SELECT s_suppkey, round(coalesce(a, m, 0), 6) AS a, b FROM r LEFT JOIN m USING (s_suppkey)""")
def knn_impute(t: Tables):
    rows = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")).alias("a"), F.col("s_nationkey").cast("double").alias("b"))
    return pp.knn_impute(rows, ["a", "b"], rows, k=3).withColumn("a", F.round("a", 6))


@query("SELECT p_partkey, 1.0::DOUBLE AS poly_bias, p_size::DOUBLE AS poly_p_size, round(p_retailprice, 4) AS poly_p_retailprice, (p_size * p_size)::DOUBLE AS \"poly_p_size*p_size\", round(p_size * p_retailprice, 4) AS \"poly_p_size*p_retailprice\", round(p_retailprice * p_retailprice, 4) AS \"poly_p_retailprice*p_retailprice\" FROM part")
def polynomial(t: Tables):
    return rounded(pp.polynomial(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]).drop("p_size", "p_retailprice"), 4)


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * l_tax, 6) AS \"l_quantity*l_tax\" FROM lineitem")
def interactions(t: Tables):
    return rounded(pp.interactions(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"]).drop("l_quantity", "l_tax"))


@query("SELECT o_orderkey, year(o_orderdate)::INTEGER AS d_year, month(o_orderdate)::INTEGER AS d_month, day(o_orderdate)::INTEGER AS d_day, (dayofweek(o_orderdate) + 1)::INTEGER AS d_weekday, (dayofweek(o_orderdate) IN (0, 6))::INTEGER AS d_is_weekend FROM orders")
def date_parts(t: Tables):
    return pp.date_parts(t.orders.select("o_orderkey", F.col("o_orderdate").alias("d")), "d").drop("d")


@query()
def power_yeo_johnson(t: Tables):
    rows = t.customer.select("c_custkey", "c_acctbal")
    return pp.power_transformer(rows, ["c_acctbal"]).transform(rows)


@query("WITH m AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT c_custkey, least(4, greatest(0, floor((c_acctbal - lo) / ((hi - lo) / 5))))::INTEGER AS c_acctbal_bin FROM customer, m")
def bins_uniform(t: Tables):
    rows = t.customer.select("c_custkey", "c_acctbal")
    return pp.kbins(rows, ["c_acctbal"], 5).transform(rows).drop("c_acctbal")


@query("WITH q AS (SELECT quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS q FROM customer) SELECT c_custkey, (CASE WHEN c_acctbal >= q[3] THEN 3 WHEN c_acctbal >= q[2] THEN 2 WHEN c_acctbal >= q[1] THEN 1 ELSE 0 END)::INTEGER AS c_acctbal_bin FROM customer, q")
def bins_quantile(t: Tables):
    rows = t.customer.select("c_custkey", "c_acctbal")
    return pp.kbins(rows, ["c_acctbal"], 4, "quantile").transform(rows).drop("c_acctbal")


@query("SELECT unnest(['l_quantity', 'l_tax']) AS feature, round(unnest([var_pop(l_quantity), var_pop(l_tax)]), 8) AS score FROM lineitem")
def select_by_variance(t: Tables):
    found = pp.select_k_best(t.lineitem, ["l_quantity", "l_tax"], None, 2, "variance")
    return rounded(t.spark.createDataFrame(list(found.items()), "feature string, score double"), 8)


@query("""WITH x AS (SELECT l_returnflag AS g, unnest([l_quantity, l_tax, l_discount]) AS x, unnest(['l_quantity', 'l_tax', 'l_discount']) AS feature FROM lineitem),
 g AS (SELECT feature, g, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM x GROUP BY ALL), w AS (SELECT feature, sum(n * m) / sum(n) AS grand, sum(n) AS n, count(*) AS k, sum(n * v) AS within FROM g GROUP BY 1)
 SELECT feature, round((sum(g.n * pow(m - grand, 2)) / (any_value(k) - 1)) / (any_value(within) / (any_value(w.n) - any_value(k))), 5) AS score FROM g JOIN w USING (feature) GROUP BY 1 ORDER BY score DESC LIMIT 2""")
def select_k_best(t: Tables):
    found = pp.select_k_best(t.lineitem, ["l_quantity", "l_tax", "l_discount"], "l_returnflag", 2)
    return rounded(t.spark.createDataFrame(list(found.items()), "feature string, score double"), 5)


@query("SELECT event_type, (SELECT min(n) FROM (SELECT count(*) AS n FROM events GROUP BY event_type)) AS n FROM events GROUP BY 1")
def undersample(t: Tables):
    return pp.undersample(t.events.select("event_id", "event_type"), "event_type", "event_id").groupBy("event_type").agg(F.countDistinct("event_id").alias("n"))


@query("SELECT toxic AS label, (SELECT max(n) FROM (SELECT count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY toxic)) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def smote_balance(t: Tables):
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(F.col("toxic").alias("label"), F.col("n_chars").cast("double").alias("a"), F.col("quality").cast("double").alias("b"))
    return pp.smote(rows, ["a", "b"], "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# ---- evaluation ---------------------------------------------------------------------------

SCORED = "SELECT quality AS y, (n_chars > 1000)::INT AS p, round(least(n_chars, 5000) / 5000.0, 2)::DOUBLE AS s FROM labels JOIN documents USING (doc_id)"


def scored(t: Tables) -> DataFrame:
    """Scores rounded in binary, as the SQL does: 100 times the double 0.145 is
    below 14.5, while ``F.round`` with digits goes by the decimal 0.145."""
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    s = F.round(F.least("n_chars", F.lit(5000)) / 5000.0 * 100) / 100
    return rows.select(F.col("quality").alias("y"), (F.col("n_chars") > 1000).cast("int").alias("p"), s.alias("s"))


@query(f"""WITH c AS (SELECT count_if(y = 1 AND p = 1)::DOUBLE AS tp, count_if(y <> 1 AND p = 1)::DOUBLE AS fp, count_if(y = 1 AND p <> 1)::DOUBLE AS fn, count_if(y <> 1 AND p <> 1)::DOUBLE AS tn, avg((y = p)::INT) AS accuracy FROM ({SCORED}))
 SELECT round(accuracy, 8) AS accuracy, round(tp / (tp + fp), 8) AS precision, round(tp / (tp + fn), 8) AS recall, round(2 * tp / (2 * tp + fn + fp), 8) AS f1, round(5 * tp / (5 * tp + 4 * fn + fp), 8) AS f_beta, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 8) AS mcc FROM c""")
def metrics_classification(t: Tables):
    return rounded(ev.classification_metrics(scored(t), "y", "p", 1, 2.0), 8)


@query(f"""WITH s AS ({SCORED}), l AS (SELECT unnest([0, 1]) AS label) SELECT label, round(count_if(y = label AND p = label) / count_if(p = label), 8) AS precision, round(count_if(y = label AND p = label) / count_if(y = label), 8) AS recall,
 round(2 * count_if(y = label AND p = label) / (count_if(p = label) + count_if(y = label)), 8) AS f1, count_if(y = label)::BIGINT AS support FROM s, l GROUP BY 1""")
def metrics_report(t: Tables):
    return rounded(ev.classification_report(scored(t), "y", "p"), 8)


@query(f"WITH s AS ({SCORED}), n AS (SELECT count(*) AS n, avg((y = p)::INT) AS po, avg(y) * avg(p) + (1 - avg(y)) * (1 - avg(p)) AS pe FROM s) SELECT round((po - pe) / (1 - pe), 8) AS kappa FROM n")
def metrics_kappa(t: Tables):
    return rounded(ev.cohen_kappa(scored(t), "y", "p"), 8)


@query(f"SELECT round(avg(r), 8) AS balanced_accuracy FROM (SELECT avg((y = p)::INT) AS r FROM ({SCORED}) GROUP BY y)")
def metrics_balanced(t: Tables):
    return rounded(ev.balanced_accuracy(scored(t), "y", "p"), 8)


@query(f"WITH s AS (SELECT y, s, least(greatest(s, 1e-15), 1 - 1e-15) AS c FROM ({SCORED})) SELECT round(-avg(y * ln(c) + (1 - y) * ln(1 - c)), 6) AS log_loss, round(avg((s - y) * (s - y)), 8) AS brier FROM s")
def metrics_losses(t: Tables):
    rows = ev.probability_losses(scored(t), "y", "s")
    return rows.select(F.round("log_loss", 6).alias("log_loss"), F.round("brier", 8).alias("brier"))


@query(f"""WITH l AS (SELECT s, count_if(y = 1) AS p, count_if(y <> 1) AS n FROM ({SCORED}) GROUP BY 1), c AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp FROM l)
 SELECT round((sum(n * (tp - p / 2.0)) / (sum(p) * sum(n)))::DOUBLE, 8) AS roc_auc FROM c""")
def roc_auc(t: Tables):
    return rounded(ev.roc_auc(scored(t), "y", "s"), 8)


@query(f"""WITH l AS (SELECT s, count_if(y = 1) AS p, count_if(y <> 1) AS n FROM ({SCORED}) GROUP BY 1), a AS (SELECT sum(p) AS p, sum(n) AS n FROM l)
 SELECT s AS threshold, (sum(l.p) OVER (ORDER BY s DESC))::BIGINT AS tp, (sum(l.n) OVER (ORDER BY s DESC))::BIGINT AS fp, (a.p - sum(l.p) OVER (ORDER BY s DESC))::BIGINT AS fn, (a.n - sum(l.n) OVER (ORDER BY s DESC))::BIGINT AS tn FROM l, a""")
def roc_curve(t: Tables):
    return ev.ranking_curve(scored(t), "y", "s")


@query(f"""WITH l AS (SELECT s, count_if(y = 1) AS p, count_if(y <> 1) AS n FROM ({SCORED}) GROUP BY 1), c AS (SELECT s, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS a FROM l),
 r AS (SELECT tp / (tp + fp) AS pr, tp / a AS re, lag(tp / (tp + fp)) OVER (ORDER BY s DESC) AS p0, lag(tp / a) OVER (ORDER BY s DESC) AS r0 FROM c) SELECT round(sum((re - r0) * (pr + p0) / 2)::DOUBLE, 8) AS pr_auc FROM r""")
def pr_auc(t: Tables):
    return rounded(ev.pr_auc(scored(t), "y", "s"), 8)


@query("""WITH r AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem), a AS (SELECT avg(pow(y - p, 2)) AS mse, avg(abs(y - p)) AS mae, var_pop(y) AS vy, var_pop(y - p) AS ve, count(*) AS n, avg(abs((y - p) / y)) AS ape FROM r)
 SELECT round(mse / 1e6, 6) AS mse, round(sqrt(mse), 4) AS rmse, round(mae, 4) AS mae, round(1 - mse / vy, 8) AS r2, round(1 - (mse / vy) * (n - 1) / (n - 2), 8) AS adjusted_r2, round(ape * 100, 6) AS mape, round(1 - ve / vy, 8) AS explained_variance FROM a""")
def metrics_regression(t: Tables):
    rows = ev.regression_metrics(t.lineitem.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p")), "y", "p")
    digits = {"mse": 6, "rmse": 4, "mae": 4, "mape": 6}
    return rows.withColumn("mse", F.col("mse") / 1e6).select(*[F.round(c, digits.get(c, 8)).alias(c) for c in rows.columns])


@query("WITH n AS (SELECT count(*) AS n FROM orders) SELECT fold::INTEGER AS fold, (n // 4 + (fold < n % 4)::INT)::BIGINT AS rows FROM n, range(4) f(fold)")
def k_fold_sizes(t: Tables):
    return ev.k_fold(t.orders.select("o_orderkey"), "o_orderkey", 4).groupBy("fold").agg(F.countDistinct("o_orderkey").alias("rows"))


@query("WITH n AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderstatus, fold::INTEGER AS fold, (n // 3 + (fold < n % 3)::INT)::BIGINT AS rows FROM n, range(3) f(fold)")
def stratified_fold_sizes(t: Tables):
    return ev.stratified_k_fold(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 3).groupBy("o_orderstatus", "fold").agg(F.countDistinct("o_orderkey").alias("rows"))


@query("SELECT count(DISTINCT user_id) AS users, 1::BIGINT AS folds_of_user, count(*) AS rows FROM events")
def group_fold_whole(t: Tables):
    rows = ev.group_k_fold(t.events.select("event_id", "user_id"), "user_id", 4)
    per = rows.groupBy("user_id").agg(F.countDistinct("fold").alias("f"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("users"), F.max("f").alias("folds_of_user"), F.sum("n").alias("rows"))


# ---- text -----------------------------------------------------------------------------------


@query("SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::INTEGER AS n FROM documents")
def tokens_whitespace(t: Tables):
    return t.documents.select("doc_id", tx.count_tokens(F.col("text")).alias("n"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+'))::INTEGER AS n, md5(array_to_string(regexp_extract_all(text, '[A-Za-z]+'), '|')) AS w FROM documents")
def tokens_regex(t: Tables):
    found = t.documents.select("doc_id", tx.regex_tokens(F.col("text"), "[A-Za-z]+").alias("w"))
    return found.select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", "|")).alias("w"))


@query("SELECT conv_id, turn, len(list_filter(string_split_regex(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''))::INTEGER AS n FROM conversations")
def sentence_counts(t: Tables):
    return t.conversations.select("conv_id", "turn", F.size(tx.sentences(F.col("text"))).alias("n"))


@query("WITH w AS (SELECT item_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark) SELECT item_id, array_to_string(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]), '|') AS g FROM w")
def ngrams(t: Tables):
    return t.benchmark.select("item_id", F.array_join(tx.ngrams(tx.whitespace_tokens(F.col("text")), 1, 2), "|").alias("g"))


@query("SELECT item_id, regexp_replace(lower(text), '\\p{P}', '', 'g') AS text FROM benchmark")
def normalize_text(t: Tables):
    return t.benchmark.select("item_id", tx.normalize(F.col("text")).alias("text"))


@query("SELECT item_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '' AND lower(x) NOT IN (" + ", ".join("'" + w.replace("'", "''") + "'" for w in tx.STOP_WORDS) + ")), ' ') AS text FROM benchmark")
def stop_words(t: Tables):
    return t.benchmark.select("item_id", F.array_join(tx.remove_stop_words(tx.whitespace_tokens(F.col("text"))), " ").alias("text"))


@query("SELECT item_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')[1:12], ' ') AS text FROM benchmark")
def context_truncate(t: Tables):
    return t.benchmark.select("item_id", tx.truncate_tokens(F.col("text"), 12).alias("text"))


@query("SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS token FROM documents) WHERE token <> '' GROUP BY ALL")
def count_vectors(t: Tables):
    return tx.count_vectors(t.documents, "doc_id", tx.whitespace_tokens(F.col("text")))


@query("""WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS token FROM documents), c AS (SELECT doc_id, token, count(*) AS n FROM w WHERE token <> '' GROUP BY ALL), l AS (SELECT doc_id, sum(n) AS len FROM c GROUP BY 1),
 d AS (SELECT token, count(*) AS df FROM c GROUP BY 1) SELECT doc_id, token, round(n / len * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1), 8) AS tfidf FROM c JOIN l USING (doc_id) JOIN d USING (token) WHERE df >= 5""")
def tfidf(t: Tables):
    return rounded(tx.tfidf(t.documents, "doc_id", tx.whitespace_tokens(F.col("text")), min_df=5), 8)


@query("""WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS token FROM documents), c AS (SELECT doc_id, token, count(*) AS n FROM w WHERE token <> '' GROUP BY ALL), l AS (SELECT doc_id, sum(n) AS len FROM c GROUP BY 1),
 d AS (SELECT token, count(*) AS df FROM c GROUP BY 1 ORDER BY df DESC, token LIMIT 50) SELECT doc_id, token, round(n / len * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1), 8) AS tfidf FROM c JOIN l USING (doc_id) JOIN d USING (token)""")
def tfidf_max_features(t: Tables):
    return rounded(tx.tfidf(t.documents, "doc_id", tx.whitespace_tokens(F.col("text")), max_features=50), 8)


@query()
def stem_sentiment(t: Tables):
    rows = t.documents.where("lang = 'en'").select("doc_id", tx.stem_text(F.col("text")).alias("stems"), tx.sentiment(F.col("text")).alias("s"))
    return rows.select("doc_id", F.length("stems").alias("n"), F.round("s.compound", 6).alias("compound"))


@query()
def hashing_vectors(t: Tables):
    return t.benchmark.select("item_id", tx.hashing_vector(tx.whitespace_tokens(F.col("text")), 64).alias("v"), tx.local_embedding(F.col("text"), 32).alias("e"))


_hits = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in words)}))) AS {lang}" for lang, words in sorted(tx.PROFILES.items()))


@query(f"""WITH d AS (SELECT doc_id, lang, string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}]+') AS w FROM documents), n AS (SELECT doc_id, lang, {_hits} FROM d)
 SELECT doc_id, lang, CASE WHEN greatest(de, en, es, fr) = 0 THEN NULL WHEN de >= greatest(en, es, fr) THEN 'de' WHEN en >= greatest(es, fr) THEN 'en' WHEN es >= fr THEN 'es' ELSE 'fr' END AS found FROM n""")
def detect_language(t: Tables):
    return t.documents.select("doc_id", "lang", tx.detect_language(F.col("text")).alias("found"))


@query("""WITH d AS (SELECT doc_id, lang, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM documents),
 k AS (SELECT lang, ln(count(*) / (SELECT count(*)::DOUBLE FROM documents WHERE doc_id % 2 = 0)) AS prior FROM documents WHERE doc_id % 2 = 0 GROUP BY 1),
 c AS (SELECT w, lang, count(*) AS n FROM d WHERE doc_id % 2 = 0 GROUP BY ALL), v AS (SELECT DISTINCT w FROM c), s AS (SELECT lang, sum(n) AS total FROM c GROUP BY 1),
 g AS (SELECT v.w, s.lang, ln((coalesce(c.n, 0) + 1) / (s.total + (SELECT count(*) FROM v))::DOUBLE) AS weight FROM v CROSS JOIN s LEFT JOIN c ON c.w = v.w AND c.lang = s.lang),
 p AS (SELECT doc_id, g.lang, sum(weight) AS score FROM d JOIN g ON g.w = d.w WHERE doc_id % 2 = 1 GROUP BY ALL)
 SELECT o.doc_id, arg_max(k.lang, k.prior + coalesce(p.score, 0)) AS lang FROM documents o CROSS JOIN k LEFT JOIN p ON p.doc_id = o.doc_id AND p.lang = k.lang WHERE o.doc_id % 2 = 1 GROUP BY 1""")
def naive_bayes(t: Tables):
    rows = t.documents.select("doc_id", "lang", tx.whitespace_tokens(F.lower("text")).alias("w"))
    model = tx.naive_bayes(rows.where("doc_id % 2 = 0"), "lang", "w")
    return tx.naive_bayes_predict(rows.where("doc_id % 2 = 1"), "doc_id", "w", model, "lang")


# ---- vectors ------------------------------------------------------------------------------------

for _metric, _score, _order in (("dot", "list_dot_product(e, q)", "DESC"), ("cosine", "list_cosine_similarity(e, q)", "DESC"), ("l2", "list_distance(e, q)", "")):
    query(f"WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE id = 7) SELECT id, round({_score}, 6) AS score FROM v, q ORDER BY {_score} {_order}, id LIMIT 10", f"vector_search_{_metric}")(
        lambda t, m=_metric: rounded(vec.VectorStore(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))).search(t.embeddings.where("vec_id = 7").first()["embedding"], 10, m).select("id", "score"))
    )



@query("""WITH l AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings), m AS (SELECT label, k, avg(v) AS m FROM l GROUP BY ALL)
 SELECT round(sum(pow(v - m, 2)), 4) AS inertia FROM l JOIN m USING (label, k)""")
def inertia(t: Tables):
    return rounded(vec.inertia(t.embeddings, "embedding", "label"), 4)


@query("""WITH l AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings), m AS (SELECT label, k, avg(v) AS m, count(*) AS n FROM l GROUP BY ALL), g AS (SELECT k, avg(v) AS g FROM l GROUP BY 1),
 w AS (SELECT sum(pow(v - m, 2)) AS w FROM l JOIN m USING (label, k)), b AS (SELECT sum(n * pow(m - g, 2)) AS b, count(DISTINCT label) AS c FROM m JOIN g USING (k)) SELECT round((b / (c - 1)) / (w / ((SELECT count(*) FROM embeddings) - c)), 5) AS score FROM w, b""")
def calinski_harabasz(t: Tables):
    return one_row(t, {"score": round(vec.calinski_harabasz(t.embeddings, "embedding", "label"), 5)})


@query("""WITH l AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings), m AS (SELECT label, k, avg(v) AS m FROM l GROUP BY ALL),
 s AS (SELECT label, avg(d) AS s FROM (SELECT vec_id, label, sqrt(sum(pow(v - m, 2))) AS d FROM l JOIN m USING (label, k) GROUP BY ALL) GROUP BY 1),
 p AS (SELECT a.label AS x, b.label AS y, sqrt(sum(pow(a.m - b.m, 2))) AS d FROM m a JOIN m b ON a.k = b.k AND a.label <> b.label GROUP BY ALL) SELECT round(avg(r), 6) AS score FROM (SELECT x, max((s1.s + s2.s) / d) AS r FROM p JOIN s s1 ON s1.label = x JOIN s s2 ON s2.label = y GROUP BY 1)""")
def davies_bouldin(t: Tables):
    return one_row(t, {"score": round(vec.davies_bouldin(t.embeddings, "embedding", "label"), 6)})


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.e, b.e)) AS s, count(*) FILTER (a.vec_id <> b.vec_id) AS n FROM v a, v b GROUP BY ALL),
 m AS (SELECT vec_id, sum(CASE WHEN own = other THEN s / n END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM d GROUP BY 1) SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM m""")
def silhouette(t: Tables):
    return one_row(t, {"silhouette": round(vec.silhouette(t.embeddings, "vec_id", "embedding", "label"), 6)})


@query("WITH c AS (SELECT label, vec_id % 3 AS b, count(*) AS n FROM embeddings GROUP BY ALL), p AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS cc, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY label)) AS ra, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS rb, (SELECT sum(n) FROM c) AS n) SELECT round((cc - ra * rb / (n * (n - 1) / 2)) / ((ra + rb) / 2 - ra * rb / (n * (n - 1) / 2)), 8) AS ari FROM p")
def adjusted_rand(t: Tables):
    return rounded(vec.adjusted_rand(t.embeddings.withColumn("b", F.col("vec_id") % 3), "label", "b"), 8)


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT vec_id AS k, e FROM v WHERE vec_id < 4) SELECT vec_id, (arg_min(k, list_distance(v.e, c.e)))::INTEGER AS cluster FROM v, c GROUP BY 1""")
def kmeans_assign(t: Tables):
    centers = np.array([r["embedding"] for r in t.embeddings.where("vec_id < 4").orderBy("vec_id").collect()], float)
    return vec.assign(t.embeddings.select("vec_id", "embedding"), "embedding", centers).select("vec_id", "cluster")


@query()
def kmeans_fit(t: Tables):
    centers = vec.kmeans(t.embeddings, "embedding", 5, rounds=10)
    return vec.assign(t.embeddings, "embedding", centers).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cost"), 4).alias("cost"))


@query("SELECT round(sum(v), 6) AS total FROM (SELECT var_samp(x) AS v FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY k)")
def pca_trace(t: Tables):
    """All components together explain the trace of the covariance."""
    return one_row(t, {"total": round(float(vec.pca(t.embeddings, "embedding", 64)["variance"].sum()), 6)})


@query("SELECT round(sum(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 3) AS energy FROM embeddings")
def svd_energy(t: Tables):
    """All singular values together hold the squares of all entries."""
    values, _ = vec.row_svd(t.embeddings, "embedding", 64)
    return one_row(t, {"energy": round(float((values**2).sum()), 3)})


@query()
def svd_fit(t: Tables):
    values, _ = vec.row_svd(t.embeddings, "embedding", 4, power=6)
    return t.spark.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(values)], "component int, value double")


@query()
def pca_fit(t: Tables):
    model = vec.pca(t.embeddings, "embedding", 3)
    return t.spark.createDataFrame([(k, float(v), float(r)) for k, (v, r) in enumerate(zip(model["variance"], model["ratio"], strict=True))], "component int, variance double, ratio double")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT a.vec_id, b.vec_id AS other, list_distance(a.e, b.e) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS r FROM v a JOIN v b ON a.vec_id <> b.vec_id) SELECT vec_id, other, round(d, 5) AS distance FROM n WHERE r <= 3""")
def nearest_neighbours(t: Tables):
    return rounded(vec.neighbours(t.embeddings, "vec_id", "embedding", k=3), 5)


NEAR = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
 p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id)"""


@query(f"""WITH RECURSIVE {NEAR}, n AS (SELECT a, b FROM p WHERE d <= 0.9), c AS (SELECT a FROM n GROUP BY a HAVING count(*) + 1 >= 4),
 l AS (SELECT n.a, n.b FROM n JOIN c x ON n.a = x.a JOIN c y ON n.b = y.a), r(a, b) AS (SELECT a, a FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
 k AS (SELECT a, min(b) AS label FROM r GROUP BY a), o AS (SELECT n.a, min(k.label) AS label FROM n JOIN k ON n.b = k.a WHERE n.a NOT IN (SELECT a FROM c) GROUP BY n.a),
 e AS (SELECT * FROM k UNION ALL SELECT * FROM o)
 SELECT v.vec_id, coalesce(dense_rank() OVER (PARTITION BY e.a IS NULL ORDER BY e.label) * CASE WHEN e.a IS NULL THEN NULL ELSE 1 END - 1, -1)::INTEGER AS cluster FROM v LEFT JOIN e ON v.vec_id = e.a""")
def dbscan(t: Tables):
    return vec.dbscan(t.embeddings, "vec_id", "embedding", eps=0.9, min_samples=4)


@query(f"""WITH {NEAR}, n AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM p), k AS (SELECT a, b, d FROM n WHERE r <= 10), m AS (SELECT a, max(d) AS kd FROM k GROUP BY a),
 y AS (SELECT k.a, 1 / greatest(avg(greatest(k.d, m.kd)), 1e-12) AS lrd FROM k JOIN m ON k.b = m.a GROUP BY k.a)
 SELECT k.a AS vec_id, round(avg(o.lrd) / any_value(y.lrd), 5) AS lof FROM k JOIN y ON k.a = y.a JOIN y o ON k.b = o.a GROUP BY k.a""")
def outlier_factor(t: Tables):
    return rounded(vec.local_outlier_factor(t.embeddings, "vec_id", "embedding", k=10), 5)


@query()
def isolation_forest(t: Tables):
    return vec.outlier_labels(vec.isolation_forest(t.embeddings, "embedding", trees=25), "anomaly").select("vec_id", "anomaly", "label")


# ---- series --------------------------------------------------------------------------------------

DAILY = "SELECT date_trunc('day', o_orderdate)::DATE AS day, count(*) AS n FROM orders GROUP BY 1"


def daily(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH d AS (SELECT day, n, row_number() OVER (ORDER BY day) - 1 AS t, count(*) OVER () AS c FROM ({DAILY})), r AS (SELECT *, CASE WHEN t >= 3 AND t < c - 3 THEN avg(n) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS trend FROM d),
 m AS (SELECT t % 7 AS p, avg(n - trend) AS m FROM r GROUP BY 1), s AS (SELECT p, m - (SELECT avg(m) FROM m) AS s FROM m) SELECT day, round(trend, 6) AS trend, round(s, 6) AS seasonal, round(n - trend - s, 6) AS residual FROM r JOIN s ON t % 7 = p""")
def decompose(t: Tables):
    return rounded(se.decompose_frame(daily(t), "n", "day", 7).select("day", "trend", "seasonal", "residual"))


@query(f"""WITH d AS (SELECT n - (SELECT avg(n) FROM ({DAILY})) AS d, row_number() OVER (ORDER BY day) AS t FROM ({DAILY})) SELECT k::INTEGER AS lag, round(sum(a.d * b.d) / (SELECT sum(d * d) FROM d), 8) AS acf FROM range(6) r(k), d a JOIN d b ON b.t + k = a.t GROUP BY 1""")
def autocorrelation(t: Tables):
    return rounded(se.acf_frame(daily(t), "n", "day", 5), 8)


def by_type(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("n"))


for _model, _fit in {
    "forecast_simple": lambda y, h: se.exponential_smoothing(y, h),
    "forecast_double": lambda y, h: se.exponential_smoothing(y, h, "double"),
    "forecast_holt_winters": lambda y, h: se.exponential_smoothing(y, h, "holtWinters", 7),
    "forecast_ets": lambda y, h: se.ets_auto(y, h, 7),
    "forecast_arima": lambda y, h: se.arima(y, h),
    "forecast_sarima": lambda y, h: se.sarima(y, h, (1, 0, 0), (1, 0, 0, 7)),
    "forecast_garch": lambda y, h: se.garch(y, h),
    "forecast_kalman": lambda y, h: se.kalman_1d(y, horizon=h),
    "forecast_koopman": lambda y, h: se.koopman(y, h),
    "forecast_piecewise": lambda y, h: se.piecewise_trend(y, h),
}.items():
    query(None, _model)(lambda t, fit=_fit: se.forecast_frame(by_type(t), ["event_type"], "day", "n", lambda y, h: {"forecast": np.ravel(fit(y, h)["forecast"])}, 5))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_tumbling(t: Tables):
    rows = streams.tumbling(t.events, "ts", "6 hours", "1 hour", ["event_type"], n=F.count(F.lit(1)), total=F.round(F.sum("value"), 4))
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz")).drop("end")


# ---- models ------------------------------------------------------------------------------------------


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def ols(t: Tables):
    m = ml.linear_regression(t.lineitem, ["l_quantity"], "l_extendedprice")
    return one_row(t, {"slope": round(m.weights[0], 6), "intercept": round(m.bias, 4)})


def labelled(t: Tables) -> DataFrame:
    """Line items, with a label and a value that other columns tell."""
    label = (F.col("l_quantity") + 200 * F.col("l_discount") > 35).cast("int")
    return t.lineitem.withColumns({"label": label, "value": F.col("l_quantity") * (1 - 5 * F.col("l_discount"))})


@query()
def logistic(t: Tables):
    m = ml.logistic_regression(labelled(t), ["l_quantity", "l_discount"], "label")
    return ev.classification_metrics(m.transform(labelled(t)), "label", "prediction")


@query()
def linear_svc(t: Tables):
    m = ml.linear_svc(labelled(t), ["l_quantity", "l_discount"], "label", rounds=10)
    return ev.classification_metrics(m.transform(labelled(t)), "label", "prediction")


SPLITS = """x AS (SELECT unnest([0, 1]) AS feature, unnest([l_discount, l_quantity]) AS v, l_extendedprice AS y FROM lineitem),
 g AS (SELECT feature, v, count(*)::DOUBLE AS n, sum(y) AS s FROM x GROUP BY ALL),
 p AS (SELECT feature, v, lead(v) OVER w AS following, sum(n) OVER w AS m, sum(s) OVER w AS l, sum(n) OVER f AS n, sum(s) OVER f AS s FROM g WINDOW w AS (PARTITION BY feature ORDER BY v), f AS (PARTITION BY feature)),
 c AS (SELECT *, (l * l / m + (s - l) * (s - l) / (n - m) - s * s / n) / n AS gain FROM p WHERE following IS NOT NULL)"""


@query(f"WITH {SPLITS} SELECT feature::INTEGER AS feature, round(v + (following - v) / 2, 6) AS threshold, round(gain / 1e6, 4) AS gain, round(l / m, 3) AS below, round((s - l) / (n - m), 3) AS above FROM c ORDER BY c.gain DESC, feature, v LIMIT 1")
def tree_split(t: Tables):
    """The best of all cuts of a table."""
    tree = trees.decision_tree(t.lineitem, ["l_discount", "l_quantity"], "l_extendedprice", "mse", max_depth=1)
    top, low, high = tree.nodes
    return one_row(t, {"feature": top.feature, "threshold": round(top.threshold, 6), "gain": round(top.gain / 1e6, 4), "below": round(tree.value(low), 3), "above": round(tree.value(high), 3)}).withColumn("feature", F.col("feature").cast("int"))


@query()
def exact_tree(t: Tables):
    columns = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    rows = labelled(t)
    tree = trees.decision_tree(rows, columns, "label", "entropy", max_depth=4)
    return tree.transform(rows).select("l_orderkey", "l_linenumber", "label", "prediction")


@query()
def random_forest(t: Tables):
    rows = labelled(t)
    forest = trees.random_forest(rows, ["l_quantity", "l_discount", "l_tax"], "label", trees=5, max_depth=3, features=2)
    return ev.classification_metrics(forest.transform(rows), "label", "prediction")


@query()
def boosted_trees(t: Tables):
    rows = labelled(t).select("l_quantity", "l_discount", "l_tax", "value")
    fitted = ml.fit_counted(rows, "gbt_regressor", ["l_quantity", "l_discount", "l_tax"], "value", maxIter=5, seed=1)
    return ev.regression_metrics(fitted.transform(rows), "value", "prediction", 3)


@query()
def one_vs_rest(t: Tables):
    columns = [f"e{k}" for k in range(8)]
    rows = t.embeddings.select("label", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(columns)])
    return ev.classification_report(ml.predict_one_vs_rest(rows, ml.one_vs_rest(rows, columns, "label")), "label", "prediction")


@query()
def partial_dependence(t: Tables):
    rows = t.lineitem.select("l_quantity", "l_discount", "l_extendedprice")
    m = ml.linear_regression(rows, ["l_quantity", "l_discount"], "l_extendedprice")
    return rounded(ml.partial_dependence(rows, "l_quantity", m.transform), 2)


@query("SELECT s_suppkey, unnest([0, 1, 2])::INTEGER AS feature, round(unnest([s_acctbal, 2.0::DOUBLE * s_nationkey, 3.0::DOUBLE * length(s_name)]), 5) AS shap FROM supplier")
def kernel_shap(t: Tables):
    """Of a linear model: weights times values."""
    rows = t.supplier.select("s_suppkey", "s_acctbal", "s_nationkey", F.length("s_name").alias("n"))
    weights = np.arange(1, 4.0)
    found = ml.shap_frame(rows, ["s_acctbal", "s_nationkey", "n"], lambda x: x @ weights, np.zeros((4, 3)))
    return rounded(found.select("s_suppkey", F.posexplode("shap").alias("feature", "shap")), 5)


@query()
def tree_shap(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice")
    fitted = ml.fit_counted(rows, "decision_tree_regressor", ["l_quantity", "l_discount"], "l_extendedprice", maxDepth=3)
    return ml.tree_shap_frame(rows, ["l_quantity", "l_discount"], fitted.stages[-1], np.array([[q, d] for q in (5, 15, 25, 35, 45) for d in (0.0, 0.05, 0.1)])).drop("l_extendedprice")
