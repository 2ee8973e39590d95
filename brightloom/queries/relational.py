"""Projection, filters, joins, grouping, reshaping, windows, order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frame, predicates, relational, windows
from ..plans import command
from .registry import Tables, query

#: Values with nulls at every seventh event, in both engines.
GAPS = "SELECT event_id, user_id, event_type, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events"


def gaps(t: Tables):
    return t.events.select("event_id", "user_id", "event_type", "ts", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
 round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def flagship(t: Tables):
    rows = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count(F.lit(1)).alias("n"),
    )


@query("SELECT o_orderkey AS id, o_custkey, o_totalprice FROM orders")
def scan_select_drop_rename(t: Tables):
    rows = frame.select(t.orders, "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return frame.rename(frame.drop(rows, "o_orderstatus"), "o_orderkey", "id")


FILTERS = {
    "equals": ("orders", "o_orderkey", "o_orderstatus", "==", "F", "= 'F'"),
    "not_equals": ("orders", "o_orderkey", "o_orderstatus", "!=", "F", "<> 'F'"),
    "greater": ("orders", "o_orderkey", "o_totalprice", ">", 200000.0, "> 200000"),
    "less": ("orders", "o_orderkey", "o_totalprice", "<", 50000.0, "< 50000"),
    "greater_equal": ("customer", "c_custkey", "c_nationkey", ">=", 20, ">= 20"),
    "less_equal": ("part", "p_partkey", "p_size", "<=", 10, "<= 10"),
    "contains": ("part", "p_partkey", "p_type", "contains", "BRASS", "LIKE '%BRASS%'"),
}
for _name, (_table, _key, _column, _op, _value, _sql) in FILTERS.items():
    query(f"SELECT {_key}, {_column} FROM {_table} WHERE {_column} {_sql}", f"filter_{_name}")(
        lambda t, a=_table, k=_key, c=_column, o=_op, v=_value: predicates.filter_where(getattr(t, a), c, o, v).select(k, c)
    )


@query(f"SELECT event_id FROM ({GAPS}) WHERE v IS NULL")
def filter_is_null(t: Tables):
    return predicates.filter_where(gaps(t), "v", "isNull").select("event_id")


@query(f"SELECT event_id, v FROM ({GAPS}) WHERE v IS NOT NULL")
def filter_is_not_null(t: Tables):
    return predicates.filter_where(gaps(t), "v", "isNotNull").select("event_id", "v")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02 OR l_returnflag = 'R' AND l_quantity < 2")
def filter_expression(t: Tables):
    return predicates.filter_expr(t.lineitem, "l_quantity > 45 AND l_discount < 0.02 OR l_returnflag = 'R' AND l_quantity < 2").select("l_orderkey", "l_linenumber")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) WHERE i % 100 = 3")
def filter_rows_by_position(t: Tables):
    return frame.filter_positions(t.events.select("event_id"), lambda i: i % 100 == 3, "event_id")


@query("SELECT p_partkey, TRY_CAST(trim(p_name) AS DOUBLE) AS p_name, TRY_CAST(p_size AS VARCHAR) AS p_size FROM part")
def cast_try(t: Tables):
    rows = t.part.select("p_partkey", "p_name", "p_size")
    return frame.cast_column(frame.cast_column(rows, "p_name", "double", strict=False), "p_size", "string")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem")
def add_column(t: Tables):
    charge = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")), 6)
    return frame.add_column(t.lineitem, "charge", charge).select("l_orderkey", "l_linenumber", "charge")


@query("SELECT c_custkey, lower(c_mktsegment) AS c_mktsegment FROM customer")
def map_column(t: Tables):
    return frame.map_column(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", F.lower)


@query(f"SELECT event_id, user_id, v, lag(v, 2) OVER w AS v_lag, lead(v, 1) OVER w AS v_lead FROM ({GAPS}) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def lag_lead(t: Tables):
    rows = gaps(t).select("event_id", "user_id", "v")
    return frame.with_lag(frame.with_lag(rows, "v", 2, "v_lag", "event_id", ["user_id"]), "v", -1, "v_lead", "event_id", ["user_id"])


@query(f"SELECT event_id, v FROM ({GAPS}) WHERE v IS NOT NULL", "drop_nulls")
def _drop_nulls(t: Tables):
    return frame.drop_nulls(gaps(t).select("event_id", "v"), "v")


@query(f"SELECT event_id, coalesce(v, -1) AS v FROM ({GAPS})")
def fill_nulls(t: Tables):
    return frame.fill_null(gaps(t).select("event_id", "v"), "v", -1)


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_id FROM events")
def row_ids(t: Tables):
    return frame.with_row_id(t.events.select("event_id"), "event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) JOIN (VALUES (5), (0), (5), (99)) p(i) USING (i)")
def gather(t: Tables):
    return frame.gather(t.events.select("event_id"), [5, 0, 5, 99], "event_id")


# ---- joins ----------------------------------------------------------------------------

for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    query(
        f"SELECT coalesce(c.k, o.k) AS k, c.c_acctbal, o.o_totalprice FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey END AS k, c_acctbal FROM customer) c {_sql} (SELECT o_custkey AS k, o_totalprice FROM orders) o ON c.k = o.k",
        f"join_{_how}",
    )(
        lambda t, how=_how: relational.join(
            # a third of the customers get keys that no order has
            t.customer.select(F.when(F.col("c_custkey") % 3 == 0, -F.col("c_custkey")).otherwise(F.col("c_custkey")).alias("k"), "c_acctbal"),
            t.orders.select(F.col("o_custkey").alias("k"), "o_totalprice"),
            "k",
            how,
        )
    )


@query("SELECT c_custkey AS k, c_acctbal FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(t: Tables):
    return relational.join(t.customer.select(F.col("c_custkey").alias("k"), "c_acctbal"), t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("k")), "k", "semi")


@query("SELECT c_custkey AS k, c_acctbal FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(t: Tables):
    return relational.join(t.customer.select(F.col("c_custkey").alias("k"), "c_acctbal"), t.orders.select(F.col("o_custkey").alias("k")), "k", "anti")


@query("SELECT a.n_regionkey AS k, a.n_name AS name_x, r.r_name AS name_y FROM nation a JOIN region r ON a.n_regionkey = r.r_regionkey")
def join_suffixes(t: Tables):
    return relational.join(t.nation.select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("name")), t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), "k")


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
 JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def join_star(t: Tables):
    rows = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t.supplier, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    rows = rows.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).where("r_name = 'ASIA'")
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


# ---- grouping -------------------------------------------------------------------------

ITEMS = ("l_returnflag", "l_quantity", "l_tax")


def items(t: Tables):
    return t.lineitem.select(*ITEMS)


@query("SELECT l_returnflag, count(*) AS l_quantity, count(*) AS l_tax FROM lineitem GROUP BY 1")
def group_count(t: Tables):
    return relational.group_by(items(t), "l_returnflag").count()


for _how, _sql in (("sum", "sum"), ("mean", "avg"), ("min", "min"), ("max", "max")):
    query(f"SELECT l_returnflag, round({_sql}(l_quantity), 6) AS l_quantity, round({_sql}(l_tax), 6) AS l_tax FROM lineitem GROUP BY 1", f"group_{_how}")(
        lambda t, how=_how: getattr(relational.group_by(items(t), "l_returnflag"), how)().select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("l_quantity", "l_tax")])
    )


@query(f"SELECT event_type, user_id, round(sum(v), 6) AS v_sum, count(v) AS v_count, max(event_id)::DOUBLE AS event_id_max FROM ({GAPS}) GROUP BY ALL")
def group_agg_multi_key(t: Tables):
    rows = relational.group_by(gaps(t), "event_type", "user_id").agg({"v": ["sum", "count"], "event_id": "max"})
    return rows.withColumn("v_sum", F.round("v_sum", 6))


@query(f"SELECT user_id, arg_min(v, event_id) FILTER (v IS NOT NULL) AS v_first FROM ({GAPS}) GROUP BY 1")
def group_first(t: Tables):
    return relational.group_by(gaps(t), "user_id").agg({"v": "first"}, order_by="event_id")


@query(f"SELECT user_id, arg_max(v, event_id) FILTER (v IS NOT NULL) AS v_last FROM ({GAPS}) GROUP BY 1")
def group_last(t: Tables):
    return relational.group_by(gaps(t), "user_id").agg({"v": "last"}, order_by="event_id")


@query(f"SELECT event_id, v, round(avg(v) OVER (PARTITION BY event_type), 6) AS v_group_mean FROM ({GAPS})")
def group_transform(t: Tables):
    rows = relational.group_by(gaps(t), "event_type").transform({"v": "mean"})
    return rows.select("event_id", "v", F.round("v_group_mean", 6).alias("v_group_mean"))


@query(f"SELECT CASE WHEN user_id % 4 <> 0 THEN user_id % 4 END AS k, round(sum(v), 6) AS v_sum FROM ({GAPS}) GROUP BY 1")
def group_null_key(t: Tables):
    rows = gaps(t).withColumn("k", F.when(F.col("user_id") % 4 != 0, F.col("user_id") % 4))
    return relational.group_by(rows, "k").agg({"v": "sum"}).withColumn("v_sum", F.round("v_sum", 6))


for _how, _sql in (("mean", "round(avg({}), 6)"), ("sum", "round(sum({}), 2)"), ("count", "count({})"), ("min", "min({})"), ("max", "max({})")):
    _cells = ", ".join(f"{_sql.format(f'CASE WHEN l_linestatus = {chr(39)}{s}{chr(39)} THEN l_quantity END')} AS {s}" for s in "FO")
    query(f"SELECT l_returnflag, {_cells} FROM lineitem GROUP BY 1", f"pivot_{_how}")(
        lambda t, how=_how: relational.pivot(t.lineitem, "l_returnflag", "l_linestatus", "l_quantity", how, names=["F", "O"]).select(
            "l_returnflag", *[F.round(c, 2 if how == "sum" else 6).alias(c) if how != "count" else F.coalesce(c, F.lit(0)).alias(c) for c in "FO"]
        )
    )


@query("SELECT s_suppkey, variable, value FROM (SELECT s_suppkey, s_acctbal, s_nationkey::DOUBLE AS s_nationkey FROM supplier) UNPIVOT (value FOR variable IN (s_acctbal, s_nationkey))")
def melt(t: Tables):
    return relational.melt(t.supplier.select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("s_nationkey")), ["s_suppkey"])


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(t: Tables):
    return frame.distinct_rows(t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber"))


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def distinct_keep_first(t: Tables):
    return frame.distinct_rows(t.events.select("event_id", "user_id", "event_type"), "event_id", ["user_id", "event_type"])


@query("SELECT DISTINCT CASE WHEN user_id % 5 = 0 THEN NULL ELSE event_type END AS event_type FROM events")
def distinct_column(t: Tables):
    return frame.unique_values(t.events.withColumn("event_type", F.when(F.col("user_id") % 5 != 0, F.col("event_type"))), "event_type")


# ---- windows --------------------------------------------------------------------------


@query(f"SELECT event_id, v, round(avg(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS 4 PRECEDING), 6) AS v_rolling_mean_5 FROM ({GAPS})")
def rolling_mean(t: Tables):
    rows = windows.rolling_mean(gaps(t).select("event_id", "user_id", "v"), "v", 5, "event_id", ["user_id"])
    return rows.select("event_id", "v", F.round("v_rolling_mean_5", 6).alias("v_rolling_mean_5"))


@query(f"SELECT event_id, round(CASE WHEN count(v) OVER w = 1 THEN 0.0 ELSE stddev_samp(v) OVER w END, 6) AS v_rolling_std_5 FROM ({GAPS}) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 4 PRECEDING)")
def rolling_std(t: Tables):
    rows = windows.rolling_std(gaps(t), "v", 5, "event_id", ["user_id"])
    return rows.select("event_id", F.round("v_rolling_std_5", 6).alias("v_rolling_std_5"))


@query(f"SELECT event_id, round(avg(v) OVER w, 10) AS v_expanding_mean, round(CASE WHEN count(v) OVER w = 1 THEN 0.0 ELSE stddev_samp(v) OVER w END, 10) AS v_expanding_std FROM ({GAPS}) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def expanding(t: Tables):
    rows = windows.expanding(gaps(t), "v", "event_id", ["user_id"], min_periods=0)
    return rows.select("event_id", *[F.round(f"v_expanding_{k}", 10).alias(f"v_expanding_{k}") for k in ("mean", "std")])


@query(f"""WITH g AS (SELECT *, list(v) FILTER (v IS NOT NULL) OVER (PARTITION BY user_id ORDER BY event_id) AS l FROM ({GAPS}))
 SELECT event_id, v, CASE WHEN v IS NOT NULL THEN round(list_reduce(l, lambda a, x: 0.3::DOUBLE * x + 0.7::DOUBLE * a), 6) END AS ewma FROM g""")
def ewma(t: Tables):
    rows = windows.ewma(gaps(t).select("event_id", "user_id", "v"), "v", 0.3, "event_id", ["user_id"])
    return rows.select("event_id", "v", F.round(F.col("`v_ewma_0.30`"), 6).alias("ewma"))


@query("SELECT event_id, value, lag(value, 1) OVER w AS lag_1, lag(value, 3) OVER w AS lag_3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id) QUALIFY row_number() OVER w > 3")
def lag_features(t: Tables):
    return windows.lag_features(t.events.select("event_id", "user_id", "value"), "value", [1, 3], "event_id", ["user_id"]).drop("user_id")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING), 6) AS moving_average FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) >= 3")
def moving_average_full(t: Tables):
    rows = windows.full_moving_average(t.events.select("event_id", "user_id", "value"), "value", 3, "event_id", ["user_id"])
    return rows.select("event_id", F.round("moving_average", 6).alias("moving_average"))


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS rank FROM part")
def rank_average(t: Tables):
    return windows.average_rank(t.part.select("p_partkey", "p_brand", "p_size"), "p_size", "rank", ["p_brand"]).select("p_partkey", "rank")


# ---- order, limits, samples -------------------------------------------------------------


@query(f"SELECT event_id, v FROM ({GAPS}) ORDER BY v DESC NULLS LAST, event_id LIMIT 50")
def sort_top(t: Tables):
    return gaps(t).select("event_id", "v").orderBy(F.desc_nulls_last("v"), "event_id").limit(50)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5")
def head(t: Tables):
    return frame.head(t.orders.select("o_orderkey", "o_totalprice"), 5, ["o_totalprice", "o_orderkey"])


@query("SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 7)")
def tail(t: Tables):
    return frame.tail(t.orders.select("o_orderkey", "o_totalprice"), 7, ["o_totalprice", "o_orderkey"])


@query()
def sample_n(t: Tables):
    return frame.sample_n(t.orders.select("o_orderkey"), 100, "o_orderkey", seed=7)


@query("SELECT (count(*) // 4)::BIGINT AS test, (count(*) - count(*) // 4)::BIGINT AS train, count(*) AS both FROM orders")
def split_sizes(t: Tables):
    train, test = frame.train_test_split(t.orders.select("o_orderkey"), "o_orderkey", 0.25, 3)
    rows = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return rows.agg(F.count_if(F.col("part") == "test").alias("test"), F.count_if(F.col("part") == "train").alias("train"), F.countDistinct("o_orderkey").alias("both"))


# ---- command language ---------------------------------------------------------------------

COMMANDS = {
    "command_filter_select": ("filter o_totalprice >= 250000 | select o_orderkey, o_totalprice", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 250000"),
    "command_filter_text": ("filter o_orderstatus = 'P' | select o_orderkey | rename o_orderkey to id", "orders", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P'"),
    "command_groupby": ("groupby c_mktsegment max c_acctbal", "customer", "SELECT c_mktsegment, max(c_acctbal) AS c_acctbal_max FROM customer GROUP BY 1"),
    "command_nulls": ("select s_suppkey, s_acctbal | dropnulls s_acctbal | fillnulls s_acctbal 0 | filter s_acctbal isnotnull", "supplier", "SELECT s_suppkey, s_acctbal FROM supplier"),
    "command_tail": ("select n_nationkey, n_name | tail 4", "nation", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 21"),
}
for _name, (_text, _table, _sql) in COMMANDS.items():
    query(_sql, _name)(lambda t, text=_text, a=_table: command.evaluate(getattr(t, a), text))
