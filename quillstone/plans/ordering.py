"""Queries on ordered rows, top-k, and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import aggregates as A
from quillstone.operators import joins as J
from quillstone.operators import windows as W
from quillstone.plans.aggregation import _COST, _TIER_SQL, calls
from quillstone.registry import query, table


@query("""SELECT * FROM (SELECT user_id, event_id, event_type, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS section FROM events) WHERE section > 0""")
def wa_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return W.sections(e, ["user_id"], "at", F.col("event_type") == "signup").select("user_id", "event_id", "event_type", "section")


@query("SELECT user_id, event_type, max_by(value, event_id) AS value, min(event_id) AS place FROM events GROUP BY 1, 2")
def wb_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.last_wins(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id", "value")


@query("""SELECT user_id, event_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), -1) AS "end" FROM events""")
def wc_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.spans(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", F.lit(-1))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")
def wd_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.first_seen(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey", "o_orderstatus"], "o_orderkey")


@query(f"""WITH c AS (SELECT user_id AS run_id, event_id, ts, {_TIER_SQL} AS tier, floor(value)::BIGINT AS tokens FROM events),
w AS (SELECT run_id, event_id, row_number() OVER o - 1 AS prior_calls, coalesce(sum({_COST}) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior_cost FROM c WINDOW o AS (PARTITION BY run_id ORDER BY ts, event_id))
SELECT run_id, event_id, prior_calls, round(prior_cost, 9) AS prior_cost, prior_calls < 25 AND prior_cost < 0.02 AS admitted FROM w""")
def we_budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = W.budget_gate(calls(spark, sf_dir), "run_id", ["ts", "event_id"], 25, 0.02)
    return g.select("run_id", "event_id", F.col("prior_calls").cast("long").alias("prior_calls"), F.round("prior_cost", 9).alias("prior_cost"), "admitted")


@query("""WITH RECURSIVE a AS (SELECT user_id, min(value) AS v FROM events GROUP BY 1
UNION ALL SELECT a.user_id, min(e.value) FROM a JOIN events e ON e.user_id = a.user_id AND e.value - a.v > 10 GROUP BY 1)
SELECT e.user_id, event_id, value, count(*)::INT AS cluster FROM events e JOIN a ON a.user_id = e.user_id AND a.v <= e.value GROUP BY 1, 2, 3""")
def wf_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.clusters(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "value", 10.0)


@query("SELECT * FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE previous <> event_type")
def wg_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.changes(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type", "previous")


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) || '/' || count(*) OVER (PARTITION BY l_orderkey) AS label FROM lineitem")
def wh_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.labels(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]).select("l_orderkey", "l_linenumber", "l_partkey", "label")


@query("SELECT user_id, event_id, level, previous FROM (SELECT user_id, event_id, length(event_type) AS level, lag(length(event_type)) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) WHERE level - previous > 1")
def wi_level_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.length("event_type").alias("level"))
    return W.level_skips(e, ["user_id"], "event_id", "level")


@query("""WITH w AS (SELECT s_nationkey, s_suppkey, CASE WHEN row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) = 1 THEN 1.618 ELSE abs(s_acctbal) / 1000 END::DOUBLE AS weight FROM supplier),
h AS (SELECT s_nationkey, s_suppkey, 100 * weight / sum(weight) OVER (PARTITION BY s_nationkey) AS height FROM w)
SELECT s_nationkey, s_suppkey, round(height, 6) AS height, round(coalesce(sum(height) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS start FROM h""")
def wj_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", (F.abs("s_acctbal") / 1000).alias("weight"))
    return W.bands(s, ["s_nationkey"], "s_suppkey", "weight", 100.0).select("s_nationkey", "s_suppkey", F.round("height", 6).alias("height"), F.round("start", 6).alias("start"))


@query("""WITH w AS (SELECT s_nationkey, s_suppkey, abs(s_acctbal) AS weight, greatest(2, round_even(60 * abs(s_acctbal) / sum(abs(s_acctbal)) OVER (PARTITION BY s_nationkey), 0)::BIGINT) AS size FROM supplier),
t AS (SELECT s_nationkey, sum(size)::BIGINT AS total FROM w GROUP BY 1),
l AS (SELECT s_nationkey, level, sum(least(size, level))::BIGINT AS held FROM w, generate_series(2, 60) AS g(level) GROUP BY 1, 2),
k AS (SELECT s_nationkey, min({'level': level, 'lack': CASE WHEN level > 2 THEN held - 60 ELSE 0 END}) AS k FROM l WHERE held >= 60 GROUP BY 1),
n AS (SELECT w.*, total, k, row_number() OVER (PARTITION BY w.s_nationkey, size >= k.level ORDER BY s_suppkey) AS nth, row_number() OVER (PARTITION BY w.s_nationkey ORDER BY weight DESC, s_suppkey) AS heavy FROM w JOIN t USING (s_nationkey) LEFT JOIN k USING (s_nationkey)),
s AS (SELECT s_nationkey, s_suppkey, weight, CASE WHEN total > 60 THEN least(size, k.level) - (size >= k.level AND nth <= k.lack)::INT WHEN heavy = 1 THEN size + 60 - total ELSE size END::INT AS size FROM n)
SELECT *, coalesce(sum(size) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM s""")
def wk_allocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.abs("s_acctbal").alias("weight"))
    return W.allocations(s, ["s_nationkey"], "s_suppkey", "weight", 60)


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey")
def t2_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").orderBy("p_name", "p_partkey").select("p_partkey", "p_name")


@query("SELECT event_type, event_id, value, n::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 3")
def t6_top_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.first_per_group(table(spark, sf_dir, "events"), ["event_type"], [F.desc("value"), F.col("event_id")], 3).select("event_type", "event_id", "value", "rank")


@query("SELECT user_id, event_id, value, n::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'error') WHERE n <= 5")
def p4_to_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return W.first_per_group(e, ["user_id"], ["event_id"], 5).select("user_id", "event_id", "value", "rank")


@query("SELECT l_orderkey, list_sort(list({'n': l_linenumber, 'p': l_partkey, 'q': l_quantity}))[1].p AS first_part FROM lineitem GROUP BY 1")
def t7_reordered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_quantity").alias("q"))))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.get(rows, F.lit(0))["p"].alias("first_part"))


@query("SELECT doc_id, left(text, 500) AS excerpt FROM documents")
def t10_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 500).alias("excerpt"))


@query("SELECT l_suppkey % 10 AS page, l_extendedprice AS y, l_quantity AS x, l_orderkey FROM lineitem ORDER BY 1, 2 DESC, 3")
def t13_in_page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return J.in_page_order(rows.select((F.col("l_suppkey") % 10).alias("page"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"), "l_orderkey"))


@query("SELECT DISTINCT k FROM (SELECT l_partkey AS k FROM lineitem UNION ALL SELECT p_partkey FROM part)")
def u1_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.deduplicated(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), key=["k"])


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def u3_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")))


@query("""SELECT c_custkey, list_concat(CASE WHEN c_acctbal < 0 THEN ['overdrawn'] ELSE []::VARCHAR[] END, [c_mktsegment]) AS notes FROM customer""")
def u5_joined_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, F.array(F.lit("overdrawn"))).alias("a"), F.array("c_mktsegment").alias("b"))
    return J.joined_notes(c, ["a", "b"]).select("c_custkey", "notes")


@query("SELECT event_id, value FROM events WHERE TRY_CAST(CASE WHEN event_type = 'view' THEN event_type ELSE value::VARCHAR END AS DOUBLE) IS NOT NULL")
def p12_numeric_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.when(F.col("event_type") == "view", F.col("event_type")).otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").where(cell.try_cast("double").isNotNull()).select("event_id", "value")


@query("SELECT props AS pattern, count(*) AS count FROM events GROUP BY 1 HAVING count(*) >= 3")
def p5_frequent_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("props").alias("pattern")).agg(F.count("*").alias("count")).where("count >= 3")
