"""Aggregations. events stand in for feedback (user_id: project, event_type: action) and for model calls (event_type: tier)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import aggregates as A
from quillstone.registry import query, table

_ACTION = {"purchase": "accepted", "error": "dismissed", "signup": "modified"}
_ACTION_SQL = "CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'dismissed' WHEN 'signup' THEN 'modified' ELSE event_type END"
_TIER = {"click": "cheap", "view": "base", "purchase": "frontier", "signup": "embedding"}
_TIER_SQL = "CASE event_type WHEN 'click' THEN 'cheap' WHEN 'view' THEN 'base' WHEN 'purchase' THEN 'frontier' WHEN 'signup' THEN 'embedding' ELSE event_type END"


def _map(names: dict[str, str]):  # noqa: ANN202
    out = F.col("event_type")
    for a, b in names.items():
        out = F.when(F.col("event_type") == a, b).otherwise(out)
    return out


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), _map(_ACTION).alias("action"), F.col("props").alias("finding_id"), "event_id")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), _map(_TIER).alias("tier"), F.floor("value").alias("tokens"), "ts", "event_id")


@query(f"SELECT {_ACTION_SQL} AS action, count(*) AS n FROM events WHERE user_id = 7 GROUP BY 1")
def f1_action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.action_counts(feedback(spark, sf_dir), 7)


@query("""SELECT count(*) AS total, count(*) FILTER (event_type = 'purchase') AS accepted, count(*) FILTER (event_type = 'error') AS dismissed,
  count(*) FILTER (event_type = 'signup') AS modified, CASE WHEN count(*) > 0 THEN count(*) FILTER (event_type = 'error') / count(*)::DOUBLE ELSE 0.0 END AS dismissal_rate
FROM events WHERE user_id = 7""")
def f2_feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.feedback_stats(feedback(spark, sf_dir), 7)


@query("""SELECT 0::BIGINT AS total, 0::BIGINT AS accepted, 0::BIGINT AS dismissed, 0::BIGINT AS modified, 0.0::DOUBLE AS dismissal_rate""")
def f2_feedback_stats_of_unknown_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.feedback_stats(feedback(spark, sf_dir), -1)


@query("SELECT props AS pattern, count(*) AS count FROM events WHERE user_id = 7 AND event_type = 'error' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def f3_top_dismissed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_dismissed(feedback(spark, sf_dir), 7)


_PER_TIER = ", ".join(f"count(*) FILTER (tier = '{t}') AS calls_{t}, coalesce(sum(tokens) FILTER (tier = '{t}'), 0)::BIGINT AS tokens_{t}" for t in A.PRICES)
_COST = "CASE tier " + " ".join(f"WHEN '{t}' THEN tokens / 1e6 * {p}" for t, p in A.PRICES.items()) + " ELSE 0.0 END"


@query(f"""WITH c AS (SELECT user_id AS run_id, {_TIER_SQL} AS tier, floor(value)::BIGINT AS tokens FROM events)
SELECT run_id, count(*) AS calls, sum(tokens)::BIGINT AS tokens, sum({_COST}) AS cost, {_PER_TIER} FROM c GROUP BY run_id""")
def f4_cost_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cost_accounting(calls(spark, sf_dir))


@query("""SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS agreed, count(*) FILTER (NOT (quality = 1 AND toxic = 0)) AS contested, count(*) FILTER (toxic = 1) AS escalated FROM labels""")
def f5_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return A.status_counts(labels.select(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "agreed").otherwise("disputed").alias("status"), (F.col("toxic") == 1).alias("escalate")))


@query("SELECT count(*) FILTER (toxic = 1) AS escalated FROM labels")
def f6_escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.escalations(table(spark, sf_dir, "labels").select((F.col("toxic") == 1).alias("escalate")))


@query("""SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, round(avg(l_quantity), 4) AS mean, round(coalesce(stddev_samp(l_quantity), 0), 4) AS stddev, round(min(l_quantity), 4) AS min, round(max(l_quantity), 4) AS max
FROM lineitem GROUP BY 1, 2""")
def f10_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.group_stats(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


@query("""WITH d AS (SELECT coalesce(avg(l_quantity) FILTER (l_returnflag = 'A'), 0) AS first_mean, coalesce(avg(l_quantity) FILTER (l_returnflag = 'R'), 0) AS second_mean FROM lineitem)
SELECT first_mean, second_mean, first_mean - second_mean AS delta, printf('%+.2f', first_mean - second_mean) AS shown FROM d""")
def f11_mean_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.mean_delta(table(spark, sf_dir, "lineitem"), "l_returnflag", "A", "R", "l_quantity")


@query("""WITH r AS (SELECT l_partkey AS query, max(l_partkey % 2 = 0) AS should_trigger, count(*) FILTER (l_returnflag = 'R') AS triggers, count(*) AS runs FROM lineitem GROUP BY 1)
SELECT *, triggers / runs::DOUBLE AS rate, CASE WHEN should_trigger THEN triggers / runs::DOUBLE >= 0.5 ELSE triggers / runs::DOUBLE < 0.5 END AS pass FROM r""")
def f12_trigger_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("query"), (F.col("l_partkey") % 2 == 0).alias("should_trigger"), (F.col("l_returnflag") == "R").alias("triggered"))
    return A.trigger_rates(runs)


@query("""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = 0 AND toxic = 0) AS tn FROM labels)
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 1.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 1.0 END AS recall,
  CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn)::DOUBLE ELSE 0.0 END AS accuracy FROM c""")
def f13_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.confusion(table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("bad")), "good", "bad")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def f14_best_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.best_row(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", ["o_custkey"])


@query("""SELECT o_orderstatus, sum(o_totalprice) AS total, count(o_totalprice)::DOUBLE AS n, avg(o_totalprice) AS mean, max(o_totalprice) AS most, min(o_totalprice) AS least, 0.0::DOUBLE AS none FROM orders GROUP BY 1""")
def f15_numeric_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(*[A.numeric_aggregate(p, m).alias(n) for m, n in (("sum", "total"), ("count", "n"), ("average", "mean"), ("max", "most"), ("min", "least"))], A.numeric_aggregate(F.col("o_orderpriority")).alias("none"))


@query("SELECT props AS ticker, count(*) AS mentions, min(event_id) AS first_seen FROM events WHERE event_type <> 'view' GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 10")
def f16_top_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type") != "view", F.col("props")).alias("ticker"), "event_id")
    return A.top_mentions(e, "ticker", "event_id")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def f17_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.counts(table(spark, sf_dir, "events"), "event_type")


@query("""SELECT coalesce(CASE WHEN lang <> 'de' THEN lang END, 'Unspecified') AS timepoint, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1""")
def f18_grouped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("lang") != "de", F.col("lang")).alias("timepoint"))
    g = A.grouped_lists(d, F.col("timepoint"), "timepoint", ["source"], "doc_id", "Unspecified")
    return g.select("timepoint", F.size("events").cast("long").alias("n"), F.get("events.doc_id", F.lit(0)).alias("first_id"), F.element_at("events.doc_id", -1).alias("last_id"))


@query("SELECT CASE WHEN toxic = 1 THEN 'critical' WHEN quality = 0 THEN 'warning' ELSE 'note' END AS severity, count(*) AS n FROM labels GROUP BY 1")
def f19_issues_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.when(F.col("toxic") == 1, "critical").when(F.col("quality") == 0, "warning").otherwise("note")
    return A.counts(table(spark, sf_dir, "labels").select(s.alias("severity")), "severity")


@query("""WITH n AS (SELECT s_nationkey, left(s_name, 10) || (s_suppkey % 3) AS pattern, count(*) AS n FROM supplier GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER p AS total, count(*) OVER p AS patterns, max(n) OVER p AS most, first_value(pattern) OVER (PARTITION BY s_nationkey ORDER BY n DESC, pattern) AS dominant FROM n WINDOW p AS (PARTITION BY s_nationkey))
SELECT s_nationkey, pattern, n, dominant FROM w WHERE total >= 3 AND patterns > 1 AND n <= 2 AND n < most""")
def f20_pattern_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_nationkey", F.concat(F.substring("s_name", 1, 10), (F.col("s_suppkey") % 3).cast("string")).alias("pattern"))
    return A.pattern_outliers(s, ["s_nationkey"], "pattern")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) AS n FROM lineitem) WHERE n = 1")
def f21_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("place", F.struct("l_partkey", "l_suppkey", "l_quantity"))
    return A.first_seen(rows, ["l_orderkey", "l_linenumber"], "place").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT l_suppkey, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] AS median_right FROM lineitem GROUP BY 1")
def f22_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.upper_medians(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "median_right")


@query("SELECT source, count(*) FILTER (regexp_matches(text, '[äöüß]')) > count(*) / 2.0 AS german FROM documents GROUP BY 1")
def f23_majority_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(A.majority(F.col("text").rlike("[äöüß]")).alias("german"))


_KEYWORDS = [("german", 0, "und"), ("german", 0, "der"), ("french", 1, "les"), ("french", 1, "des"), ("english", 2, "the"), ("english", 2, "and"), ("spanish", 3, "los"), ("spanish", 3, "que")]


@query(f"""WITH k(class, ord, keyword) AS (VALUES {', '.join(map(str, _KEYWORDS))}),
h AS (SELECT doc_id, class, ord, count(*) AS votes FROM documents JOIN k ON contains(lower(text), keyword) GROUP BY 1, 2, 3),
b AS (SELECT doc_id, class, votes, row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, ord) AS n FROM h)
SELECT d.doc_id, coalesce(class, 'unknown') AS class, coalesce(votes, 0) AS votes FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND n = 1""")
def f24_f30_keyword_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame(_KEYWORDS, "class string, ord int, keyword string")
    return A.keyword_votes(table(spark, sf_dir, "documents"), "doc_id", "text", words, "unknown")


@query("""WITH f AS (SELECT *, l_linestatus = 'F' AS e, l_linestatus <> 'F' AND l_discount = 0 AS z FROM lineitem)
SELECT l_returnflag AS sheet, count(*) AS formulas, count(*) FILTER (e) AS errors, count(*) FILTER (z) AS zeros, count(*) FILTER (l_linenumber = 2) AS arrays,
  list_sort(list(l_orderkey) FILTER (e))[1:50] AS error_cells, list_sort(list(l_orderkey) FILTER (z))[1:30] AS zero_cells, list_sort(list(l_orderkey) FILTER (l_linenumber = 2))[1:20] AS array_cells FROM f GROUP BY 1""")
def f25_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    formula = F.when(n == 2, "=match( true, A1:A9)").otherwise("=A1")
    cells = rows.select(F.col("l_returnflag").alias("sheet"), F.col("l_orderkey").alias("cell"), formula.alias("formula"), F.when(F.col("l_linestatus") == "F", "x #REF!").otherwise(F.col("l_discount").cast("string")).alias("value"))
    return A.audit(cells, ["sheet"])


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT (SELECT greatest(0, count(*) - 100) FROM orders)")
def f26_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.oldest(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 100, "o_orderkey")


@query("""WITH r AS (SELECT l_linenumber AS iteration, l_partkey % 2 = 0 AS should_trigger, count(*) FILTER (l_returnflag = 'R') AS triggers, count(*) AS runs FROM lineitem GROUP BY 1, 2),
g AS (SELECT iteration, sum(CASE WHEN should_trigger THEN triggers ELSE runs - triggers END)::BIGINT AS correct, sum(runs)::BIGINT AS total FROM r GROUP BY 1)
SELECT *, CASE WHEN correct / total::DOUBLE >= 0.8 THEN 'good' WHEN correct / total::DOUBLE >= 0.5 THEN 'ok' ELSE 'bad' END AS grade FROM g""")
def f27_graded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("iteration"), (F.col("l_partkey") % 2 == 0).alias("should_trigger")).agg(F.count_if(F.col("l_returnflag") == "R").alias("triggers"), F.count("*").alias("runs"))
    return A.graded_runs(rows)


@query("""WITH n AS (SELECT coalesce(CASE WHEN c_nationkey <> 3 THEN c_mktsegment END, 'default') AS value, count(*) AS n FROM customer GROUP BY 1)
SELECT max_by(value, {'n': n, 'value': value}) AS dominant, 1 - max(n) / sum(n)::DOUBLE AS others, 1 - max(n) / sum(n)::DOUBLE > 0.2 AS warn FROM n""")
def f28_mode_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.mode_share(table(spark, sf_dir, "customer").select(F.when(F.col("c_nationkey") != 3, F.col("c_mktsegment")).alias("spacing")), "spacing")


@query("SELECT count(*) FILTER (quality = 1) AS passed, count(*) FILTER (toxic = 1) AS errors, count(*) FILTER (quality = 0) AS warnings FROM labels")
def f29_outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").agg(F.count_if(F.col("quality") == 1).alias("passed"), F.count_if(F.col("toxic") == 1).alias("errors"), F.count_if(F.col("quality") == 0).alias("warnings"))


@query("""SELECT l_returnflag AS sheet, max(l_linenumber) AS rows, max(l_suppkey) AS cols, count(DISTINCT l_linenumber) FILTER (l_linenumber > 1 AND (l_discount > 0 OR l_tax > 0.04)) AS data_rows, count(*) FILTER (l_linenumber > 1 AND l_tax > 0.04) AS formulas,
  list_transform(list_sort(list({'c': l_suppkey, 'n': l_shipdate::DATE::VARCHAR}) FILTER (l_linenumber = 1 AND l_discount > 0)), lambda x: x.n) AS headers, (count(*) FILTER (l_quantity > 49)) AS charts FROM lineitem GROUP BY 1""")
def s11_sheet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    value = F.when(F.col("l_discount") > 0, F.col("l_shipdate").cast("date").cast("string"))
    cells = rows.select(F.col("l_returnflag").alias("sheet"), F.col("l_linenumber").alias("row"), F.col("l_suppkey").alias("col"), value.alias("value"), F.when(F.col("l_tax") > 0.04, "=A1").alias("formula"))
    return A.sheet_summary(cells, rows.where("l_quantity > 49").select(F.col("l_returnflag").alias("sheet")))
