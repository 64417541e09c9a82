"""Queries over source-like texts, events as payloads, and file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.text import language
from quillstone.operators import code_index as C
from quillstone.operators import findings as N
from quillstone.registry import query, table
from quillstone.sources import files as S
from quillstone.streaming import streams


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'go' END AS language FROM events")
def s2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(F.lit("PY"), F.lit("ts"), F.lit("go"), F.lit("md")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", language(F.concat(F.lit("src/a.b."), ext)).alias("language"))


@query("SELECT p_brand AS file, 'f' || p_partkey AS name, 'function' AS kind, ['helper', 'pkg.call'] AS calls_to FROM (SELECT p_partkey, p_brand || p_partkey || '.py' AS p_brand FROM part)")
def a1_a2_a3_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("def f"), k, F.lit("(x):\n    helper(x)\n    return pkg.call(helper(1))\n"))
    files = table(spark, sf_dir, "part").select(F.concat("p_brand", k, F.lit(".py")).alias("path"), text.alias("text"))
    return C.index(files).select("file", "name", "kind", "calls_to")


@query("SELECT user_id AS project_id, event_id::INT AS mr_iid, CASE event_type WHEN 'view' THEN 'open' ELSE 'update' END AS action, 'b' AS source_branch FROM events WHERE event_type IN ('view', 'click')")
def p6_w1_review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    action = F.when(t == "view", "open").when(t == "click", "update").otherwise("close")
    payload = F.to_json(F.struct(F.lit("merge_request").alias("object_kind"), F.struct(F.col("user_id").alias("id")).alias("project"), F.struct(F.col("event_id").alias("iid"), action.alias("action"), F.lit("b").alias("source_branch")).alias("object_attributes")))
    return streams.review_events(table(spark, sf_dir, "events").select(payload.alias("value")))


@query("SELECT doc_id, text FROM documents")
def s6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.decoded(F.base64(F.col("text").cast("binary"))).alias("text"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || '-x.md' AS name, o_orderdate::DATE AS date FROM orders WHERE o_orderkey % 2 = 0")
def s14_dated_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-x.md"))).otherwise(F.lit("2024-99-99 draft"))
    return S.dated_examples(table(spark, sf_dir, "orders").select("o_orderkey", n.alias("name"))).select("o_orderkey", "name", "date")


@query("SELECT 'eval/eval-' || user_id || '/run-' || event_id % 3 AS run, user_id AS eval_id FROM events GROUP BY ALL")
def s17_find_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.concat(F.lit("eval/eval-"), F.col("user_id").cast("string"), F.lit("/run-"), (F.col("event_id") % 3).cast("string"), F.lit("/outputs/"), F.col("event_id").cast("string"))
    return S.find_runs(table(spark, sf_dir, "events").select(p.alias("path")))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE 'fine' END AS file, CASE WHEN event_type = 'error' THEN 0 ELSE 7 END AS line, CASE WHEN event_type = 'view' THEN 'critical' ELSE 'note' END AS severity, 's' AS summary FROM events")
def c13_k8_parse_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    raw = F.when(t == "error", '{"inline": [{"severity": "odd"}], "summary": "s"}').when(t == "view", '{"inline": [{"file": "fine", "line": 7, "severity": "critical", "body": "b"}], "summary": "s"}').otherwise('{"inline": [{"file": "fine", "line": 7}], "summary": "s"}')
    r = N.parse_report(table(spark, sf_dir, "events").select("event_id", raw.alias("raw")))
    return r.select("event_id", F.explode("inline").alias("i"), "summary").select("event_id", "i.file", "i.line", "i.severity", "summary")


@query("SELECT '| ' || n_nationkey || ' | ' || n_name || ' |' AS line FROM nation")
def o8_markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.markdown_table(table(spark, sf_dir, "nation"), ["n_nationkey", "n_name"])


@query("SELECT '**' || n_name || ':' || n_nationkey || '**' || chr(10) || chr(10) || 'b' AS note FROM nation")
def o1_inline_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(N.inline_note(F.col("n_name"), F.col("n_nationkey"), F.lit("b")).alias("note"))
