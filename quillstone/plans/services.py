"""Queries through paged services, the keyed table and the answer store."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.answers import AnswerStore
from quillstone.lineage import cut, new_folder
from quillstone.prefix import numbered
from quillstone.registry import query, table
from quillstone.sources import reviews
from quillstone.sources.keyed import KeyedTable
from quillstone.streaming import signals

PAGE = 200


@query("""SELECT CAST(regexp_extract(source, '[0-9]+') AS INTEGER) AS mr_iid, 'head' || regexp_extract(source, '[0-9]+') AS head_sha, CAST(doc_id AS VARCHAR) AS new_path, sha256(text) AS diff_sha256, n_chars > 500 AS new_file FROM documents""")
def s4_s5_paged_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the changes of a review for each source, landed as pages of PAGE changes and read back through the paged source."""
    d = table(spark, sf_dir, "documents").withColumn("iid", F.regexp_extract("source", "[0-9]+", 0).cast("int"))
    placed = cut(numbered(d, ["iid"], ["doc_id"]).withColumn("page", F.floor(F.col("pos") / PAGE) + 1))
    last = placed.groupBy("iid").agg(F.max("page").alias("last"))
    change = F.struct(F.col("doc_id").cast("string").alias("new_path"), F.col("text").alias("diff"), (F.col("n_chars") > 500).alias("new_file"))
    pages = placed.groupBy("iid", "page").agg(F.collect_list(change).alias("changes")).join(last, "iid")  # PAGE changes a page
    refs = F.struct(F.concat(F.lit("head"), F.col("iid").cast("string")).alias("head_sha"))
    value = F.to_json(F.struct(refs.alias("diff_refs"), "changes", F.when(F.col("page") < F.col("last"), F.col("page") + 1).alias("next_page")))
    endpoint = F.concat(F.lit("/projects/p/merge_requests/"), F.col("iid").cast("string"), F.lit("/changes"), F.when(F.col("page") > 1, F.concat(F.lit("?page="), F.col("page").cast("string"))).otherwise(""))
    folder = new_folder(spark, "pages")
    reviews.land(pages.select(endpoint.alias("endpoint"), value.alias("value")), folder)
    keys = [r["iid"] for r in placed.select("iid").distinct().collect()]  # the reviews to ask for, as a caller would name them
    reviews.register(spark)
    changes = spark.read.format("review_changes").options(keys=json.dumps(keys), base=folder, project="p", transport="quillstone.sources.reviews:landed").load()
    return changes.select("mr_iid", "head_sha", "new_path", F.sha2(F.col("diff").cast("binary"), 256).alias("diff_sha256"), "new_file")


@query("""SELECT o_custkey AS id, o_orderkey AS last_order, o_orderstatus AS status FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def w4_keyed_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of each customer, upserted in three batches by status, of which the first comes again at the end."""
    o = table(spark, sf_dir, "orders")
    order = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lpad(F.col("o_orderkey").cast("string"), 20, "0"))
    rows = o.select(F.col("o_custkey").cast("long").alias("id"), order.alias("ord"), F.col("o_orderkey").cast("long").alias("last_order"), F.col("o_orderstatus").alias("status"))
    t = KeyedTable(spark, new_folder(spark, "keyed"), "id long, ord string, last_order long, status string")
    for status in ("F", "O", "P", "F"):
        t.put(rows.where(F.col("status") == status))
    return t.read().select("id", "last_order", "status")


@query("SELECT doc_id, 'base ' || lang || ' ' || CAST(length(text) AS VARCHAR) AS answer FROM documents")
def l1_stored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each document from the store, whose first run has been asked for one language alone."""

    def model(tier: str, system: str, prompt: str) -> str:
        lang, _, text = prompt.partition("\n")
        return f"{tier} {lang} {len(text)}"

    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat("lang", F.lit("\n"), "text").alias("prompt"))
    store = AnswerStore(spark, new_folder(spark, "answers"))
    store.ask(d.where(F.col("lang") == "en"), model, "base", "Language and length.")
    return store.ask(d, model, "base", "Language and length.").select("doc_id", "answer")


@query("""WITH s AS (SELECT user_id::VARCHAR AS ticker, ts, min(event_type) AS signal FROM events WHERE ts <= (SELECT time_bucket(INTERVAL 1 MILLISECOND, max(ts)) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2),
w AS (SELECT *, lag(signal) OVER o AS previous, lag(ts) OVER o AS before, lead(ts) OVER o AS next FROM s WINDOW o AS (PARTITION BY ticker ORDER BY ts))
SELECT ticker, ts, previous, signal, 'signal_change' AS kind FROM w WHERE previous <> signal AND ts - before < INTERVAL 1 DAY
UNION ALL SELECT ticker, ts + INTERVAL 1 DAY, signal, NULL, 'expired' FROM w WHERE coalesce(next, (SELECT time_bucket(INTERVAL 1 MILLISECOND, max(ts)) - INTERVAL 1 DAY FROM events)) - ts >= INTERVAL 1 DAY""")
def w3_signal_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of signals by user, late by up to a day: changes, and users silent for a day; what the watermark has passed."""
    for k, v in signals.STORE.items():
        spark.conf.set(k, v)
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").select(F.col("user_id").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("signal"))
    out, place = new_folder(spark, "alerts"), new_folder(spark, "alerts-checkpoint")
    run = signals.signal_alerts(stream, "1 day").writeStream.format("parquet").option("path", out).option("checkpointLocation", place)
    run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
