"""Pivots, scores, alerts, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.text import deterministic_id
from quillstone.operators import pivots as P
from quillstone.operators import vectors as V
from quillstone.registry import query, table


@query("""SELECT coalesce(CASE WHEN c_nationkey <> 3 THEN c_mktsegment END, 'None') AS segment, round(sum(o_totalprice), 2) AS o_totalprice_sum, round(avg(o_totalprice), 2) AS o_totalprice_average, count(*)::DOUBLE AS o_orderkey_count
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def x2_flat_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_nationkey") != 3, F.col("c_mktsegment")).alias("segment"))
    return P.flat_pivot(table(spark, sf_dir, "orders").join(c, "o_custkey"), ["segment"], [("o_totalprice", "sum"), ("o_totalprice", "average"), ("o_orderkey", "count")])


@query("""SELECT c_mktsegment, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0), 2) AS F, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0), 2) AS O, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 0), 2) AS P
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def x3_t9_cross_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return P.cross_tab(table(spark, sf_dir, "orders").join(c, "o_custkey"), ["c_mktsegment"], "o_orderstatus", "o_totalprice")


@query("SELECT p_partkey, CASE WHEN p_size * 2 < 40 THEN 'safe' WHEN p_size * 2 < 60 THEN 'moderate' WHEN p_size * 2 < 80 THEN 'high' ELSE 'unsustainable' END AS status, CASE WHEN p_size > 25 THEN round(p_size / (p_size - 25) * 100.0, 1) END AS ratio FROM (SELECT p_partkey, p_size::DOUBLE AS p_size FROM part)")
def x4_x10_payout(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", P.payout_status(s * 2).alias("status"), P.payout_ratio(s, s - 25).alias("ratio"))


@query("""WITH s AS (SELECT c_custkey, c_nationkey * 4 AS payout, c_acctbal / 500 AS growth, c_nationkey AS years, c_custkey % 12 AS y FROM customer),
t AS (SELECT *, greatest(0, least(100, 50 + CASE WHEN payout < 40 THEN 20 WHEN payout < 60 THEN 10 WHEN payout < 80 THEN -10 ELSE -20 END + CASE WHEN growth > 10 THEN 15 WHEN growth > 5 THEN 10 WHEN growth > 0 THEN 5 ELSE -15 END
  + CASE WHEN years >= 25 THEN 15 WHEN years >= 10 THEN 10 WHEN years >= 5 THEN 5 ELSE 0 END + CASE WHEN y > 8 THEN -10 ELSE 0 END)) AS score FROM s)
SELECT c_custkey, score::INT AS score, CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'moderate' ELSE 'poor' END AS rating,
  2 + (years >= 5)::INT + (y > 8 OR y < 1)::INT AS n_factors FROM t""")
def x5_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.safety(F.col("c_nationkey") * 4, F.col("c_acctbal") / 500, F.col("c_nationkey"), F.col("c_custkey") % 12)
    return table(spark, sf_dir, "customer").select("c_custkey", s["score"].cast("int").alias("score"), s["rating"].alias("rating"), F.size(s["factors"]).alias("n_factors"))


@query("""SELECT event_id, least(10, 1 + CASE event_type WHEN 'purchase' THEN 5 WHEN 'signup' THEN 2 ELSE 1 END + CASE WHEN event_type = 'error' THEN 2 ELSE 0 END + CASE WHEN value > 400 THEN 2 ELSE 0 END)::INT AS impact FROM events""")
def x6_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "ma").when(F.col("event_type") == "signup", "earnings")
    text = F.when(F.col("event_type") == "error", "Urgent: x").otherwise("calm")
    return table(spark, sf_dir, "events").select("event_id", P.impact_score(kind, text, F.col("value") > 400).cast("int").alias("impact"))


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "orders")
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return w.select(
        k.alias("ticker"), p.alias("price_at_add"), F.when(k % 4 != 0, p * 1.1).alias("target_price"), (p * 0.9).alias("stop_price"), F.lit(True).alias("alert_on_signal"), F.when(k % 5 != 0, F.lit("hold")).alias("last_signal"),
        (p * (1 + (k % 5 - 2) / 10)).alias("current_price"), F.when(k % 3 == 0, "buy").otherwise("hold").alias("current_signal"),
    )


_WATCH = """w AS (SELECT o_orderkey AS ticker, o_totalprice AS p, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice * 1.1::DOUBLE END AS target, o_totalprice * 0.9::DOUBLE AS stop, CASE WHEN o_orderkey % 5 <> 0 THEN 'hold' END AS last,
  o_totalprice * (1 + (o_orderkey % 5 - 2) / 10.0::DOUBLE) AS c, CASE WHEN o_orderkey % 3 = 0 THEN 'buy' ELSE 'hold' END AS signal FROM orders)"""


@query(f"""WITH {_WATCH} SELECT ticker, c AS current_price, 'target_hit' AS alert FROM w WHERE c >= target UNION ALL SELECT ticker, c, 'stop_hit' FROM w WHERE c <= stop UNION ALL SELECT ticker, c, 'signal_change' FROM w WHERE signal <> last""")
def x7_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.alerts(watchlist(spark, sf_dir))


@query(f"WITH {_WATCH} SELECT ticker, round((c - p) / p * 100, 2) AS change_pct, round((target - c) / c * 100, 2) AS to_target_pct, round((stop - c) / c * 100, 2) AS to_stop_pct FROM w")
def x8_watch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.watch_metrics(watchlist(spark, sf_dir))


@query("""SELECT coalesce(c_custkey, k) AS k, coalesce(seg, c_mktsegment) AS seg, coalesce(bal, c_acctbal) AS bal FROM customer FULL JOIN (SELECT o_custkey + 100000 * (max(o_orderkey) % 2) AS k, CASE WHEN max(o_orderkey) % 3 = 0 THEN 'new' END AS seg, max(o_totalprice) AS bal FROM orders GROUP BY o_custkey) n ON k = c_custkey""")
def x9_partial_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("m"), F.max("o_totalprice").alias("bal"))
    return P.partial_upsert(old, o.select((F.col("o_custkey") + 100000 * (F.col("m") % 2)).alias("k"), F.when(F.col("m") % 3 == 0, "new").alias("seg"), "bal"), "k")


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def x9_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.remove(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k", table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")))


@query("""SELECT s_suppkey, s_acctbal <> 0 AS valid, list_filter([CASE WHEN s_acctbal = 0 THEN 'price missing' END, CASE WHEN s_nationkey % 2 = 0 THEN 'moving averages missing' END, CASE WHEN s_nationkey > 20 THEN 'overbought' END], lambda x: x IS NOT NULL) AS warnings FROM supplier""")
def p13_validate_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("price"), (F.col("s_nationkey") % 2).cast("double").alias("ma5"), F.lit(None).cast("double").alias("ma20"), (F.col("s_nationkey") > 20).alias("overbought_warning"), F.lit(1.0).alias("roe"), F.lit(1.0).alias("pe_ttm"), F.lit("").alias("error"))
    return P.validate_prices(s).select("s_suppkey", "valid", "warnings")


@query("SELECT count(*) FILTER (event_type IN ('purchase', 'signup')) AS buy, count(*) FILTER (event_type = 'view') AS watch, count(*) FILTER (event_type = 'error') AS sell FROM events")
def p14_verdict_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    return P.verdict_buckets(table(spark, sf_dir, "events").select(F.when(t == "purchase", "强烈买入").when(t == "signup", "买入").when(t == "view", "观望").when(t == "error", "卖出").alias("verdict")))


@query("""WITH h AS (SELECT p_partkey, sha1('6ba7b810-9dad-11d1-80b4-00c04fd430c8' || p_brand || '::' || p_name) AS h FROM part)
SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(printf('%02x', (CAST('0x' || substr(h, 17, 2) AS INT) & 63) | 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS id FROM h""")
def v2_deterministic_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", deterministic_id(F.concat("p_brand", F.lit("::"), "p_name"), V.NAMESPACE).alias("id"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS score FROM embeddings, q WHERE label < 8),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s)
SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10""")
def v6_t4_p8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return V.top_k(e, q, 10, "vec_id", "embedding", F.col("label") < 8).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("SELECT vec_id, label FROM embeddings WHERE len(embedding) = 64")
def v1_valid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.valid_points(table(spark, sf_dir, "embeddings"), 64, "embedding").select("vec_id", "label")


@query("SELECT k AS id, max(v) AS v FROM (SELECT c_custkey AS k, 0 AS v FROM customer UNION ALL SELECT o_custkey, max(o_orderkey) FROM orders GROUP BY 1) GROUP BY 1")
def v5_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("v"))
    return V.upsert(old, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("v"), F.col("o_orderkey").alias("ord")))


@query("SELECT vec_id, label FROM embeddings WHERE label <> 3")
def v8_delete_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.struct(F.col("label").cast("string").alias("file")).alias("payload"))
    return V.delete_by_file(e, "3").drop("payload")


@query()
def v7_search_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return V.top_k_of_text(V.embed(docs, V.hashed_embedding), "the and of").select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("SELECT count(*) AS n, count(DISTINCT p_brand || '::' || p_name) AS ids FROM part WHERE p_partkey % 10 > 1")
def p1_v3_v4_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.plans.graphs import symbols

    points = V.embed(V.assemble(symbols(spark, sf_dir)), V.hashed_embedding)
    return V.valid_points(points, 64).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))
