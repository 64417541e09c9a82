"""Join-shaped queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import findings as N
from quillstone.operators import joins as J
from quillstone.operators import stories as S
from quillstone.registry import query, table


@query("SELECT d.doc_id AS id, CASE WHEN quality IS NULL THEN NULL WHEN quality = 0 THEN 'rejected' ELSE 'confirmed' END AS verdict FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def j7_with_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("finding_id"), F.when(F.col("quality") == 0, "rejected").otherwise("sure").alias("verdict"), F.lit("").alias("reasoning"))
    return N.with_verdicts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), v).select("id", "verdict")


_PATTERNS = [("the rain ending there", 9), ("letztes wort lich keit", 5), ("tion thon than thing", 4), ("rare only twice", 2)]


def _gate_input(spark: SparkSession, sf_dir: str, issue: Column) -> tuple[DataFrame, DataFrame]:
    f = table(spark, sf_dir, "documents").select("doc_id", issue.alias("issue"), (F.col("doc_id") % 10 / 10).alias("confidence"), (F.col("doc_id") % 2 == 0).alias("escalate"), F.lit("r").alias("reason"))
    return f, spark.createDataFrame(_PATTERNS, "pattern string, count long")


@query(f"""WITH p(pattern, count) AS (VALUES {', '.join(map(str, _PATTERNS))}),
q AS (SELECT pattern, count, list_filter(string_split(pattern, ' '), lambda w: length(w) > 3) AS words, row_number() OVER (ORDER BY count DESC, pattern) AS rank FROM p WHERE count >= 3),
f AS (SELECT doc_id, text AS issue, doc_id % 10 / 10.0 AS confidence, doc_id % 2 = 0 AS escalate FROM documents),
h AS (SELECT doc_id, pattern, count, rank, len(list_filter(words, lambda w: contains(lower(issue), w))) AS n, len(words) AS m FROM f, q),
b AS (SELECT doc_id, min_by(pattern, rank) AS matched, min_by(count, rank) AS count FROM h WHERE n >= 2 AND n / m::DOUBLE >= 0.5 GROUP BY 1)
SELECT f.doc_id, b.matched, (CASE WHEN matched IS NULL THEN confidence ELSE least(confidence, 0.4) END)::DOUBLE AS confidence, escalate AND matched IS NULL AS escalate,
  CASE WHEN matched IS NULL THEN 'r' ELSE 'r [FEEDBACK: similar pattern dismissed ' || count || 'x]' END AS reason FROM f LEFT JOIN b ON b.doc_id = f.doc_id""")
def j8_k3_feedback_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.feedback_gate(*_gate_input(spark, sf_dir, F.col("text"))).select("doc_id", "matched", "confidence", "escalate", "reason")


@query("SELECT DISTINCT l_partkey % 3000 AS k FROM lineitem WHERE l_partkey % 3000 NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def j9_undefined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.undefined(table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 3000).alias("k")), table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("k")), "k")


@query(r"""WITH t(term) AS (VALUES ('The'), ('und'), ('of the'), ('les')) SELECT doc_id, term FROM documents, t WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{M}\p{N}_])' || term || '($|[^\p{L}\p{M}\p{N}_])')""")
def j10_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.mentions(table(spark, sf_dir, "documents"), spark.createDataFrame([("The",), ("und",), ("of the",), ("les",)], "term string"))


@query("""WITH s AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS id, l_quantity % 10 AS "left", l_discount * 100 AS top, 1 + l_linenumber % 3 AS width, 1 + l_tax * 20 AS height FROM lineitem)
SELECT a.l_orderkey, a.id AS a, b.id AS b, round((least(a."left" + a.width, b."left" + b.width) - greatest(a."left", b."left")) * (least(a.top + a.height, b.top + b.height) - greatest(a.top, b.top)), 2) AS area
FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.id < b.id
WHERE least(a."left" + a.width, b."left" + b.width) - greatest(a."left", b."left") > 0.05 AND least(a.top + a.height, b.top + b.height) - greatest(a.top, b.top) > 0.05""")
def j12_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.overlaps(_shapes(table(spark, sf_dir, "lineitem")), ["l_orderkey"])


def _shapes(lineitem: DataFrame) -> DataFrame:
    """Boxes of the lines of each order."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return lineitem.select(
        "l_orderkey", F.row_number().over(w).cast("long").alias("id"), (F.col("l_quantity") % 10).alias("left"), (F.col("l_discount") * 100).alias("top"), (1 + F.col("l_linenumber") % 3).cast("double").alias("width"), (1 + F.col("l_tax") * 20).alias("height")
    )


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j13_p9_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.members(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j13_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.members(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", False).select("c_custkey", "c_name")


@query("""SELECT vec_id, unnest(range(64))::INT AS pos, unnest(embedding) AS a, unnest(list_reverse(embedding)) AS b FROM embeddings""")
def j14_zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"), F.reverse("embedding").alias("y"))
    return J.zipped(e, "x", "y", ("a", "b"))


@query("SELECT s_suppkey, s_nationkey, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def j15_with_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return J.with_dimension(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), n, "s_nationkey")


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS run_id, coalesce(said, '') AS feedback, CASE WHEN d.doc_id IS NULL THEN []::VARCHAR[] ELSE [d.source] END AS outputs
FROM documents d FULL JOIN (SELECT doc_id, 'q' || quality AS said FROM labels WHERE toxic = 0) l ON l.doc_id = d.doc_id""")
def j16_runs_with_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_feedback(spark, sf_dir, table(spark, sf_dir, "documents"))


def _with_feedback(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    runs = docs.select(F.col("doc_id").alias("run_id"), F.array("source").alias("outputs"))
    said = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("run_id"), F.when(F.col("toxic") == 0, F.concat(F.lit("q"), "quality")).otherwise("  ").alias("feedback"))
    return J.runs_with_feedback(runs, said)


@query("""WITH f AS (SELECT doc_id % 200 AS mr_iid, 'logic' AS reviewer, lang AS issue, source AS location, quality::DOUBLE AS c FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT doc_id % 200, 'risk', lang, source, 0.5 FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 UNION ALL SELECT doc_id % 200, 'consistency', upper(lang), source, 0.9 FROM documents JOIN labels USING (doc_id) WHERE quality = 0)
SELECT mr_iid, CASE WHEN count(DISTINCT reviewer) >= 2 THEN 'agreed' ELSE 'disputed' END AS status, min(issue) AS issue, list_sort(list(DISTINCT reviewer)) AS sources, [location] AS locations, avg(c) AS confidence, min(c) < 0.8 AS escalate,
  substr(sha256(min(issue) || '|' || location), 1, 12) AS id, count(DISTINCT reviewer) || ' reviewer(s)' AS reason FROM f GROUP BY mr_iid, location, lower(issue)""")
def k1_k2_k4_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("mr_iid", F.col("doc_id") % 200)
    text = lambda c, a: F.col(c).alias(a)
    reviews = {
        "logic": d.select("mr_iid", text("lang", "issue"), text("source", "location"), text("quality", "confidence")),
        "risk": d.where("toxic = 1").select("mr_iid", text("lang", "risk"), text("source", "propagation"), F.lit(0.5).alias("confidence")),
        "consistency": d.where("quality = 0").select("mr_iid", F.upper("lang").alias("deviation"), text("source", "evidence"), F.lit(0.9).alias("confidence")),
    }
    return N.consensus(N.all_findings(reviews), ["mr_iid"])
