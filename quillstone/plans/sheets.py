"""Queries on cells and formulas, requests to services and their answers, and small look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import aggregates as A
from quillstone.operators import findings as N
from quillstone.operators import graph as G
from quillstone.registry import query, table
from quillstone.sources import files as S


def formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as formulas over ranges that their numbers give: of their own sheet, of another, or of two cells."""
    part, line, qty = (F.col(c).cast("string") for c in ("l_partkey", "l_linenumber", "l_quantity"))
    qty = F.col("l_quantity").cast("int").cast("string")
    f = (
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit("=SUM(A"), line, F.lit(":A"), part, F.lit(")")))
        .when(F.col("l_linenumber") == 2, F.concat(F.lit("=AVERAGE("), F.col("l_returnflag"), F.lit("!B2:B"), part, F.lit(")")))
        .otherwise(F.concat(F.lit("=count( C"), line, F.lit(":C"), qty, F.lit(" )*2")))
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("rows"), f.alias("formula"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_suppkey AS have, l_partkey AS p, l_quantity::INT AS q, l_returnflag AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN CASE WHEN p > 3 * have AND p > 100 THEN ['A1:A' || p] ELSE []::VARCHAR[] END
  WHEN 2 THEN CASE WHEN p > 100 AND p > 3 * CASE r WHEN 'A' THEN 40 WHEN 'R' THEN 200 END THEN [r || '!B2:B' || p] ELSE []::VARCHAR[] END
  ELSE CASE WHEN q > 3 * have AND q > 100 THEN ['C' || l_linenumber || ':C' || q] ELSE []::VARCHAR[] END END AS far,
  l_linenumber = 1 AND have > 1 AS header,
  CASE WHEN l_linenumber > 2 AND abs(q - l_linenumber) < 2 THEN ['count( C' || l_linenumber || ':C' || q || ' )'] WHEN l_linenumber = 1 AND p <= 2 THEN ['SUM(A1:A' || p || ')'] ELSE []::VARCHAR[] END AS small
FROM m""")
def c23_formula_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("formula")
    sheets = F.create_map(F.lit("A"), F.lit(40), F.lit("R"), F.lit(200))
    return formulas(spark, sf_dir).select("l_orderkey", "l_linenumber", T.out_of_range(f, F.col("rows"), sheets).alias("far"), T.header_included(f, F.col("rows")).alias("header"), T.small_aggregates(f).alias("small"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN NOT regexp_matches(p_type, '[-+*/()&,!:$]') WHEN 1 THEN NOT regexp_matches(p_name || p_partkey, '(?i)\\$?[a-z]{1,3}\\$?[0-9]+') ELSE false END AS is_text FROM part")
def c24_text_as_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 3
    value = F.when(k == 0, F.concat(F.lit("="), "p_type")).when(k == 1, F.concat(F.lit("= "), "p_name", F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit('="'), "p_name", F.lit('"')))
    return table(spark, sf_dir, "part").select("p_partkey", T.text_as_formula(value, k > 0).alias("is_text"))


@query("SELECT c_nationkey, count(*) AS n, greatest(count(*) - 20, 0) AS over, greatest(20 - count(*), 0) AS room, CASE WHEN count(*) > 20 THEN 5 ELSE 0 END AS prune FROM customer GROUP BY 1")
def f26_library_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.library_check(table(spark, sf_dir, "customer"), ["c_nationkey"])


@query("""SELECT n_nationkey + 1 AS row, n_name AS "NATION_0", n_regionkey::VARCHAR AS "0" FROM nation WHERE n_nationkey BETWEEN 1 AND 9""")
def s10_cell_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    cells = n.select(F.lit("N").alias("sheet"), (F.col("n_nationkey") + 1).alias("row"), F.posexplode(F.array("n_name", F.col("n_regionkey").cast("string"))).alias("at", "value"))
    return S.cell_range(cells.select("sheet", "row", (F.col("at") + 1).alias("col"), "value"), "N!A1:B10")


@query("""SELECT p_partkey AS mr_iid, 'discussions' AS path, '{"body":"' || p_name || '","position":{"base_sha":"b","start_sha":"s","head_sha":"h","new_path":"' || p_brand || '","new_line":' || p_size || ',"position_type":"text","old_path":"' || CASE WHEN p_size > 25 THEN p_type ELSE p_brand END || '"}}' AS payload,
  '{"body":"**' || p_brand || ':' || p_size || '**\\n\\n' || p_name || '"}' AS fallback FROM part""")
def o1_inline_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    comments = p.select(F.col("p_partkey").alias("mr_iid"), F.col("p_brand").alias("file"), F.col("p_size").alias("line"), F.col("p_name").alias("body"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("").alias("old_file"))
    refs = p.select(F.col("p_partkey").alias("mr_iid"), F.lit("b").alias("base_sha"), F.lit("s").alias("start_sha"), F.lit("h").alias("head_sha"))
    return N.inline_requests(comments, refs)


@query("""SELECT c_custkey AS mr_iid, 'notes' AS path, '{"body":"' || c_name || '"}' AS payload FROM customer""")
def o2_summary_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.summary_requests(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mr_iid"), F.col("c_name").alias("summary"))).drop("fallback")


@query("""SELECT c_custkey AS id, coalesce(o.name, c_name) AS name FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderstatus) AS name FROM orders GROUP BY 1) o ON o_custkey = c_custkey
UNION SELECT o_custkey, min(o_orderstatus) FROM orders GROUP BY 1""")
def o5_upsert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderstatus").alias("name"))
    return G.upsert_nodes(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), new, "id")


@query("""SELECT doc_id::VARCHAR AS id, n_chars AS n_citation FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'tion') AND source = (SELECT min(source) FROM documents) AND 1990 + n_chars % 30 >= 2000
ORDER BY n_chars DESC, id LIMIT 10 OFFSET 10""")
def s15_search_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    found = d.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("title"), (1990 + F.col("n_chars") % 30).cast("int").alias("year"), F.col("n_chars").alias("n_citation"), F.array(F.upper("source")).alias("authors"))
    author = d.agg(F.min("source")).first()[0]
    return S.search_papers(found, "The TION", author, 2000, "citation", page=1, size=10).select("id", "n_citation")


@query("SELECT p_partkey, p_name AS ticker, p_retailprice::DOUBLE AS price FROM part WHERE p_size % 4 > 0")
def s16_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat(F.lit("Here it is:\n"), F.to_json(F.struct(F.col("p_name").alias("ticker"), F.col("p_retailprice").alias("price"))), F.lit("\nas asked."))
    raw = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 4 > 0, answer).otherwise("I can't tell.").alias("value"))
    return S.fetched(raw).select("p_partkey", "ticker", "price")


_ELEMENTS = ("wood", "fire", "earth", "metal", "water")


@query("""WITH k AS (SELECT p_partkey, p_partkey % 5 AS e, p_size % 5 AS m, [p_size // 5 % 5, p_partkey // 5 % 5, (p_partkey + p_size) % 5] AS o FROM part)
SELECT p_partkey, CASE WHEN m = e OR m = (e + 4) % 5 THEN 40 WHEN m = (e + 3) % 5 THEN -20 ELSE 0 END + 15 * len(list_filter(o, lambda x: x = e)) AS score FROM k""")
def x12_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda n: F.get(F.array(*map(F.lit, _ELEMENTS)), F.pmod(n, F.lit(5)).cast("int"))
    k, size = F.col("p_partkey"), F.col("p_size")
    others = F.array(name(F.floor(size / 5)), name(F.floor(k / 5)), name(k + size))
    return table(spark, sf_dir, "part").select("p_partkey", T.strength(name(k), name(size), others).alias("score"))
