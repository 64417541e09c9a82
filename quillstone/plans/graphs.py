"""Graph queries. Suppliers stand in for files, parts for symbols; a part belongs to the file of its brand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import graph as G
from quillstone.registry import query, table


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols: name, file (the brand), scan order, and as callees the names of two other parts."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    first = F.concat(F.lit("pkg."), F.element_at(F.split("p_name", " "), 1))
    return p.select(
        n.alias("ord"), F.col("p_name").alias("name"), F.when(n % 10 == 0, "import").when(n % 10 == 1, "export").otherwise("function").alias("kind"), F.col("p_brand").alias("file"),
        F.col("p_size").alias("start_line"), (F.col("p_size") + 5).alias("end_line"), F.col("p_type").alias("signature"), F.array(F.col("p_name"), first).alias("calls_to"), F.array().cast("array<string>").alias("called_by"),
    )


_SYMBOLS = """s AS (SELECT p_partkey AS ord, p_name AS name, CASE p_partkey % 10 WHEN 0 THEN 'import' WHEN 1 THEN 'export' ELSE 'function' END AS kind, p_brand AS file,
  p_brand || '::' || p_name AS qn, [p_name, 'pkg.' || split_part(p_name, ' ', 1)] AS calls_to FROM part)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of suppliers: one depends on another that delivers the same part with the next higher key."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    nxt = li.groupBy("l_partkey").agg(F.min("l_suppkey").alias("low"), F.max("l_suppkey").alias("high"))
    return nxt.where("low < high").select(F.col("high").alias("src"), F.col("low").alias("dst")).distinct()


_EDGES = "e AS (SELECT DISTINCT max(l_suppkey) AS src, min(l_suppkey) AS dst FROM lineitem GROUP BY l_partkey HAVING min(l_suppkey) < max(l_suppkey))"
_REACH = f"""WITH RECURSIVE {_EDGES},
r(root, node, depth) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier UNION SELECT r.root, e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node WHERE r.depth < 3),
d AS (SELECT root, node, min(depth) AS depth FROM r GROUP BY 1, 2 HAVING min(depth) > 0)"""


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("root"), F.col("s_suppkey").alias("node"))


@query(f"{_REACH} SELECT root, node, depth::INT AS depth FROM d")
def g7_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reach(edges(spark, sf_dir), seeds(spark, sf_dir), 3).select("root", "node", "depth")


@query(f"""{_REACH}, c AS (SELECT s_suppkey AS root FROM supplier),
l AS (SELECT root, list_sort(list(node) FILTER (depth = 1)) AS direct, list_sort(list(node) FILTER (depth > 1)) AS indirect FROM d GROUP BY 1)
SELECT c.root, coalesce(direct, []) AS direct, coalesce(indirect, []) AS indirect, least((2 * coalesce(len(direct), 0) + coalesce(len(indirect), 0)) / 20.0, 1.0)::DOUBLE AS risk FROM c LEFT JOIN l ON l.root = c.root""")
def g9_risk_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = seeds(spark, sf_dir)
    return G.risk_map(G.reach(edges(spark, sf_dir), s, 3), s)


@query(f"""WITH {_EDGES} SELECT s_suppkey AS root, e.src AS node FROM supplier JOIN e ON e.dst = s_suppkey""")
def g8_direct_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reach(edges(spark, sf_dir), seeds(spark, sf_dir), 1).select("root", "node")


@query("SELECT DISTINCT p_brand AS path FROM part")
def g1_file_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.file_nodes(symbols(spark, sf_dir))


@query(f"WITH {_SYMBOLS} SELECT qn AS qualified_name, max(ord) AS ord, max_by(kind, ord) AS kind FROM s GROUP BY 1")
def g2_symbol_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.symbol_nodes(symbols(spark, sf_dir)).select("qualified_name", "ord", "kind")


@query("SELECT DISTINCT p_brand AS src, p_brand || '::' || p_name AS dst, 'CONTAINS' AS rel FROM part")
def g2_contains_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.contains_edges(symbols(spark, sf_dir))


_CALLS = f"""WITH {_SYMBOLS}, c AS (SELECT DISTINCT qn AS src, unnest(calls_to) AS callee FROM s WHERE kind = 'function'), t AS (SELECT DISTINCT qn, name FROM s)
SELECT DISTINCT c.src, t.qn AS dst, 'CALLS' AS rel FROM c JOIN t ON t.qn = c.callee OR t.name = list_last(string_split(c.callee, '.'))"""


@query(_CALLS)
def g3_j2_call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.call_edges(symbols(spark, sf_dir))


@query(f"{_CALLS} UNION SELECT 'old', 'node', 'CONTAINS' UNION SELECT 'other', 'x', 'CALLS'")
def g3_resync_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = symbols(spark, sf_dir)
    stale = s.select(G.qualified(F.col("file"), F.col("name")).alias("src"), F.lit("gone").alias("dst"), F.lit("CALLS").alias("rel")).distinct()
    old = stale.union(spark.createDataFrame([("old", "node", "CONTAINS"), ("other", "x", "CALLS")], "src string, dst string, rel string"))
    return G.resync_calls(old, s)


@query(f"""WITH {_SYMBOLS} SELECT DISTINCT e.qn AS src, t.qn AS dst, 'EXPORTS_TO' AS rel FROM s e JOIN s t ON e.file = t.file AND contains(e.name, t.name) WHERE e.kind = 'export' AND t.kind NOT IN ('import', 'export')""")
def g6_j3_export_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.export_edges(symbols(spark, sf_dir))


_IMPORTS = "SELECT p_brand AS file, CASE p_partkey % 3 WHEN 0 THEN 'import x from ''./' || p_type || '''' WHEN 1 THEN 'from a.b' || p_size || ' import c' ELSE 'use a::c' || p_size END AS text FROM part"
_TARGETS = f"""WITH i AS ({_IMPORTS}), t AS (SELECT DISTINCT file AS src, CASE WHEN text LIKE 'import%' THEN regexp_extract(text, '''(.+)''', 1) || '.ts' WHEN text LIKE 'from%' THEN replace(split_part(text, ' ', 2), '.', '/') || '.py' ELSE replace(split_part(text, ' ', 2), '::', '/') || '.rs' END AS dst FROM i)"""


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(F.lit("import x from './"), "p_type", F.lit("'"))).when(k == 1, F.concat(F.lit("from a.b"), size, F.lit(" import c"))).otherwise(F.concat(F.lit("use a::c"), size))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), text.alias("name"), F.lit("import").alias("kind"))


@query(f"{_TARGETS} SELECT src, dst, 'IMPORTS' AS rel FROM t")
def g4_g5_import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.import_edges(imports(spark, sf_dir))[0]


@query(f"{_TARGETS} SELECT src AS path FROM t UNION SELECT dst FROM t")
def j4_import_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.import_edges(imports(spark, sf_dir))[1]


@query(f"""WITH {_SYMBOLS}, k AS (SELECT * FROM s WHERE kind = 'function'),
c AS (SELECT DISTINCT qn AS caller, file, unnest(calls_to) AS callee FROM k),
q AS (SELECT qn, max(ord) AS t FROM k GROUP BY 1), f AS (SELECT file, name, min(ord) AS t FROM k GROUP BY 1, 2), n AS (SELECT name, min(ord) AS t FROM k GROUP BY 1),
r AS (SELECT c.caller, c.callee, coalesce(q1.t, q2.t, f.t, n.t) AS t FROM c LEFT JOIN q q1 ON q1.qn = c.callee LEFT JOIN q q2 ON q2.qn = c.file || '::' || c.callee
  LEFT JOIN f ON f.file = c.file AND f.name = list_last(string_split(c.callee, '.')) LEFT JOIN n ON n.name = list_last(string_split(c.callee, '.')))
SELECT DISTINCT r.caller, r.callee, k.qn AS target FROM r JOIN k ON k.ord = r.t WHERE r.caller <> k.qn""")
def j1_a4_resolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.resolve_calls(symbols(spark, sf_dir))


@query(f"WITH {_SYMBOLS} SELECT qn AS qualified_name, max(ord) AS ord FROM s WHERE name = (SELECT p_name FROM part WHERE p_partkey = 5) GROUP BY 1 ORDER BY 1 LIMIT 20")
def p10_find_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = table(spark, sf_dir, "part").where("p_partkey = 5").first()["p_name"]
    return G.find_symbols(G.symbol_nodes(symbols(spark, sf_dir)), name).select("qualified_name", "ord")


@query("SELECT c_custkey, [c_name] AS direct, least(2 * 1 / 20.0 + c_nationkey / 20.0, 1.0)::DOUBLE AS risk FROM customer")
def f7_risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.array("c_name").alias("direct"), G.risk(F.lit(1), F.col("c_nationkey")).alias("risk"))


@query("""SELECT c_custkey AS mr, CASE WHEN c_custkey % 3 = 0 THEN 'a.ts' ELSE 'x' END AS changed, []::VARCHAR[] AS direct, CASE WHEN c_custkey % 3 = 0 THEN 0.1 ELSE 0.5 END::DOUBLE AS risk FROM customer""")
def g10_risk_map_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mr"), F.when(F.col("c_custkey") % 3 == 0, "no list").otherwise('[{"changed": "x", "risk": 0.5}]').alias("json"), F.array(F.lit("a.ts")).alias("changed_files"))
    return G.risk_map_from_json(raw).select("mr", "changed", "direct", "risk")
