"""Queries on texts, each over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import tables
from quillstone.functions import text as T
from quillstone.lineage import new_folder
from quillstone.operators import diffs as D
from quillstone.operators import ranking as R
from quillstone.operators import stories as S
from quillstone.operators.postings import InvertedIndex
from quillstone.registry import query, table


@query("SELECT doc_id, ceil(length(text) / 4.0)::INT AS tokens FROM documents")
def c1_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, CASE WHEN length(text) <= 800 THEN text ELSE left(text, 800 - length(chr(10) || '... [truncated] ...' || chr(10))) || chr(10) || '... [truncated] ...' || chr(10) END AS text FROM documents")
def c6_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_to_tokens(F.col("text"), 200).alias("text"))


@query("SELECT doc_id, left(text, 2000) AS a, left(text, 6000) AS b, left(text, 8000) AS c FROM documents")
def c7_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[T.prefix(F.col("text"), n).alias(c) for n, c in ((2000, "a"), (6000, "b"), (8000, "c"))])


def diff_of(doc: DataFrame) -> DataFrame:
    """Documents as change sets: a section for each three lines, now and then of a file named before, with hunks."""
    lines = F.split("text", "\n")
    n = lambda i: F.concat(F.lit("f"), (i % 7).cast("string"), F.lit(".txt"))
    head = lambda i: F.when(i % 3 == 0, F.concat(F.lit("diff --git a/"), n(i), F.lit(" b/"), n(i), F.lit("\n@@ -1 +1 @@\n"))).when(i % 3 == 1, F.lit("@@ next\n")).otherwise(F.lit(""))
    return doc.select("doc_id", F.array_join(F.transform(lines, lambda x, i: F.concat(head(i), x)), "\n").alias("diff"))


_DIFF = r"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
s AS (SELECT doc_id, i // 3 AS sec, 'f' || (i // 3 * 3 % 7) || '.txt' AS file, string_agg(CASE i % 3 WHEN 0 THEN 'diff --git a/f' || (i % 7) || '.txt b/f' || (i % 7) || '.txt' || chr(10) || '@@ -1 +1 @@' || chr(10) WHEN 1 THEN '@@ next' || chr(10) ELSE '' END || x, chr(10) ORDER BY i) AS content FROM l GROUP BY 1, 2, 3)"""


@query(f"WITH {_DIFF} SELECT doc_id, file, min(sec)::INT AS place, max_by(content, sec) AS content FROM s GROUP BY 1, 2")
def c2_split_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = diff_of(table(spark, sf_dir, "documents"))
    s = d.select("doc_id", F.posexplode(D.split_by_file(F.col("diff"))).alias("pos", "s")).select("doc_id", "pos", "s.file", "s.content")
    # the place of a file's first section is the smallest section that names it
    return s.select("doc_id", "file", F.col("pos").alias("place"), "content")


@query(f"WITH {_DIFF} SELECT doc_id, list(file ORDER BY sec) AS files FROM (SELECT doc_id, file, min(sec) AS sec FROM s GROUP BY 1, 2) GROUP BY 1")
def c5_file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_of(table(spark, sf_dir, "documents")).select("doc_id", D.file_list(F.col("diff")).alias("files"))


@query()
def c3_c4_c8_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.chunk_rows(diff_of(table(spark, sf_dir, "documents")), max_tokens=500)


@query()
def e8_change_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same chunks by the table function, called from SQL with a review for each document."""
    tables.register(spark)
    changes = diff_of(table(spark, sf_dir, "documents"))
    return spark.sql("SELECT * FROM change_chunks(changes => TABLE(SELECT * FROM {changes}) PARTITION BY doc_id, max_tokens => 500)", changes=changes)


@query("SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 0) AS items FROM documents")
def c11_to_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.to_list(F.col("text")).alias("items"))


@query("SELECT doc_id, trim(regexp_extract(text, '(?i)license: *(.+)', 1)) AS license FROM (SELECT doc_id, 'x' || chr(10) || 'License: ' || source || ' ' || chr(10) || text AS text FROM documents)")
def c10_extract_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("x\nLicense: "), "source", F.lit(" \n"), "text")
    return table(spark, sf_dir, "documents").select("doc_id", T.extract_field(t, "LICENSE").alias("license"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE props END AS json FROM events")
def c12_json_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("so:\n```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise("none {")
    return table(spark, sf_dir, "events").select("event_id", T.json_of(raw).alias("json"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'CN' WHEN c_custkey % 3 = 1 THEN 'HK' ELSE 'US' END AS market FROM customer")
def c25_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    t = F.when(k % 3 == 0, F.lpad(k.cast("string"), 6, "6")).when(k % 3 == 1, F.concat(F.lpad((k % 10000).cast("string"), 4, "0"), F.lit(".HK"))).otherwise(F.concat(F.lit("T"), k.cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", T.market(t).alias("market"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'hold' END AS verdict FROM part")
def c26_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Rating: "), "p_type")).otherwise("nothing")
    return table(spark, sf_dir, "part").select("p_partkey", T.first_match(t, [r"Verdict:\s*(.+)", r"Rating:\s*(.+)"], "hold").alias("verdict"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'und') THEN 'a' WHEN contains(lower(text), 'the') OR contains(lower(text), 'que') THEN 'b' ELSE 'c' END AS class FROM documents")
def c27_first_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.first_class(F.col("text"), [("a", ["und"]), ("b", ["the", "QUE"])], "c").alias("class"))


@query("SELECT event_id, CASE WHEN event_type IN ('click') THEN 'uneasy' WHEN event_type = 'view' THEN 'certain' WHEN event_type = 'error' THEN 'satisfied' ELSE 'uneasy' END AS emotion FROM events")
def k5_emotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_type") == "view", " Certain ").when(F.col("event_type") == "error", "SATISFIED").when(F.col("event_type") == "click", "sure")
    return table(spark, sf_dir, "events").select("event_id", T.coerce_emotion(raw).alias("emotion"))


@query("SELECT event_id, (CASE event_id % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 WHEN 3 THEN 0.0 ELSE 0.25 END)::DOUBLE AS confidence FROM events")
def k6_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 5
    raw = F.when(n == 0, " ").when(n == 1, "no number").when(n == 2, "1.5").when(n == 3, "-0.5").otherwise("0.25")
    return table(spark, sf_dir, "events").select("event_id", T.parse_confidence(raw).alias("confidence"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'rejected' ELSE 'confirmed' END AS verdict, CASE WHEN event_type = 'error' THEN 'critical' ELSE 'note' END AS severity FROM events")
def k7_k8_verdict_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select("event_id", T.coerce_verdict(F.when(e, "rejected").otherwise("fine")).alias("verdict"), T.coerce_severity(F.when(e, "critical").otherwise("x")).alias("severity"))


@query("SELECT p_partkey, regexp_replace('=SUM(A' || p_size || ':$B$' || p_partkey || ')', '(\\$?[A-Z]{1,3}\\$?)\\d+', '\\1#', 'g') AS formula FROM part")
def c23_normal_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.concat(F.lit("=SUM(A"), F.col("p_size").cast("string"), F.lit(":$B$"), F.col("p_partkey").cast("string"), F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", T.normal_formula(f).alias("formula"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ['FILTER'] ELSE []::VARCHAR[] END AS used FROM part")
def c24_forbidden_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.when(F.col("p_size") % 2 == 0, "=filter (A1:A2)").otherwise("=SUM(B1)+FILTERED")
    return table(spark, sf_dir, "part").select("p_partkey", T.forbidden_functions(f, ["FILTER", "LAMBDA"]).alias("used"))


@query("""SELECT p_partkey, concat_ws(chr(10), '[function] ' || p_name, p_type, 'Calls: ' || p_brand, 'In: ' || p_brand || ':' || p_size || '-' || (p_size + 5)) AS text FROM part""")
def c9_embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    t = T.embedding_text(F.lit("function"), F.col("p_name"), F.col("p_type"), F.array("p_brand"), none, F.col("p_brand"), F.col("p_size"), F.col("p_size") + 5)
    return table(spark, sf_dir, "part").select("p_partkey", t.alias("text"))


@query("""WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: length(w) > 2) AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS term FROM t), d AS (SELECT term, count(DISTINCT doc_id) AS df FROM x GROUP BY 1)
SELECT term, df, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM d, (SELECT count(*) AS n FROM documents)""")
def f9_c14_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.corpus(table(spark, sf_dir, "documents"), "doc_id", "text")[0]


_TOKENS = r"list_filter(string_split_regex(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2)"


@query(f"""WITH t AS (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents), x AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM x GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), m AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(qf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN d USING (term) JOIN tf USING (term), m GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT item_id AS query_id, doc_id AS id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 3""")
def x1_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return R.bm25(table(spark, sf_dir, "documents"), q, "doc_id").withColumn("score", F.round("score", 6))


def _ranked(queries: str, results: int) -> str:
    """SQL for the best documents of queries (query_id, query)."""
    return f"""WITH t AS (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents), x AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM x GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), m AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
q AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({_TOKENS.format('query')}) AS term FROM ({queries})) GROUP BY ALL),
s AS (SELECT query_id, doc_id, sum(qf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN d USING (term) JOIN tf USING (term), m GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id AS id, round(score, 9) AS score, rank::INT AS rank FROM r WHERE rank <= {results}"""


@query(_ranked("SELECT item_id AS query_id, text AS query FROM benchmark", 3) + " UNION ALL (" + _ranked("SELECT -1 - item_id AS query_id, array_to_string(string_split(text, ' ')[-3:], ' ') AS query FROM benchmark", 10) + ")")
def x1_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents indexed once, for two sets of queries: benchmark items, and what items end with."""
    index = InvertedIndex(spark, new_folder(spark, "index")).build(table(spark, sf_dir, "documents"), "doc_id")
    b = table(spark, sf_dir, "benchmark")
    whole = index.search(b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))
    ends = index.search(b.select((-1 - F.col("item_id")).alias("query_id"), F.array_join(F.slice(F.split("text", " "), -F.least(F.lit(3), F.size(F.split("text", " "))), 3), " ").alias("query")), 10)
    return whole.unionByName(ends)


_RULES = [(0, "economy/steel"), (1, "standard"), (2, "promo-copper"), (3, "BRUSHED")]


@query(f"""WITH r(ord, category) AS (VALUES {', '.join(map(str, _RULES))}), c AS (SELECT ord, category, lower(category) AS l, string_split_regex(lower(category), '[ /-]+') AS words FROM r),
m AS (SELECT p_partkey, category, ord, CASE WHEN lower(p_type) = l THEN 1 WHEN contains(lower(p_type), l) OR contains(l, lower(p_type)) THEN 2 WHEN len(list_filter(words, lambda k: contains(lower(p_type), k))) > 0 THEN 3 END AS level FROM part, c),
b AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY level, ord) AS n FROM m WHERE level IS NOT NULL)
SELECT p.p_partkey, p.p_type, b.category, b.level::INT AS level FROM part p LEFT JOIN b ON b.p_partkey = p.p_partkey AND n = 1""")
def j11_find_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.find_rule(table(spark, sf_dir, "part"), spark.createDataFrame(_RULES, "ord int, category string"), "p_partkey", "p_type")


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 10")
def p15_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.project(table(spark, sf_dir, "part").where("p_size > 10"), ["p_partkey", "missing", "p_name"])


@query()
def u6_split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.split_rows(table(spark, sf_dir, "labels"), "quality", "doc_id", 0.2)[1]


@query("SELECT n_nationkey, n_name FROM nation, region WHERE n_regionkey = r_regionkey AND (contains(lower(n_name), lower(r_name)) OR contains(lower(r_name), lower(n_name)) OR len(list_intersect(list_distinct(string_split(lower(n_name), '')), list_distinct(string_split(lower(r_name), '')))) / len(list_distinct(string_split(lower(n_name || r_name), '')))::DOUBLE > 0.6)")
def c22_u4_fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).where(T.fuzzy_match(F.col("n_name"), F.col("r_name"))).select("n_nationkey", "n_name")


@query()
def c15_time_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("Day 3, "), "source", F.lit(" and 2 days later. **Date:** 2024-01-05\n"), "text")
    return table(spark, sf_dir, "documents").select("doc_id", S.time_markers(t).alias("markers"))


@query("SELECT doc_id, [source, lang] AS names FROM documents")
def c16_listed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("**Characters:** "), "source", F.lit(" and "), "lang", F.lit("\n"))
    return table(spark, sf_dir, "documents").select("doc_id", S.listed_names(t).alias("names"))


@query()
def c21_suspicious_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("\u200b"), "text")
    return S.suspicious_characters(table(spark, sf_dir, "documents").select("doc_id", t.alias("text"))).select("doc_id", "pos", "char", "kind", "context")


@query("SELECT p_partkey, 'Ann' || p_partkey AS name, 'age' AS attribute, (p_size + 1)::VARCHAR AS said, p_size::VARCHAR AS known FROM part")
def c17_c18_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k, n = F.col("p_partkey").cast("string"), F.col("p_size")
    docs = p.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("Here Ann"), k, F.lit(" is "), (n + 1).cast("string"), F.lit(" years old. Ann"), k, F.lit(" sleeps.")).alias("text"))
    sheets = p.select(F.concat(F.lit("p/"), k).alias("path"), F.concat(F.lit("# Ann"), k, F.lit("\n**Age:** "), n.cast("string"), F.lit("\n")).alias("text"))
    return S.contradictions(docs, S.profiles(sheets)).withColumnRenamed("doc_id", "p_partkey")


@query("SELECT doc_id, 'The' AS name, list_sort(list_distinct(list_filter(regexp_extract_all(text, '(?i)\\bthe\\b'), lambda x: x <> 'The'))) AS variants FROM documents WHERE regexp_matches(regexp_replace(text, '\\bThe\\b', '', 'g'), '(?i)\\bthe\\b')")
def c19_name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.name_variants(table(spark, sf_dir, "documents"), spark.createDataFrame([("The",)], "name string"))


@query("SELECT source, lang, min_by(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1, 2")
def c20_first_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_facts(table(spark, sf_dir, "documents"), ["source", "lang"], "n_chars", "doc_id")


@query("""SELECT p_brand, min_by(p_partkey, {'f': -s, 'k': p_partkey}) AS p_partkey FROM (SELECT *, CASE WHEN contains(lower(p_type), 'tin') THEN 3 ELSE 0 END + CASE WHEN contains(lower(p_type), 'promo') THEN 3 ELSE 0 END AS s FROM part) GROUP BY 1""")
def c28_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.lit("~").alias("name"), "p_type", F.array(F.lit("tin"), F.lit(" PROMO ")).alias("want"))
    return R.best_match(p, ["p_brand"], "name", "p_type", [], "want", "p_partkey").select("p_brand", "p_partkey")


@query("SELECT doc_id, ['a/' || source, 'b/' || source] AS paths FROM documents")
def p2_changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.concat(F.lit("--- a/"), "source", F.lit("\n+++ b/"), "source", F.lit("\n+x\n"), F.regexp_replace("text", "(?m)^[-+]", ""))
    return table(spark, sf_dir, "documents").select("doc_id", D.changed_paths(d).alias("paths"))


@query("SELECT n_nationkey AS id FROM nation WHERE n_nationkey > 0 AND n_nationkey < 12")
def p16_valid_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.operators import joins as J

    k = F.col("n_nationkey").cast("double")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), k.alias("left"), F.lit(0.0).alias("top"), k.alias("width"), F.lit(1.0).alias("height"))
    return J.valid_shapes(n, 12.0, 5.0).select("id")


@query("""SELECT doc_id, CASE WHEN quality = 1 THEN 'agreed' ELSE 'disputed' END AS status, toxic = 1 OR quality = 0 AS escalate, (CASE WHEN quality = 1 THEN 0.8 ELSE 0.5 END)::DOUBLE AS confidence, substr(sha256('i' || '|' || 'a,b'), 1, 12) AS id FROM labels""")
def k1_normalised_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.operators import findings as N

    q = F.col("quality") == 1
    raw = table(spark, sf_dir, "labels").select("doc_id", F.when(q, "AGREED").otherwise("contested").alias("status"), F.lit("i").alias("issue"), F.array(F.lit("s")).alias("sources"), F.array(F.lit("a"), F.lit("b")).alias("locations"), F.when(q, "0.8").alias("confidence"), (F.col("toxic") == 1).alias("escalate"), F.lit("").alias("reason"))
    return N.normalise_consensus(raw).select("doc_id", "status", "escalate", "confidence", "id")


@query(f"""WITH t AS (SELECT lang, doc_id, {_TOKENS.format('text')} AS w FROM documents), x AS (SELECT lang, doc_id, len(w) AS dl, unnest(w) AS term FROM t),
tf AS (SELECT lang, doc_id, dl, term, count(*) AS tf FROM x GROUP BY ALL), d AS (SELECT lang, term, count(*) AS df FROM tf GROUP BY ALL), m AS (SELECT lang, count(*) AS n, avg(len(w)) AS avgdl FROM t GROUP BY 1),
q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, lang, doc_id, sum(qf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN d USING (term) JOIN tf USING (lang, term) JOIN m USING (lang) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id, lang ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s),
c AS (SELECT item_id, CASE WHEN contains(lower(text), 'the') THEN 'the' WHEN contains(lower(text), 'und') THEN 'und' END AS category FROM benchmark)
SELECT item_id AS query_id, lang AS domain, doc_id AS id, round(score, 6) AS score, rank::INT AS rank, category FROM r JOIN c USING (item_id) WHERE rank <= CASE lang WHEN 'en' THEN 3 ELSE 1 END""")
def x11_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.operators.composition import compose

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    rules = spark.createDataFrame([(0, "the"), (1, "und")], "ord int, category string")
    return compose({x: (docs.where(F.col("lang") == x), 3 if x == "en" else 1) for x in ("de", "en", "es", "fr")}, q, rules).withColumn("score", F.round("score", 6))
