"""Text ranking by BM25, rule look-ups and best matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import search_tokens
from quillstone.lineage import cut, small

K1, B, RESULTS = 1.5, 0.75, 3
#: Terms of queries that are looked up in place.
VOCABULARY = 20_000


def idf(df: Column, n: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)


def corpus(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(term, df, idf), and one row (n, avgdl). A document is a row; its distinct terms are counted before the shuffle."""
    t = docs.select(search_tokens(F.col(text)).alias("_t"))
    size = t.agg(F.count("*").alias("n"), F.avg(F.size("_t")).alias("avgdl"))
    df = t.select(F.explode(F.array_distinct("_t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(size)).select("term", "df", idf(F.col("df"), F.col("n")).alias("idf")), size


def bm25(docs: DataFrame, queries: DataFrame, id_col: str = "id", text: str = "text", k1: float = K1, b: float = B, results: int = RESULTS, vocabulary: int = VOCABULARY) -> DataFrame:
    """For each query (query_id, query) the best documents with a score (to nine digits) above 0, ties by id.

    Documents are read once: of each only its length and those of its terms that some query has are kept. The
    queries' terms are looked up in place if they are at most so many (they are counted), else joined. Rows of one id and equal
    length are one document with the tokens of each.
    """
    q = queries.select("query_id", F.explode(search_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    words = q.select("term").distinct()
    listed = [r["term"] for r in words.limit(vocabulary + 1).collect()]
    t = docs.select(F.col(id_col).alias("id"), search_tokens(F.col(text)).alias("_t"))
    if len(listed) <= vocabulary:
        # one array of arrays, so that a text is taken apart once for both
        both = F.get(F.transform(F.array("_t"), lambda x: F.struct(F.size(x).alias("dl"), F.filter(x, lambda w: w.isin(listed) if listed else F.lit(False)).alias("_t"))), F.lit(0))
        known = cut(t.select("id", both.alias("_k")).select("id", "_k.dl", "_k._t"))
        size = known.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        # by id once, which serves both sums below, so that only the best of each task are shuffled again
        tf = known.where(F.size("_t") > 0).repartition("id").select("id", "dl", F.explode("_t").alias("term")).groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))
    else:
        size = t.agg(F.count("*").alias("n"), F.avg(F.size("_t")).alias("avgdl"))
        tf = cut(t.select("id", F.size("_t").alias("dl"), F.explode("_t").alias("term")).join(words, "term", "left_semi").groupBy("id", "term", "dl").agg(F.count("*").alias("tf")))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    s = tf.join(small(cut(q.join(df, "term"))), "term").join(F.broadcast(size))
    part = F.col("qf") * idf(F.col("df"), F.col("n")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = s.groupBy("query_id", "id").agg(F.round(F.sum(part), 9).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where((F.col("rank") <= results) & (F.col("score") > 0))


def find_rule(items: DataFrame, rules: DataFrame, id_col: str, text: str) -> DataFrame:
    """Of rules (ord, category) the one that is equal, else part of one another, else with a word of its in the text; first declared among equals.

    Rules are a fixed table and are broadcast.
    """
    t, c = F.lower(F.trim(F.col(text))), F.lower(F.trim("category"))
    level = F.when(t == c, 1).when(F.contains(t, c) | F.contains(c, t), 2).when(F.exists(F.split(c, r"[\s/-]+"), lambda k: (k != "") & F.contains(t, k)), 3)
    m = items.select(id_col, text).join(F.broadcast(rules)).withColumn("level", level).where("level is not null")
    best = m.groupBy(id_col).agg(F.min_by(F.struct("category", "level"), F.struct("level", "ord")).alias("_r"))
    return items.select(id_col, text).join(best, id_col, "left").select(id_col, text, F.col("_r.category").alias("category"), F.col("_r.level").alias("level"))


def best_match(results: DataFrame, by: list[str], name: str, keywords_of: str, fields: list[str], wanted: str, order: str) -> DataFrame:
    """Of each group's results one, by its wanted words (an array, most wanted first): the first whose name holds, or
    is part of, the most wanted word that any name has; else the highest sum of 10 for a word in the name, 3 in its
    keywords, 1 in another field; else the first."""
    n = F.lower(F.coalesce(name, F.lit("")))
    clean = lambda w: F.lower(F.trim(w))
    rest = F.lower(F.concat_ws(" ", name, keywords_of, *fields))
    hit = F.filter(F.sequence(F.lit(0), F.size(wanted) - 1), lambda i: F.contains(n, clean(F.get(wanted, i))) | F.contains(clean(F.get(wanted, i)), n))
    first = F.when(F.size(wanted) > 0, F.get(hit, F.lit(0)))
    one = lambda w: F.when(F.contains(n, w), 10).when(F.contains(F.lower(F.coalesce(keywords_of, F.lit(""))), w), 3).when(F.contains(rest, w), 1).otherwise(0)
    score = F.aggregate(wanted, F.lit(0), lambda s, w: s + one(clean(w)))
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last("_first"), F.desc("match_score"), order)
    return results.withColumns({"_first": first, "match_score": score}).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_first")


def project(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Those of the wanted columns that there are."""
    return df.select(*[c for c in wanted if c in df.columns])


def split_rows(df: DataFrame, label: str, key: str, holdout: float) -> tuple[DataFrame, DataFrame]:
    """(train, test): of each label the first share by hash of the key, at least one row, is the test part."""
    w = Window.partitionBy(label)
    d = df.withColumn("_r", F.row_number().over(w.orderBy(F.xxhash64(key), key))).withColumn("_n", F.count("*").over(w))
    is_test = F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * holdout))
    return d.where(~is_test).drop("_r", "_n"), d.where(is_test).drop("_r", "_n")
