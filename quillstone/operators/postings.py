"""An inverted index that is written once and answers any number of query sets by BM25.

Documents are dealt to blocks of like length (a block is about BLOCK tokens). A posting is a row for a term and a block: how
many documents of the block have the term, the most that it can add to a score there, and the documents themselves. Postings lie in
buckets by a hash of the term, as folders, sorted by term, so a search reads the buckets of its terms alone; and of these first
what each block can add. The blocks that promise most are scored, and of the rest only those that can still
reach the last of the best: the others are never read, and the result is the same as if they had been.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions.text import search_tokens
from quillstone.lineage import cut, small
from quillstone.operators.ranking import K1, RESULTS, B, idf
from quillstone.prefix import running

#: Tokens of a block, and what a document counts besides its own.
BLOCK, DOCUMENT = 1 << 20, 64
#: Tokens whose postings make up a file, and folders at most; beyond, a folder holds several files.
FILE, BUCKETS = 1 << 22, 4096
#: Scores are rounded to nine digits; a block is left out only if it stays below by more than this.
_MARGIN = 1e-8


class InvertedIndex:
    """An index in a folder that all machines see. Documents are told apart by id and length: rows of one id and equal length
    are one document with the tokens of each, as in ranking.bm25. A null id is an id; a text that is null or has no words is counted and never found.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, docs: DataFrame, id_col: str = "id", text: str = "text", k1: float = K1, b: float = B, block: int = BLOCK) -> InvertedIndex:
        """Writes the index; what describes it comes last, so an index is there as a whole or not at all. An index is not written over."""
        t = docs.select(F.col(id_col).alias("id"), F.col(text).alias("_text"), F.size(search_tokens(F.col(text))).alias("dl"))
        lengths = cut(t.groupBy("dl").agg(F.count("*").alias("same")))  # as many rows as there are lengths
        n, words, with_text = lengths.agg(F.sum("same"), F.sum(F.col("dl").cast("long") * F.col("same")), F.sum(F.when(F.col("dl").isNotNull(), F.col("same")))).first()
        n, words, avgdl = n or 0, words or 0, (words or 0) / (with_text or 1)
        files = max(16, -(-words // FILE))
        buckets = min(BUCKETS, files)
        weight = F.col("dl").cast("long") + DOCUMENT
        places = small(cut(running(lengths.where("dl > 0"), [], ["dl"], {"_before": F.col("same") * weight})))
        # documents of one length are dealt by their id to all blocks that the length takes up
        at = F.floor((F.col("_before") + F.pmod(F.xxhash64("id"), F.col("same")) * weight) / block)
        # texts travel, not their words, which take more room; tasks grow with the table, so that one's memory does not
        tasks = self._tasks(-(-(words + DOCUMENT * n) // block), block)
        placed = t.join(places, "dl").select(at.alias("block"), "id", "dl", "_text").repartition(tasks, "block")
        words_of = placed.select("block", "id", "dl", F.explode(search_tokens(F.col("_text"))).alias("term"))
        tf = words_of.groupBy("block", "id", "dl", "term").agg(F.count("*").alias("tf"))
        packed = F.shiftleft(F.col("dl").cast("long"), 32).bitwiseOR(F.col("tf"))
        found = F.collect_list(F.struct("id", packed.alias("of")))  # the documents of a block at most
        rows = tf.groupBy("block", "term").agg(found.alias("_d")).select("block", "term", F.col("_d.id").alias("ids"), F.col("_d.of").alias("of"))
        dealt = rows.repartition(files, _bucket(F.col("term"), buckets), F.pmod(F.xxhash64("block"), F.lit(-(-files // buckets))))
        out = dealt.withColumns({"n": F.size("of"), "best": F.array_max(F.transform("of", lambda x: _share(x, avgdl, k1, b))), "bucket": _bucket(F.col("term"), buckets)})
        out.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{self.path}/postings")
        self.spark.createDataFrame([(n, buckets, out.schema.json(), avgdl, k1, b, block)], "n long, buckets int, postings string, avgdl double, k1 double, b double, block long").coalesce(1).write.parquet(f"{self.path}/about")
        return self

    def _tasks(self, blocks: int, block: int) -> int:
        """So many tasks that each has about BLOCK tokens, and at least one for each core as far as there are blocks."""
        return max(1, min(blocks, max(self.spark.sparkContext.defaultParallelism, -(-blocks * block // BLOCK))))

    def _scores(self, postings: DataFrame, share: Callable[[Column], Column], asked: DataFrame, block: int) -> DataFrame:
        """Scores of all documents in the blocks that are asked for: (query_id, term, block, w)."""
        asked = cut(asked)
        wanted = small(cut(asked.select("term", "block").distinct()))
        # postings travel as they are, by block, to tasks of a bounded size; a document's shares are summed where its block lies
        tasks = self._tasks(asked.select("block").distinct().count(), block)
        rows = postings.join(wanted, ["term", "block"], "left_semi").select("term", "block", "ids", "of").repartition(tasks, "block")
        each = rows.join(small(asked), ["term", "block"]).select("block", "query_id", "w", F.inline(F.arrays_zip("ids", "of")))
        scored = each.groupBy("block", "query_id", F.col("ids").alias("id"), F.shiftright("of", 32).alias("_dl")).agg(F.round(F.sum(F.col("w") * share(F.col("of"))), 9).alias("score"))
        return scored.drop("block", "_dl")

    def search(self, queries: DataFrame, results: int = RESULTS) -> DataFrame:
        """For each query (query_id, query) the best documents: query_id, id, score (to nine digits, above 0) and rank from 1, ties by id.

        Rows of one query_id are one query with the words of each. A query without words that documents have gets no row.
        """
        n, buckets, schema, avgdl, k1, b, block = self.spark.read.parquet(f"{self.path}/about").first()
        share = lambda of: _share(of, avgdl, k1, b)
        q = queries.select("query_id", F.explode(search_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
        q = cut(q.withColumn("bucket", _bucket(F.col("term"), buckets)))
        touched = [r["bucket"] for r in q.select("bucket").distinct().collect()]  # BUCKETS at most
        words = small(cut(q.select("term").distinct()))
        postings = self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(f"{self.path}/postings").where(F.col("bucket").isin(touched))
        heads = cut(postings.select("term", "block", "n", "best").join(words, "term", "left_semi"))
        df = heads.groupBy("term").agg(F.sum("n").alias("df"))
        weights = small(cut(q.join(df, "term").select("query_id", "term", (F.col("qf") * idf(F.col("df"), F.lit(n))).alias("w"))))
        asked = cut(heads.join(weights, "term"))
        best_first = Window.partitionBy("query_id").orderBy(F.desc("most"), "block")
        bounds = cut(asked.groupBy("query_id", "block").agg(F.sum(F.col("w") * F.col("best")).alias("most")).withColumn("_n", F.row_number().over(best_first)))
        # each block has a document with one of the terms, so as many blocks as results give as many scores
        first = cut(_best(self._scores(postings, share, _of(asked, bounds.where(F.col("_n") <= results)), block), results))
        least = first.where(F.col("rank") == results).select(F.col("query_id").alias("_query"), F.col("score").alias("_least"))
        rest = bounds.where(F.col("_n") > results).join(least, F.col("query_id").eqNullSafe(F.col("_query")), "left").where(F.col("most") >= F.coalesce("_least", F.lit(0.0)) - _MARGIN)
        more = self._scores(postings, share, _of(asked, rest), block)
        return _best(first.drop("rank").unionByName(more), results)


def _share(of: Column, avgdl: float, k1: float, b: float) -> Column:
    """What a term adds to the score of a document, but for the term's weight; of holds the length and how often it is there."""
    tf, dl = of.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftright(of, 32)
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(avgdl)))


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _of(asked: DataFrame, bounds: DataFrame) -> DataFrame:
    """The rows of asked whose query and block are among these."""
    keys = bounds.select(F.col("query_id").alias("_query"), F.col("block").alias("_block"))
    return asked.join(keys, F.col("query_id").eqNullSafe(F.col("_query")) & (F.col("block") == F.col("_block")), "left_semi").select("query_id", "term", "block", "w")


def _best(scored: DataFrame, results: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= results)
