"""The stages of the corpus pipeline. Each works on all that the one before has kept.

All but the last return the columns they were given, in their order, of whatever names: an operator's own
columns never replace one of the input (they need doc_id and text; n_chars, where there is one, stays
the length of the text). Nulls in any other column, and repeated rows, are carried along as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import decontam, lines, near, packing, quality
from quillstone.llm.common import table, with_rest

_USED = ("doc_id", "text")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labels of docs, predicts to be good.

    Null and empty texts are scored like any other text; rows of a null doc_id are scored too and have
    no label; repeated rows are judged alike; a score of just the threshold is kept; very long texts
    are read whole; an empty table, or one without labels, stays as it is.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return with_rest(docs, _USED, lambda d: quality.score(d, model).where("predicted = 1"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; those of which nothing is left go.

    Null, empty and blank texts have no lines to lose and stay; lines are ordered by doc_id (null first,
    then by a hash of the text) and line; rows of equal doc_id and text are one document and lose the
    same lines, so none of them goes for the other; an empty table stays empty.
    """

    def drop(d: DataFrame) -> DataFrame:
        return lines.dedup(d).where((F.col("n_dropped") == 0) | (F.trim("text") != ""))

    out = with_rest(docs, _USED, drop)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id.

    Null and blank texts link with nothing and stay, as do rows of a null doc_id; rows that share a
    doc_id are one document, which stays or goes as a whole; an empty table stays empty.
    """
    return with_rest(docs, _USED, near.dedup)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; rows are told apart by doc_id and text, null ids included, so
    repeated rows go together; items without words match nothing; an empty table stays empty.
    """
    benchmark = table(spark, sf_dir, "benchmark")
    return with_rest(docs, _USED, lambda d: decontam.decontaminate(d, benchmark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences.

    Null texts are empty and have the end token alone; null ids are carried; repeated rows are packed
    once each; an empty table gives no pieces; all other columns are left out.
    """
    return packing.pack(docs)


STAGES = [("quality_classifier", keep_quality), ("line_dedup", drop_repeated_lines), ("minhash_near_dedup", drop_near_duplicates), ("benchmark_decontamination", drop_leaks), ("packing", pack)]
