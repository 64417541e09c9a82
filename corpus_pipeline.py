"""The corpus pipeline: stages over documents, each one of the operators in quillstone.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import stages
from quillstone.llm.common import cut

#: (name, function): each takes (spark, docs, sf_dir) and its result is the next one's docs.
STAGES = stages.STAGES

#: Model fitting and packing are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What every other stage keeps is materialised in the shared checkpoint folder, as each reads its input several times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
