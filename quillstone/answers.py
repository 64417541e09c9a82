"""A store of model answers that outlives a run: what was asked once is never asked again.

An answer is kept under a hash of tier, system and prompt in a Parquet folder, to which each batch of calls appends before
the next one begins. So a killed run that is repeated asks only what its last batch had not yet stored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.lineage import cut
from quillstone.models import Budget, ModelFn, Transient, retried, tokens_of

ANSWER = "key string, tier string, answer string, tokens long"


def question(tier: str, system: str, prompt: Column) -> Column:
    """The hash of all that an answer depends on; a null prompt is an empty one."""
    head = f"{len(tier)}:{tier}{len(system)}:{system}"
    return F.sha2(F.concat(F.lit(head), F.coalesce(prompt, F.lit(""))).cast("binary"), 256)


class AnswerStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], ANSWER).write.mode("append").parquet(path)

    def read(self) -> DataFrame:
        """An answer for each key; of answers that two runs stored at once, the smallest."""
        self.spark.catalog.refreshByPath(self.path)
        rows = self.spark.read.schema(ANSWER).parquet(self.path)
        return rows.groupBy("key").agg(F.min(F.struct("answer", "tier", "tokens")).alias("a")).select("key", "a.*")

    def ask(
        self, rows: DataFrame, fn: ModelFn, tier: str, system: str, prompt: str = "prompt", budget: Budget | None = None, order: tuple[str, ...] = (),
        at_once: int | None = None, attempts: int = 3, wait: Callable[[float], None] = time.sleep,
    ) -> DataFrame:
        """L1, L2: rows with answer. Equal prompts are one call, those in the store none.

        Prompts are asked in batches of about at_once, on the executors, each call tried again while its failure may
        pass; one that fails for good is not stored, has a null answer and is asked again by the next run.
        Under a budget prompts come in the order of their first row (nulls first, ties by hash), at most as many as calls are left, and before each
        batch the budget is checked against what the answers so far really took: with at_once 1, the default then, cost never passes
        its limit by more than one call. Without a budget a batch is a hash block of the prompts (10,000 unless given). Without rows nothing is asked.
        """
        again = retried(fn, attempts, wait)
        keyed = rows.withColumn("_key", question(tier, system, F.col(prompt)))
        at = F.min(F.struct(*order)) if order else F.lit(None)
        asked = keyed.groupBy("_key").agg(F.first(F.coalesce(prompt, F.lit(""))).alias("_prompt"), at.alias("_at"))
        todo = cut(asked.join(self.read().select(F.col("key").alias("_key")), "_key", "left_anti"))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                out = []
                for key, text in zip(p["_key"], p["_prompt"]):
                    try:
                        answer = again(tier, system, text)
                    except Transient:
                        continue
                    out.append((key, tier, answer, tokens_of(system, text, answer)))
                yield pd.DataFrame(out, columns=["key", "tier", "answer", "tokens"])

        def settle(batch: DataFrame) -> None:
            done = cut(batch.select("_key", "_prompt").mapInPandas(run, ANSWER))
            done.write.mode("append").parquet(self.path)
            if budget is not None:
                n, tokens = done.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
                budget.calls[tier] = budget.calls.get(tier, 0) + n
                budget.tokens[tier] = budget.tokens.get(tier, 0) + tokens

        if budget is None:
            blocks = -(-todo.count() // (at_once or 10_000))
            for b in range(blocks):
                settle(todo.where(F.pmod(F.xxhash64("_key"), F.lit(blocks)) == b))
        else:
            left = max(0, budget.max_calls - sum(budget.calls.values()))
            keys = [r["_key"] for r in todo.orderBy("_at", "_key").limit(left).select("_key").collect()]  # max_calls at most
            for i in range(0, len(keys), at_once or 1):
                if sum(budget.calls.values()) >= budget.max_calls or budget.cost >= budget.max_cost:
                    break
                settle(todo.where(F.col("_key").isin(keys[i : i + (at_once or 1)])))
        found = self.read().select(F.col("key").alias("_key"), "answer")
        return keyed.drop("answer").join(found, "_key", "left").drop("_key")
