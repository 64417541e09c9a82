"""Event intake, state by key and incremental upserts as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "object_kind string, event_type string, user struct<login:string>, project struct<id:bigint,path_with_namespace:string>, object_attributes struct<iid:int,action:string,target_branch:string,source_branch:string>"
ACTIONS = ("open", "reopen", "update")


def review_events(raw: DataFrame, col: str = "value") -> DataFrame:
    """Payloads (text) of merge requests that are opened, reopened or updated; batch or stream."""
    e = raw.select(F.from_json(col, EVENT).alias("e")).select("e.*")
    a = F.col("object_attributes")
    return e.where((F.col("object_kind") == "merge_request") & a["action"].isin(*ACTIONS)).select(F.col("project.id").alias("project_id"), a["iid"].alias("mr_iid"), a["action"].alias("action"), a["source_branch"].alias("source_branch"))


def intake(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None]):  # noqa: ANN201
    """A stream of payload files; what is accepted goes to handle, batch by batch."""
    raw = spark.readStream.format("text").option("wholetext", True).load(folder)
    return review_events(raw).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def signal_changes(signals: DataFrame) -> DataFrame:
    """W3, W-g, X7: a stream (ticker, ts, signal) to rows (ticker, previous, signal) where the signal changes; each ticker's last one is kept as state."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("ts", kind="stable")
        out = []
        for s in rows["signal"]:
            if last is not None and s != last:
                out.append((key[0], last, s))
            last = s
        state.update((last,))
        yield pd.DataFrame(out, columns=["ticker", "previous", "signal"])

    return signals.groupBy("ticker").applyInPandasWithState(run, "ticker string, previous string, signal string", "last string", "append", GroupStateTimeout.NoTimeout)


def running_budget(calls: DataFrame) -> DataFrame:
    """Calls and tokens of each run so far (complete or update mode)."""
    return calls.groupBy("run_id").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))


def windowed_counts(events: DataFrame, ts: str, kind: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Extension: events by window and kind, late ones up to a bound."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n"))


def upsert_sink(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the last row of each key in a folder, a new version a batch."""
    from pyspark.sql import Window

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = batch.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
        if batch_id:
            old = spark.read.parquet(f"{path}/version={batch_id - 1}")
            last = old.join(last.select(key), key, "left_anti").unionByName(last)
        last.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return put
