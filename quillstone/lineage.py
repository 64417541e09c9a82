"""Materialising a step of a plan, and broadcasts of a measured size."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of values that may be broadcast; they are summed over the materialised rows before each broadcast.
BROADCAST_BYTES = 32 << 20
#: Bytes of these that one task reads.
PART_BYTES = 4 << 20


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared checkpoint folder, so that losing an executor loses no part of it.

    The cluster names the folder in spark.checkpoint.dir; only on a local master (as in tests) is one
    set where it names none, as other machines would each write to a folder of their own.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all machines share."""
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillstone-checkpoint-"))
    named = sc._jsc.sc().getCheckpointDir()
    return named.get() if not named.isEmpty() else spark.conf.get("spark.checkpoint.dir")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder, for tables that a job writes on its way."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def tasks_of(spark: SparkSession) -> int:
    """Four tasks for each core, 32 at least."""
    return max(32, 4 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """df in at least four tasks for each core, for steps whose rows cost far more time than bytes: a small file is one task otherwise."""
    tasks = tasks_of(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def _bytes(c: Column, kind: T.DataType) -> Column:
    """About what a value takes in memory."""
    zero = F.lit(0).cast("long")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(c).cast("long") + 8
    elif isinstance(kind, T.ArrayType):
        size = 16 + F.aggregate(c, zero, lambda n, x: n + _bytes(x, kind.elementType))
    elif isinstance(kind, T.StructType):
        size = 8 + reduce(lambda n, f: n + _bytes(c[f.name], f.dataType), kind.fields, zero)
    else:
        size = F.lit(8).cast("long")
    return F.coalesce(size, F.lit(8).cast("long"))


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Marks an already materialised df for broadcast if its values sum up to few bytes, else for a join that shuffles.

    Left unmarked it would be joined as Spark estimates its size, from the files it was made of: rows made
    of a small table many times over would be broadcast however many they are. What is broadcast is read in
    tasks of PART_BYTES, as the driver gathers a result from each, however many partitions hold few rows.
    """
    size = reduce(lambda n, f: n + _bytes(F.col(f"`{f.name}`"), f.dataType), df.schema.fields, F.lit(16).cast("long"))
    total = df.coalesce(tasks_of(df.sparkSession)).select(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(df.coalesce(1 + total // PART_BYTES)) if total <= (BROADCAST_BYTES if limit is None else limit) else df.hint("merge")
