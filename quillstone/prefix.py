"""Positions and running sums inside groups of any size, in two levels.

A window gives each group to one task. Here rows are dealt by ranges of (group, order), so a group that holds half of all
rows is spread over half of the tasks; each task numbers or sums its own rows, one row a (task, group) tells what lies before it, and
these few rows are joined back. Rows of equal group and order have a stated order only if order tells them apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.lineage import cut, small

_ROWS = (1 << 33) - 1  # the part of a generated id that counts a partition's rows


def dealt(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """df by ranges, sorted, with _part and _row; materialised, as other ranges would be drawn when it is computed again."""
    rows = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_id", F.monotonically_increasing_id())
    return cut(rows.select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(_ROWS).alias("_row")).drop("_id"))


def _offsets(chunks: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """chunks, of one row a (_part, group), with sums over the group's earlier chunks, and keys under names of their own."""
    w = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(c).alias(f"_key{i}") for i, c in enumerate([*by, "_part"])]
    return small(cut(chunks.select(*keys, *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n) for n, c in sums.items()], *[c for c in chunks.columns if c not in (*by, "_part")])))


def _joined(rows: DataFrame, offsets: DataFrame, by: list[str]) -> DataFrame:
    return rows.join(offsets, reduce(lambda x, ic: x & F.col(ic[1]).eqNullSafe(F.col(f"_key{ic[0]}")), enumerate([*by, "_part"]), F.lit(True)))


def numbered(df: DataFrame, by: list[str], order: list, name: str = "pos") -> DataFrame:
    """df with each row's position in its group (null is a group too), from 0."""
    rows = dealt(df, by, order)
    chunks = rows.groupBy(*by, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    offsets = _offsets(chunks, by, {"_before": F.col("_n")})
    return _joined(rows, offsets, by).select(*df.columns, (F.col("_row") - F.col("_first") + F.col("_before")).alias(name))


def running(df: DataFrame, by: list[str], order: list, sums: dict[str, Column]) -> DataFrame:
    """df with, under each name, the sum of a column over the rows before in the group (0 before the first; null adds nothing).

    A chunk is the part of a group that one task holds, so windows stay within a range of rows.
    """
    rows = dealt(df.withColumns({f"_s_{n}": c for n, c in sums.items()}), by, order)
    offsets = _offsets(rows.groupBy(*by, "_part").agg(*[F.sum(f"_s_{n}").alias(f"_sum_{n}") for n in sums]), by, {f"_before_{n}": F.col(f"_sum_{n}") for n in sums})
    w = Window.partitionBy(*by, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumns({f"_s_{n}": F.coalesce(F.sum(f"_s_{n}").over(w), F.lit(0)) for n in sums})
    return _joined(inner, offsets, by).select(*df.columns, *[(F.col(f"_s_{n}") + F.col(f"_before_{n}")).alias(n) for n in sums])


def beside(df: DataFrame, by: list[str], order: list, name: str, value: Column, ahead: bool = False) -> DataFrame:
    """df with the value of the row before (or ahead) in the group, null at its end."""
    rows = dealt(df.withColumn("_value", value), by, order)
    pick, step = (F.min_by, F.lead) if ahead else (F.max_by, F.lag)
    chunks = rows.groupBy(*by, "_part").agg(pick("_value", "_row").alias("_edge"), F.min("_row").alias("_first"), F.max("_row").alias("_last"))
    keys = [F.col(c).alias(f"_key{i}") for i, c in enumerate([*by, "_part"])]
    over = step("_edge").over(Window.partitionBy(*by).orderBy("_part"))
    edges = small(cut(chunks.select(*keys, over.alias("_over"), F.col("_last" if ahead else "_first").alias("_end"))))
    inner = step("_value").over(Window.partitionBy(*by, "_part").orderBy("_row"))
    out = _joined(rows.withColumn("_inner", inner), edges, by)
    return out.select(*df.columns, F.when(F.col("_row") == F.col("_end"), F.col("_over")).otherwise(F.col("_inner")).alias(name))
