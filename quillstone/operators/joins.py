"""Joins by overlap and position, and outer joins with defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlaps(shapes: DataFrame, by: list[str], least: float = 0.05, cell: float = 4.0) -> DataFrame:
    """Pairs a < b of one group whose boxes (left, top, width, height) overlap by more than least both ways, with the area.

    Boxes are put into the cells of a grid that they touch, and meet by a join on the cell.
    """
    at = lambda lo, size: F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(lo) + F.col(size)) / cell))
    s = shapes.select(*by, "id", "left", "top", "width", "height").where("width > 0 and height > 0")
    s = s.withColumn("cx", F.explode(at("left", "width"))).withColumn("cy", F.explode(at("top", "height")))
    a, b = s.alias("a"), s.alias("b")
    same = F.col("a.cx").eqNullSafe(F.col("b.cx")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))
    for c in by:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    span = lambda lo, size: F.least(F.col(f"a.{lo}") + F.col(f"a.{size}"), F.col(f"b.{lo}") + F.col(f"b.{size}")) - F.greatest(F.col(f"a.{lo}"), F.col(f"b.{lo}"))
    w, h = span("left", "width"), span("top", "height")
    pairs = a.join(b, same & (F.col("a.id") < F.col("b.id"))).where((w > least) & (h > least))
    return pairs.select(*[F.col(f"a.{c}").alias(c) for c in by], F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.round(w * h, 2).alias("area")).distinct()


def valid_shapes(shapes: DataFrame, width: float, height: float) -> DataFrame:
    """Boxes with an extent that lie at least partly on the page."""
    return shapes.where((F.col("width") > 0) & (F.col("height") > 0) & (F.col("left") < width) & (F.col("top") < height) & (F.col("left") + F.col("width") > 0) & (F.col("top") + F.col("height") > 0))


def members(df: DataFrame, listed: DataFrame, key: str, inside: bool = True) -> DataFrame:
    """Rows whose key is listed, or is not."""
    return df.join(listed.select(key), key, "left_semi" if inside else "left_anti")


def zipped(df: DataFrame, a: str, b: str, names: tuple[str, str]) -> DataFrame:
    """The elements of two arrays side by side, null where one is shorter."""
    keep = [c for c in df.columns if c not in (a, b)]
    return df.select(*keep, F.posexplode(F.arrays_zip(F.col(a).alias(names[0]), F.col(b).alias(names[1]))).alias("pos", "_z")).select(*keep, "pos", "_z.*")


def by_cell(formulas: DataFrame, values: DataFrame) -> DataFrame:
    """Formulas with the values of their cells."""
    return formulas.join(values, ["sheet", "row", "col"], "left")


def with_dimension(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Rows with what the dimension has on their key."""
    return df.join(dimension, key, "left")


def runs_with_feedback(runs: DataFrame, feedback: DataFrame, key: str = "run_id") -> DataFrame:
    """All runs and all feedback that is not blank: no feedback is '', no run no outputs."""
    said = feedback.where(F.trim("feedback") != "")
    return runs.join(said, key, "full").withColumns({"feedback": F.coalesce("feedback", F.lit("")), "outputs": F.coalesce("outputs", F.array().cast("array<string>"))})


def deduplicated(*parts: DataFrame, key: list[str]) -> DataFrame:
    """The union of several lists, each key once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(key)


def joined_notes(df: DataFrame, parts: list[str]) -> DataFrame:
    """Arrays put together, null ones as empty."""
    return df.withColumn("notes", F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]))


def in_page_order(df: DataFrame) -> DataFrame:
    """By page, from top to bottom, from left to right."""
    return df.orderBy("page", F.desc("y"), "x")
