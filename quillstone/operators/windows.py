"""Operators on ordered rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.lineage import cut, small
from quillstone.operators.aggregates import PRICES, call_cost
from quillstone.prefix import beside, dealt, running

_BEFORE = (Window.unboundedPreceding, -1)


def sections(df: DataFrame, by: list[str], order: str, opens: Column) -> DataFrame:
    """W-a: numbers the section of each row by the header rows so far; rows before the first go. A group may be of any size."""
    rows = running(df.withColumn("_opens", F.coalesce(opens.cast("long"), F.lit(0))), by, [order], {"section": F.col("_opens")})
    return rows.withColumn("section", F.col("section") + F.col("_opens")).drop("_opens").where("section > 0")


def last_wins(df: DataFrame, by: list[str], key: str, order: str, value: str) -> DataFrame:
    """W-b: of each key its last value, in the place of its first."""
    return df.groupBy(*by, key).agg(F.max_by(value, order).alias(value), F.min(order).alias("place"))


def spans(df: DataFrame, by: list[str], pos: str, length: Column) -> DataFrame:
    """W-c: rows with the next one's position, or the whole length, as their end. A group may be of any size."""
    return beside(df, by, [pos], "end", F.col(pos), ahead=True).withColumn("end", F.coalesce("end", length))


def budget_gate(calls: DataFrame, by: str, order: list[str], max_calls: int, max_cost: float, prices: dict[str, float] = PRICES) -> DataFrame:
    """W-e, W5: which calls are admitted: those before which calls and cost are both below their limits. A run may be of any size."""
    rows = running(calls, [by], order, {"prior_calls": F.lit(1), "prior_cost": call_cost(F.col("tier"), F.col("tokens"), prices)})
    return rows.withColumn("admitted", (F.col("prior_calls") < max_calls) & (F.col("prior_cost") < max_cost))


_CHUNK = ["_g", "_part"]


def _beyond(v: np.ndarray, start: np.ndarray, tolerance: float) -> np.ndarray:
    """For each start the first index of ascending v that is further away than the tolerance, exactly as the difference rounds."""
    j = np.searchsorted(v, start + tolerance, "right")
    while (less := (j > 0) & (v[np.maximum(j, 1) - 1] - start > tolerance)).any():
        j = j - less
    while (more := (j < len(v)) & (v[np.minimum(j, len(v) - 1)] - start <= tolerance)).any():
        j = j + more
    return j


def _chunks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The chunks of a sorted partition, each as one frame."""
    held = [p for p in parts if len(p)]
    if held:
        for _, chunk in pd.concat(held).groupby(_CHUNK, sort=False):
            yield chunk


def _walks(v: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """For clusters that begin at each value: where the chunk's last one begins, and how many there are."""
    at = np.arange(len(v))
    after = _beyond(v, v, tolerance)
    to, steps = np.where(after < len(v), after, at), (after < len(v)).astype(np.int64)
    while not np.array_equal(to[to], to):
        steps, to = steps + steps[to], to[to]
    return v[to], steps + 1


def _entered(rows: DataFrame, walks: DataFrame, tolerance: float) -> DataFrame:
    """Of groups of several chunks: where the cluster begins that reaches into each chunk, and its number."""
    chunks = cut(walks.groupBy(*_CHUNK).agg(F.max("_v").alias("hi"), F.min_by("_last", "_v").alias("v"), F.min_by("_n", "_v").alias("n")))
    several = chunks.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("_part", "hi"))).alias("chunks")).where(F.size("chunks") > 1)
    several = small(cut(several))
    # a chunk's last cluster begins at an exit; the one after it begins in a later chunk, at most two of which are met by most chunks' exits
    exits = walks.where("_last = _v").join(several, "_g")
    to = F.get(F.filter("chunks", lambda c: (c["_part"] > F.col("_part")) & (c["hi"] - F.col("_v") > tolerance)), F.lit(0))["_part"]
    exits = cut(exits.select(*_CHUNK, "_v", to.alias("to")).where("to IS NOT NULL"))
    met = exits.select(*_CHUNK, "to").distinct().join(walks.select("_g", F.col("_part").alias("to"), "_v", "_last", "_n"), ["_g", "to"])

    def land(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("_v")
        j = _beyond(right["_v"].to_numpy(), left["_v"].to_numpy(), tolerance)
        return pd.DataFrame({"_g": left["_g"].to_numpy(), "v": left["_v"].to_numpy(), "nv": right["_last"].to_numpy()[j], "n": right["_n"].to_numpy()[j], "part": left["to"].to_numpy()})

    met = met.select("_last", "_n", "_v", *[F.col(c).alias(f"met{c}") for c in (*_CHUNK, "to")])
    jumps = cut(exits.groupBy(*_CHUNK, "to").cogroup(met.groupBy("met_g", "met_part", "metto")).applyInPandas(land, "_g string, v double, nv double, n long, part long"))
    first = chunks.join(several.select("_g", F.col("chunks")[0]["_part"].alias("_part")), _CHUNK)
    reached = new = cut(first.select("_g", F.col("_part").alias("part"), "v", "n"))
    while True:  # after each round exits twice as far are reached
        new = reached.join(jumps.select("_g", "v", F.col("nv"), F.col("n").alias("more"), F.col("part").alias("_to")), ["_g", "v"])
        new = cut(new.select("_g", F.col("_to").alias("part"), F.col("nv").alias("v"), (F.col("n") + F.col("more")).alias("n")))
        if new.isEmpty():
            break
        reached = cut(reached.unionByName(new))
        then = jumps.select("_g", F.col("v").alias("nv"), F.col("nv").alias("_nv"), F.col("n").alias("more"), F.col("part").alias("_to"))
        jumps = cut(jumps.join(then, ["_g", "nv"]).select("_g", "v", F.col("_nv").alias("nv"), (F.col("n") + F.col("more")).alias("n"), F.col("_to").alias("part")))
    w = Window.partitionBy("_g").orderBy("_part").rowsBetween(*_BEFORE)
    known = chunks.select(*_CHUNK).join(several.select("_g"), "_g").join(reached.select("_g", F.col("part").alias("_part"), "v", "n"), _CHUNK, "left")
    return small(cut(known.select(*_CHUNK, F.last("v", True).over(w).alias("_in"), F.last("n", True).over(w).alias("_before"))))


def clusters(df: DataFrame, by: list[str], value: str, tolerance: float) -> DataFrame:
    """W-f: values in ascending order; a new cluster begins where the value is further than the tolerance from where the current one began.

    A group of any size: its distinct values are dealt in chunks by ranges; each chunk works out all ways through it, doubled
    jumps between chunks tell which one is taken, and then each chunk numbers its own. Rows without a value (null or NaN) are
    in their group's last cluster (1 if there is no other).
    """
    v = F.col(value).cast("double")
    rows = df.withColumns({"_g": F.to_json(F.struct(*by)), "_v": F.when(~F.isnan(v), v)})
    values = dealt(rows.where("_v IS NOT NULL").select("_g", "_v").distinct(), ["_g"], ["_v"]).select(*_CHUNK, "_v")

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c in _chunks(parts):
            last, n = _walks(c["_v"].to_numpy(), tolerance)
            yield c.assign(_last=last, _n=n)

    walks = cut(values.mapInPandas(walk, "_g string, _part long, _v double, _last double, _n long"))
    entered = _entered(values, walks, tolerance)

    def number(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c in _chunks(parts):
            v, start, n = c["_v"].to_numpy(), c["_in"].iloc[0], c["_before"].iloc[0]
            begins = np.zeros(len(v), dtype=np.int64)
            after = _beyond(v, v, tolerance)
            j = 0 if pd.isna(start) else int(_beyond(v, np.array([start]), tolerance)[0])
            while j < len(v):
                begins[j] = 1
                j = after[j]
            yield c[["_g", "_v"]].assign(cluster=begins.cumsum() + (0 if pd.isna(n) else int(n)))

    given = values.join(entered, _CHUNK, "left").sortWithinPartitions(*_CHUNK, "_v")
    found = cut(given.mapInPandas(number, "_g string, _v double, cluster int"))
    last = found.groupBy("_g").agg(F.max("cluster").alias("cluster"))
    here = rows.join(found, ["_g", "_v"])
    lacking = rows.where("_v IS NULL").join(last, "_g", "left").withColumn("cluster", F.coalesce("cluster", F.lit(1)))
    return here.select(*df.columns, "cluster").unionByName(lacking.select(*df.columns, "cluster"))


def changes(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """W-g: rows whose value is another than the one before, which is put beside it."""
    return df.withColumn("previous", F.lag(value).over(Window.partitionBy(by).orderBy(*order))).where(F.col("previous").isNotNull() & (F.col("previous") != F.col(value)))


def labels(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """W-h: "i/n" for each row of a group."""
    w = Window.partitionBy(*by)
    return df.withColumn("label", F.concat_ws("/", F.row_number().over(w.orderBy(*order)).cast("string"), F.count("*").over(w).cast("string")))


def level_skips(df: DataFrame, by: list[str], order: str, level: str) -> DataFrame:
    """W-i: rows more than one level below the row before. A group may be of any size."""
    return beside(df, by, [order], "previous", F.col(level)).where(F.col(level) - F.col("previous") > 1)


def bands(df: DataFrame, by: list[str], order: str, weight: str, total: float, first: float = 1.618) -> DataFrame:
    """W-j: heights in proportion to weights (the first row's given) and where each band starts."""
    w = Window.partitionBy(*by).orderBy(order)
    df = df.withColumn("_w", F.when(F.row_number().over(w) == 1, F.lit(first)).otherwise(F.col(weight).cast("double")))
    df = df.withColumn("height", F.lit(total) * F.col("_w") / F.sum("_w").over(Window.partitionBy(*by)))
    return df.withColumn("start", F.coalesce(F.sum("height").over(w.rowsBetween(*_BEFORE)), F.lit(0.0))).drop("_w")


def allocate(weights: list[float], total: int, least: int = 2) -> list[int]:
    """Part of W-k: whole rows in proportion to weights, at least so many each; then the largest give, or the heaviest take, until the sum fits."""
    if not weights:
        return []
    s = sum(weights) or 1.0
    out = [max(least, round(total * w / s)) for w in weights]
    while sum(out) > total and max(out) > least:
        out[out.index(max(out))] -= 1
    while sum(out) < total:
        out[weights.index(max(weights))] += 1
    return out


def allocations(df: DataFrame, by: list[str], order: str, weight: str, total: int, least: int = 2) -> DataFrame:
    """W-k: rows with size and start, as allocate gives them for each group, of any size; a null weight is 0.

    Taking one at a time from the first of the largest ends at a level that nothing exceeds; it is found from the counts of
    equal sizes, at most total a group. Of those at the level the first ones lack one more.
    """
    w = F.coalesce(F.nanvl(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = df.withColumns({"_g": F.to_json(F.struct(*by)), "_w": w})
    sums = small(cut(rows.groupBy("_g").agg(F.sum("_w").alias("_s"), F.max("_w").alias("_most"))))
    share = F.rint(F.lit(total) * F.col("_w") / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))).cast("long")
    rows = rows.join(sums, "_g").withColumn("_size", F.greatest(F.lit(least), share))
    by_size = Window.partitionBy("_g").orderBy("_size")
    n = rows.groupBy("_g", "_size").agg(F.count("*").alias("c"))
    below, above = F.coalesce(F.sum(F.col("_size") * F.col("c")).over(by_size.rowsBetween(*_BEFORE)), F.lit(0)), F.sum("c").over(by_size.rowsBetween(0, Window.unboundedFollowing))
    n = n.select("_g", "_size", "c", below.alias("below"), above.alias("above"), F.coalesce(F.lag("_size").over(by_size) + 1, F.lit(least)).alias("lo"))
    n = n.withColumn("level", F.greatest("lo", F.ceil((F.lit(total) - F.col("below")) / F.col("above"))))
    fits = F.when(F.col("level") <= F.col("_size"), F.struct("level", F.when(F.col("level") > least, F.col("below") + F.col("level") * F.col("above") - total).otherwise(0).alias("lack")))
    levels = small(cut(n.groupBy("_g").agg(F.sum(F.col("_size") * F.col("c")).alias("_all"), F.min(fits).alias("_fit"))))
    rows = rows.join(levels, "_g").withColumns({"_high": F.col("_size") >= F.col("_fit.level"), "_heavy": F.col("_w") == F.col("_most")})
    rows = running(rows, ["_g"], [order], {"_highs": F.col("_high").cast("long"), "_heavies": F.col("_heavy").cast("long")})
    cuts = F.least("_size", "_fit.level") - (F.col("_high") & (F.col("_highs") < F.col("_fit.lack"))).cast("long")
    adds = F.col("_size") + F.when(F.col("_heavy") & (F.col("_heavies") == 0), F.lit(total) - F.col("_all")).otherwise(0)
    rows = rows.withColumn("size", F.when(F.col("_all") > total, cuts).otherwise(adds))
    rows = running(rows, ["_g"], [order], {"start": F.col("size")})
    return rows.select(*df.columns, F.col("size").cast("int").alias("size"), F.col("start").cast("int").alias("start"))


def first_per_group(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps n rows a group and task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)
