"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.lineage import cut, small, tasks_of

__all__ = ["ascii_lower", "connected_components", "cut", "join_hubs", "small", "table", "tasks_of", "with_rest"]

#: A node of more links than this, or than one in HUB_SHARE of all, is joined apart.
HUB, HUB_SHARE = 1_000, 100_000
#: Links that one partition holds.
LINKS = 250_000

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone, which lower() does not."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def with_rest(df: DataFrame, used: tuple[str, ...], apply: Callable[[DataFrame], DataFrame], added: tuple[str, ...] = ()) -> DataFrame:
    """apply() to the used columns alone, while the others travel packed in one, so that no name can clash.

    The result has df's columns in their order, and then the added ones, which replace columns of these names.
    """
    names = [c for c in df.columns if c not in added]
    rest = [c for c in names if c not in used]
    if not rest:
        return apply(df.select(*used)).select(*[f"`{c}`" for c in (*names, *added)])
    pack = "_rest"
    while pack in used or pack in added:
        pack += "_"
    out = apply(df.select(*used, F.struct(*[F.col(f"`{c}`") for c in rest]).alias(pack)))
    return out.select(*[F.col(f"{pack}.`{c}`") if c in rest else F.col(f"`{c}`") for c in names], *added)


def join_hubs(rows: DataFrame, side: DataFrame, key: str, counted: DataFrame) -> DataFrame:
    """rows joined with side on a key that may be very frequent in rows.

    The rows of a hub, a key of very many rows, would meet in one task. There are few hubs, at most HUB_SHARE
    of them however many rows there are, so what side has for these is broadcast and their rows stay where
    they are. counted: a materialised table whose keys are as frequent as those of rows.
    """
    columns = [*rows.columns, *[c for c in side.columns if c != key]]
    n = counted.count()
    hubs = cut(counted.groupBy(key).count().where(F.col("count") > max(HUB, n // HUB_SHARE)).select(key).coalesce(1 + n // LINKS)).coalesce(1)
    if not hubs.count():
        return rows.join(side, key).select(*columns)
    few = small(cut(side.join(small(hubs), key, "left_semi")))
    rest = rows.join(small(hubs), key, "left_anti").join(side, key)
    return rows.join(few, key).select(*columns).union(rest.select(*columns))


def _with_least(edges: DataFrame, least: DataFrame, bound: int, hubs: bool) -> DataFrame:
    """edges (u, v) with the m that least (u, m, n: its edges) has for u; hubs as in join_hubs."""
    if not hubs:
        return edges.join(least.select("u", "m"), "u")
    some = F.broadcast(least.where(F.col("n") > bound).select("u", "m"))
    rest = edges.join(some, "u", "left_anti").join(least.where(F.col("n") <= bound).select("u", "m"), "u")
    return edges.join(some, "u").select("u", "v", "m").union(rest.select("u", "v", "m"))


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(a, b) links, longs, to (node, root): root is the smallest node reachable.

    Alternates large-star and small-star steps, whose edges never outnumber the nodes' links; every
    step is two aggregations with map-side combine and a join on the node in which hubs are told apart, so
    that a component of any size is never gathered in one task. Links are held in as many partitions as their
    number needs, so that the steps of a few links are not dealt over a cluster's tasks, and those of one partition not at
    all: these are so few that no hub among them has to be told apart. Nodes without a link to another one are not part of the result; null ends are dropped.
    """
    u, v = F.col("u"), F.col("v")
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u > v").distinct().coalesce(tasks_of(edges.sparkSession)))
    parts = 1 + e.count() // LINKS
    held = lambda df: cut(df.coalesce(parts)).coalesce(parts)
    # what Spark estimates grows with each step, so that it would deal even a few links to a shuffle's partitions; at most 2 * LINKS nodes are sent
    met = F.broadcast if parts == 1 else lambda df: df
    e = e.coalesce(parts)
    for _ in range(max_rounds):
        # large star: every neighbour above the node hangs on the node's smallest neighbour
        both = e.select(F.inline(F.array(F.struct("u", "v"), F.struct(v.alias("u"), u.alias("v")))))
        least = held(both.groupBy("u").agg(F.least(F.min("v"), u).alias("m"), F.count("*").alias("n"), F.count_if(v < u).alias("below")))
        # settled: each node is a root, or hangs on one node alone and none hangs on it
        ends, most, open_ = least.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.count_if((F.col("below") > 0) & (F.col("n") > 1))).first()
        if not open_:
            return least.select(u.alias("node"), F.col("m").alias("root"))
        bound = max(HUB, ends // HUB_SHARE)
        hubs = parts > 1 and most > bound
        large = _with_least(both, met(least), bound, hubs).where(v > u).select(v.alias("u"), F.col("m").alias("v")).coalesce(parts).distinct()
        # small star: every neighbour below the node, and the node, hang on the smallest
        large = held(large) if hubs else large
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        least = held(least) if hubs else least
        joined = _with_least(large, met(least), bound, hubs)
        links = joined.select(v.alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = held(links.coalesce(parts).where("u != v").distinct())
    raise RuntimeError("components did not settle")
