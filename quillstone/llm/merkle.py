"""A Merkle manifest of documents: every row's proof, folded up to the dataset's root.

A leaf is the digest of a row's fields. In each source leaves stand in the order of doc_id (null first), then of the
leaf itself; every FAN consecutive nodes have their digest as parent until one is left, the source's subroot.
Subroots, in the order of their sources (null first, bytewise), build the tree's upper part in the same way.

Leaves are numbered by two-level positions (prefix.numbered), so that a source of any size is spread over all tasks, and dealt
into blocks of BLOCK leaves of one source that are aligned with the tree, so each block is a subtree of at most INNER
levels. A DuckDB engine in each task runs the levels of whole blocks, some at a time, by ordered string_agg and sha256 over Arrow tables:
once for the blocks' roots, which Spark combines level by level (a run of FAN nodes at a time) into outer
paths, and once more, with each block's outer path joined to it, for proofs and folded roots. No proof is ever shuffled.

Cases: null fields have a digest of their own, other than that of empty ones; rows of equal doc_id are ordered by
leaf, equal rows have equal results but for the proof of their place; null ids are never tampered; texts are hashed whole; a
source or table of one row has its leaf as subroot or root and an empty proof; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import ascii_lower, cut, join_hubs
from quillstone.prefix import numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN, INNER = 16, 3
BLOCK = FAN**INNER
TAMPERED = 5
_PATH = "array<struct<run:string,i:int>>"


def leaf(fields: list[Column]) -> Column:
    """The digest of fields, each with its length in bytes before it, so that no two rows run into one another."""
    text = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]).cast("binary"), 256)


def levels(n: Column) -> Column:
    """How often so many nodes are combined until one is left."""
    return reduce(lambda a, k: a + (n > FAN**k).cast("int"), range(15), F.lit(0))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf and tampered: the leaf of the row with A-Z of its text lowered, for the rows that are tampered with if that makes a difference."""
    whole = [F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    changed = F.when(hit, leaf([*whole[:-1], ascii_lower(whole[-1])]))
    return docs.select("doc_id", "source", leaf(whole).alias("leaf"), changed.alias("tampered")).withColumn("tampered", F.nullif("tampered", "leaf"))


def _engine():  # noqa: ANN202
    import duckdb

    con = duckdb.connect(config={"threads": 1})
    con.execute("CREATE MACRO before(run, i) AS substr(run, 1, 64 * i)")
    con.execute("CREATE MACRO behind(run, i) AS substr(run, 64 * i + 65)")
    return con


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole blocks from batches that are sorted by (sid, block): at most a batch and a block are held."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        last = (held["sid"][-1].as_py(), held["block"][-1].as_py())
        at = held.num_rows
        while at and (held["sid"][at - 1].as_py(), held["block"][at - 1].as_py()) == last:
            at -= 1
        if at:
            yield held.slice(0, at)
            held = held.slice(at).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def _tree() -> str:
    """CTEs l0 .. l3, the nodes of each level, and r0 .. r2, the runs that become their parents."""
    out = ["l0 AS (SELECT sid, block, pos, leaf AS digest, height FROM t WHERE pos >= 0)"]
    for k in range(INNER):
        out.append(f"r{k} AS (SELECT sid, block, pos // {FAN} AS pos, string_agg(digest, '' ORDER BY pos) AS run, height FROM l{k} WHERE height > {k} GROUP BY sid, block, pos // {FAN}, height)")
        out.append(f"l{k + 1} AS (SELECT sid, block, pos, sha256(run) AS digest, height FROM r{k})")
    return "WITH " + ", ".join(out)


def _block_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = _engine()
    tops = " UNION ALL ".join(f"SELECT sid, block, digest FROM l{k} WHERE height = {k}" for k in range(INNER + 1))
    for t in _whole_blocks(batches):
        con.register("t", t)
        yield from con.sql(f"{_tree()} {tops}").to_arrow_table().cast(pa.schema([("sid", pa.int64()), ("block", pa.int64()), ("digest", pa.string())])).to_batches()


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of leaves (pos from 0) and of their blocks (pos -1, with path, subroot and root) to those of the result."""
    con = _engine()
    for t in _whole_blocks(batches):
        con.register("t", t)
        outer = con.execute("SELECT coalesce(max(len(path)), 0) FROM t").fetchall()[0][0]
        joins = " ".join(f"LEFT JOIN r{k} ON r{k}.sid = t.sid AND r{k}.block = t.block AND r{k}.pos = t.pos // {FAN ** (k + 1)}" for k in range(INNER))
        index = [f"(t.pos // {FAN**k}) % {FAN}" for k in range(INNER)]
        inside = " || ".join(f"coalesce(before(r{k}.run, {i}) || behind(r{k}.run, {i}), '')" for k, i in enumerate(index))
        fold = "coalesce(t.tampered, t.leaf)"
        for k, i in enumerate(index):
            fold = f"CASE WHEN r{k}.run IS NULL THEN {fold} ELSE sha256(before(r{k}.run, {i}) || {fold} || behind(r{k}.run, {i})) END"
        steps, found = f"f0 AS (SELECT t.doc_id, t.leaf, b.subroot, b.root, b.path, sha256({inside} || b.outside) AS proof_sha256, {fold} AS folded FROM t JOIN b ON b.sid = t.sid AND b.block = t.block {joins} WHERE t.pos >= 0)", "f0"
        for j in range(outer):
            p = f"path[{j + 1}]"
            steps += f", f{j + 1} AS (SELECT * REPLACE (CASE WHEN len(path) > {j} THEN sha256(before({p}.run, {p}.i) || folded || behind({p}.run, {p}.i)) ELSE folded END AS folded) FROM f{j})"
            found = f"f{j + 1}"
        siblings = "list_aggregate(list_transform(path, lambda p: before(p.run, p.i) || behind(p.run, p.i)), 'string_agg', '')"
        b = f"b AS (SELECT sid, block, subroot, root, path, coalesce({siblings}, '') AS outside FROM t WHERE pos < 0)"
        out = con.sql(f"{_tree()}, {b}, {steps} SELECT doc_id, leaf, subroot, root, proof_sha256, folded AS folded_root, folded = root AS verified FROM {found}")
        yield from out.to_arrow_table().to_batches()


def climb(nodes: DataFrame) -> DataFrame:
    """nodes (tree, at, digest, height: levels above them, the same in a whole tree) with path, the runs up to the tree's root with the node's index in each, and top, that root."""
    paths = nodes.select("tree", "at", F.array().cast(_PATH).alias("path"))
    level = nodes.select("tree", "at", "digest", "height")
    for k in range(nodes.agg(F.coalesce(F.max("height"), F.lit(0))).first()[0]):
        up = F.floor(F.col("at") / FAN).cast("long")
        run = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]), "")
        runs = cut(level.where(F.col("height") > k).groupBy("tree", up.alias("up"), "height").agg(run.alias("run")))
        mine = paths.withColumn("up", F.shiftright("at", 4 * (k + 1))).join(runs.select("tree", "up", "run"), ["tree", "up"], "left")
        step = F.struct("run", F.shiftright("at", 4 * k).bitwiseAND(FAN - 1).cast("int").alias("i"))
        paths = cut(mine.select("tree", "at", F.when(F.col("run").isNull(), F.col("path")).otherwise(F.array_append("path", step)).alias("path")))
        above = runs.select("tree", F.col("up").alias("at"), F.sha2(F.col("run").cast("binary"), 256).alias("digest"), "height")
        level = cut(level.where(F.col("height") <= k).union(above))
    return paths.join(level.select("tree", F.col("digest").alias("top")), "tree")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 of each row, and folded_root and verified of it as it is after tampering."""
    rows = cut(leaves(docs).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))))
    # "-" is smaller than "=", so null sources come first, and the others by their bytes
    sources = numbered(cut(rows.groupBy("key").agg(F.count("*").alias("n"))), [], ["key"], "sid")
    sources = cut(sources.withColumn("levels", levels(F.col("n"))))
    with_source = join_hubs(rows.drop("source"), sources.select("key", "sid", "levels"), "key", rows).drop("key")
    placed = cut(numbered(with_source, ["sid"], ["doc_id", "leaf"]).withColumns({"block": F.floor(F.col("pos") / BLOCK).cast("long"), "height": F.least("levels", F.lit(INNER))}).drop("levels"))
    blocks = placed.select("sid", "block", "pos", "leaf", "height").repartition("sid", "block").sortWithinPartitions("sid", "block", "pos")
    roots = cut(blocks.mapInArrow(_block_roots, "sid long, block long, digest string"))
    nodes = roots.join(sources.select("sid", "levels"), "sid")
    inside = cut(climb(nodes.select(F.col("sid").alias("tree"), F.col("block").alias("at"), "digest", F.greatest(F.col("levels") - INNER, F.lit(0)).alias("height"))))
    subroots = cut(inside.groupBy("tree").agg(F.first("top").alias("digest")))
    above = climb(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), "digest", levels(F.lit(subroots.count())).alias("height")))
    above = above.select(F.col("at").alias("tree"), F.col("path").alias("upper"), F.col("top").alias("root"))
    outer = inside.join(above, "tree").select(F.col("tree").alias("sid"), F.col("at").alias("block"), F.lit(-1).cast("long").alias("pos"), F.concat("path", "upper").alias("path"), F.col("top").alias("subroot"), "root")
    both = placed.unionByName(outer, allowMissingColumns=True).repartition("sid", "block").sortWithinPartitions("sid", "block", "pos")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(_proofs, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
