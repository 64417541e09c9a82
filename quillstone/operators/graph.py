"""The code graph: nodes and edges from symbols, and reachability over them.

Nodes are (node_key, label, name, kind, file), edges (src, dst, rel). Reachability is a loop of joins
between the frontier and the edges, at most MAX_DEPTH of them, each step written to the shared checkpoint
folder; what was reached before is left out, so a cycle ends it and no path is listed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import import_target
from quillstone.lineage import cut, small

MAX_DEPTH = 10


def qualified(file: Column, name: Column) -> Column:
    return F.concat(file, F.lit("::"), name)


def file_nodes(symbols: DataFrame) -> DataFrame:
    """G1: the files, each once."""
    return symbols.select(F.col("file").alias("path")).distinct()


def symbol_nodes(symbols: DataFrame) -> DataFrame:
    """Symbols by qualified name; of equal names the last in scan order counts."""
    w = Window.partitionBy("qualified_name").orderBy(F.desc("ord"))
    return symbols.withColumn("qualified_name", qualified(F.col("file"), F.col("name"))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def contains_edges(symbols: DataFrame) -> DataFrame:
    """Every (file, symbol), each once."""
    return symbols.select(F.col("file").alias("src"), qualified(F.col("file"), F.col("name")).alias("dst"), F.lit("CONTAINS").alias("rel")).distinct()


def call_edges(symbols: DataFrame) -> DataFrame:
    """Caller to every symbol whose qualified name is the callee, or whose name is its last part.

    The condition's two halves are joins on equality whose union is made distinct.
    """
    code = symbols.where(~F.col("kind").isin("import", "export"))
    calls = code.select(qualified(F.col("file"), F.col("name")).alias("src"), F.explode("calls_to").alias("callee")).distinct()
    calls = calls.withColumn("simple", F.element_at(F.split("callee", r"\."), -1))
    targets = symbol_nodes(symbols).select("qualified_name", "name")
    by_full = calls.join(targets, F.col("callee") == F.col("qualified_name")).select("src", "qualified_name")
    by_name = calls.join(targets, F.col("simple") == F.col("name")).select("src", "qualified_name")
    return by_full.union(by_name).distinct().select("src", F.col("qualified_name").alias("dst"), F.lit("CALLS").alias("rel"))


def import_edges(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges file to file, the files with those that imports alone name)."""
    edges = symbols.where("kind = 'import'").select(F.col("file").alias("src"), import_target(F.col("name")).alias("dst"), F.lit("IMPORTS").alias("rel")).where("dst is not null").distinct()
    return edges, file_nodes(symbols).union(edges.select("dst")).distinct()


def export_edges(symbols: DataFrame) -> DataFrame:
    """An export to the symbols of its file whose names its text holds, each once.

    A text's parts of the lengths that names of its file have meet the names by equality, so a file of very many
    symbols has no more rows than its distinct texts have such parts. Texts are lines, which have few.
    """
    e = symbols.where("kind = 'export'").select("file", F.col("name").alias("text")).distinct()
    t = symbols.where("kind not in ('import', 'export')").select("file", "name").distinct()
    lengths = t.groupBy("file").agg(F.collect_set(F.length("name")).alias("lengths"))  # of a file, as many as its longest name has characters at most
    sized = e.join(lengths, "file").select("file", "text", F.explode("lengths").alias("n")).where(F.length("text") >= F.col("n"))
    parts = sized.select("file", "text", "n", F.explode(F.sequence(F.lit(1), F.length("text") - F.col("n") + 1)).alias("at")).select("file", "text", F.substring("text", F.col("at"), F.col("n")).alias("name"))
    held = parts.join(t, ["file", "name"])
    return held.select(qualified(F.col("file"), F.col("text")).alias("src"), qualified(F.col("file"), F.col("name")).alias("dst"), F.lit("EXPORTS_TO").alias("rel")).distinct()


def resync_calls(old: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with the CALLS of the synced symbols replaced by those found now."""
    synced = symbols.select(qualified(F.col("file"), F.col("name")).alias("src")).distinct()
    stale = old.where("rel = 'CALLS'").join(synced, "src", "left_semi").select("src", "dst", "rel")
    return old.exceptAll(stale).unionByName(call_edges(symbols)).distinct()


def upsert_nodes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows over old ones of the same key; nothing is deleted."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def resolve_calls(symbols: DataFrame) -> DataFrame:
    """Each call to one target: (1) the qualified name, (2) file::callee, (3) the simple name in
    the caller's file, (4) the simple name anywhere. Of equal qualified names the last symbol in scan
    order is meant, of equal simple names the first. Calls on itself go. caller, callee, target."""
    code = symbols.where(~F.col("kind").isin("import", "export")).withColumn("qn", qualified(F.col("file"), F.col("name")))
    calls = code.select(F.col("ord").alias("caller_ord"), F.col("qn").alias("caller"), "file", F.explode("calls_to").alias("callee")).withColumn("simple", F.element_at(F.split("callee", r"\."), -1))
    by_qn = code.groupBy("qn").agg(F.max_by("ord", "ord").alias("t"))
    by_file = code.groupBy("file", "name").agg(F.min("ord").alias("t"))
    by_name = code.groupBy("name").agg(F.min("ord").alias("t"))
    out = (
        calls.join(by_qn.select(F.col("qn").alias("callee"), F.col("t").alias("t1")), "callee", "left")
        .withColumn("own", qualified(F.col("file"), F.col("callee")))
        .join(by_qn.select(F.col("qn").alias("own"), F.col("t").alias("t2")), "own", "left")
        .join(by_file.select("file", F.col("name").alias("simple"), F.col("t").alias("t3")), ["file", "simple"], "left")
        .join(by_name.select(F.col("name").alias("simple"), F.col("t").alias("t4")), "simple", "left")
        .withColumn("target_ord", F.coalesce("t1", "t2", "t3", "t4"))
    )
    named = code.select(F.col("ord").alias("target_ord"), F.col("qn").alias("target"))
    return out.where("target_ord is not null").join(named, "target_ord").where("caller != target").select("caller", "callee", "target").distinct()


def called_by(symbols: DataFrame) -> DataFrame:
    """A4: symbols with the sorted names of their callers."""
    callers = resolve_calls(symbols).groupBy("target").agg(F.array_sort(F.collect_set("caller")).alias("found"))
    s = symbols.drop("called_by").withColumn("_qn", qualified(F.col("file"), F.col("name")))
    return s.join(callers, F.col("_qn") == F.col("target"), "left").withColumn("called_by", F.coalesce("found", F.array().cast("array<string>"))).drop("_qn", "target", "found")


#: Roots that share a word of bits.
WORD = 64


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """J5, G7 (documented): for each seed (root, node) what reaches it against the edges src -> dst:
    root, node, depth (fewest hops, 1 to max_depth, clamped to 1..10). Seeds themselves are left out, as are edges without an end.

    Roots have numbers, and WORD of them are the bits of one row of a node: a hop is a join and a bit_or, combined before the
    shuffle, and what is new is what the node's bits did not have. Rows become pairs again only in the result.
    """
    depth = min(max(max_depth, 1), MAX_DEPTH)
    back = cut(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    roots = seeds.select(F.col("root").alias("_root")).distinct().withColumn("_i", F.monotonically_increasing_id())
    roots = small(cut(roots.select("_root", F.floor(F.col("_i") / WORD).alias("word"), (F.col("_i") % WORD).cast("int").alias("bit"))))
    either = lambda df: df.groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))
    start = seeds.where("node IS NOT NULL").join(roots, F.col("root").eqNullSafe(F.col("_root")))
    seen = frontier = cut(either(start.select("node", "word", F.expr("shiftleft(1L, bit)").alias("bits"))))
    found = frontier.select("*", F.lit(0).alias("depth")).limit(0)
    for d in range(1, depth + 1):
        step = either(frontier.withColumnRenamed("node", "dst").join(back, "dst").select(F.col("src").alias("node"), "word", "bits"))
        had = seen.select("node", "word", F.col("bits").alias("had"))
        new = step.join(had, ["node", "word"], "left").select("node", "word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long")))).alias("bits"))
        frontier = cut(new.where("bits != 0"))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier.withColumn("depth", F.lit(d)))
        seen = either(seen.unionByName(frontier))
    pairs = found.select("node", "depth", "word", F.explode(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit("bits", i) == 1)).alias("bit"))
    return pairs.join(roots, ["word", "bit"]).select(F.col("_root").alias("root"), "node", "depth")


def dependents_as_coded(edges: DataFrame, files: DataFrame, max_depth: int = 3) -> DataFrame:
    """G7 as coded: paths of CALLS or IMPORTS hops that end at a file, times the symbols it contains; the
    depth counts the last CONTAINS hop, the relationship is CONTAINS, and paths use each edge once."""
    depth = min(max(max_depth, 1), MAX_DEPTH)
    hop = edges.where("rel in ('CALLS', 'IMPORTS')").select("src", "dst", F.concat_ws("\u0001", "src", "dst", "rel").alias("edge"))
    contained = edges.where("rel = 'CONTAINS'").select(F.col("src").alias("root"), F.col("dst").alias("target"))
    front = files.select(F.col("path").alias("root"), F.col("path").alias("node"), F.array().cast("array<string>").alias("used"))
    found = None
    for d in range(1, depth + 1):
        front = front.join(hop, F.col("node") == F.col("dst")).where(~F.array_contains("used", F.col("edge"))).select("root", F.col("src").alias("node"), F.array_append("used", F.col("edge")).alias("used"))
        front = cut(front)
        rows = front.select("root", "node", F.lit(d + 1).alias("depth"))
        found = rows if found is None else found.unionByName(rows)
    return found.join(contained, "root").select("root", F.col("node").alias("qualified_name"), "depth", F.lit("CONTAINS").alias("relationship_type"))


def direct_dependents(edges: DataFrame, files: DataFrame, semantics: str = "documented") -> DataFrame:
    """What calls a symbol of the files (path), or (documented) imports one of them. root, node."""
    inside = edges.where("rel = 'CONTAINS'").join(files, F.col("src") == F.col("path")).select(F.col("path").alias("root"), F.col("dst").alias("target"))
    calls = edges.where("rel in ('CALLS', 'IMPORTS')").join(inside, F.col("dst") == F.col("target")).select("root", F.col("src").alias("node"))
    if semantics == "documented":
        calls = calls.union(edges.where("rel = 'IMPORTS'").join(files, F.col("dst") == F.col("path")).select(F.col("path").alias("root"), F.col("src").alias("node")))
    return calls.distinct()


def risk(direct: Column, indirect: Column) -> Column:
    """min((2 * direct + indirect) / 20, 1), from the numbers of dependents."""
    return F.least((2 * direct + indirect) / F.lit(20.0), F.lit(1.0))


def risk_map(dependents: DataFrame, changed: DataFrame) -> DataFrame:
    """For each changed root its direct (depth 1) and further dependents, sorted, and the risk; 0 without any."""
    lists = dependents.groupBy("root").agg(
        F.array_sort(F.collect_set(F.when(F.col("depth") == 1, F.col("node")))).alias("direct"), F.array_sort(F.collect_set(F.when(F.col("depth") > 1, F.col("node")))).alias("indirect")
    )
    return changed.select("root").distinct().join(lists, "root", "left").select(
        "root", F.coalesce("direct", F.array()).alias("direct"), F.coalesce("indirect", F.array()).alias("indirect"), risk(F.coalesce(F.size("direct"), F.lit(0)), F.coalesce(F.size("indirect"), F.lit(0))).alias("risk")
    )


def risk_map_from_json(raw: DataFrame, changed: str = "changed_files") -> DataFrame:
    """Raw (json, changed_files) with entries read field by field; what is no list gives each changed file a risk of 0.1."""
    entry = "array<struct<changed:string,direct:array<string>,indirect:array<string>,risk:double>>"
    e = raw.withColumn("_e", F.from_json("json", entry))
    none = F.array().cast("array<string>")
    given = F.transform("_e", lambda x, i: F.struct(F.coalesce(x["changed"], F.get(F.col(changed), i), F.lit("")).alias("changed"), F.coalesce(x["direct"], none).alias("direct"), F.coalesce(x["indirect"], none).alias("indirect"), F.coalesce(x["risk"], F.lit(0.1)).alias("risk")))
    default = F.transform(F.col(changed), lambda f: F.struct(f.alias("changed"), none.alias("direct"), none.alias("indirect"), F.lit(0.1).alias("risk")))
    is_list = F.col("_e").isNotNull() & F.trim("json").startswith("[")
    return e.select(*[c for c in raw.columns if c not in ("json", changed)], F.inline(F.when(is_list, given).otherwise(default)))


def find_symbols(nodes: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """Symbols of a name or qualified name, the first by qualified name."""
    return nodes.where((F.col("name") == name) | (F.col("qualified_name") == name)).orderBy("qualified_name").limit(limit)
