"""The prefix trie of rebuilt conversations, merged family by family.

A family is the conversations c with one base id c - c % SPAN. Each conversation is rebuilt: it begins with
the first h original turns of its base conversation (all if fewer, none if absent) and goes on with its own turns after
its first h, if any, where h = crc32(c in decimal) % HEADS. A node of the trie is a distinct sequence of first turns (role, text).

Family first: Spark reduces each turn to a digest and its length, so no text is shuffled; the base conversations' rows and
all rows are cogrouped by base id, and each family builds its own small trie (at most 2 * SPAN - 1 conversations). Only a
family's combined nodes go on: one row for each node, told by a digest of its path, with the family's
counts. Globally, equal nodes are summed. What cannot be summed is mended through the nodes that several families share: a node of one family alone has
its whole subtree in that family, so its counts are final. A shared node u in f families counts f - 1 times too often among
its parent's children; the saved tokens of its families lack (f - 1) times its length; and it is a leaf if no family
has a child of it. These differences are summed over subtrees by doubling: in round k each shared node
gives what it has gathered to its ancestor 2**k levels above, which its family has named, so that the rounds
are the logarithm of the depth. A parent's smallest member is looked up through join_hubs, as a first turn may begin a third of all conversations.

A family is one task's work, of digests and never of texts; no other group is gathered, but for the ids of the
conversations that end in one node, which its hash covers as one value by definition (one string of each family, families in ascending order).

Cases: null role or text: empty; turns are ordered null first, those of an equal turn by their digest (rows repeated are turns of
their own); rows of a null conv_id belong to no conversation and are left out; a conversation that is rebuilt to no turn is a member of the
root and ends there; an empty table has no node, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import cut, join_hubs

SPAN, HEADS = 100, 6
ROOT = b"\0" * 16
#: A family's row for a node; up: the node's ancestors 1, 2, 4, .. levels above.
_NODE = "node binary, depth long, up array<binary>, base long, first long, first_above long, n_convs long, n_children long, n_leaves long, length long, saved long, ends string"
_SCHEMA = pa.schema([
    ("node", pa.binary()), ("depth", pa.int64()), ("up", pa.list_(pa.binary())), ("base", pa.int64()), ("first", pa.int64()), ("first_above", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("length", pa.int64()), ("saved", pa.int64()), ("ends", pa.string()),
])


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest of (role, text) and length of the text, with base, the family."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32))
    c = F.col("conv_id").cast("long")
    return conversations.where(c.isNotNull()).select((c - c % SPAN).alias("base"), c.alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("length"))


def _in_order(t: pa.Table) -> list[tuple[int, list[tuple[bytes, int]]]]:
    """Conversations in ascending order with their turns (digest, length)."""
    rows = zip(*(t[c].to_pylist() for c in ("conv_id", "turn", "digest", "length")))
    rows = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    return [(c, [r[2:] for r in g]) for c, g in groupby(rows, itemgetter(0))]


def _family(key: tuple, heads: pa.Table, rows: pa.Table) -> pa.Table:
    """The trie of a family: heads are the base conversation's turns, rows those of all its conversations."""
    base = key[0].as_py()
    head = [t for _, ts in _in_order(heads) for t in ts[: HEADS - 1]]
    # columns of the nodes, the root first; a parent always stands before its children
    at, depth, above, length, first, members, children, up, ends = {ROOT: 0}, [0], [-1], [0], [None], [0], [0], [[]], [[]]
    for c, own in _in_order(rows):
        h = zlib.crc32(str(c).encode()) % HEADS
        path, n = [ROOT], 0
        for i, (digest, size) in enumerate([(ROOT, 0), *head[:h], *own[h:]]):
            if i:
                node = hashlib.blake2b(path[-1] + digest, digest_size=16).digest()
                if node not in at:
                    at[node] = len(depth)
                    for column, v in zip((depth, above, length, first, members, children, up, ends), (i, n, size, None, 0, 0, [path[i - (1 << k)] for k in range(i.bit_length())], [])):
                        column.append(v)
                    children[n] += 1
                n = at[node]
                path.append(node)
            members[n] += 1
            first[n] = c if first[n] is None else first[n]
        ends[n].append(str(c))
    leaves = [int(k == 0) for k in children]
    saved = [(m - 1) * size for m, size in zip(members, length)]
    for i in range(len(depth) - 1, 0, -1):
        leaves[above[i]] += leaves[i]
        saved[above[i]] += saved[i]
    columns = [list(at), depth, up, [base] * len(depth), first, [first[p] if p >= 0 else None for p in above], members, children, leaves, length, saved, [",".join(e) or None for e in ends]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def family_nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of each family's own trie."""
    t = turns(conversations)
    return t.where("conv_id = base").groupBy("base").cogroup(t.groupBy("base")).applyInArrow(_family, _NODE)


def _subtree_sums(shared: DataFrame) -> DataFrame:
    """node with saved and leaves, which shared (node, depth, up, saved, leaves) has for itself alone, summed over the shared nodes of its subtree."""
    sums = shared
    for k in range(shared.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0].bit_length()):
        given = sums.where(F.size("up") > k).groupBy(F.get("up", F.lit(k)).alias("node")).agg(F.sum("saved").alias("_s"), F.sum("leaves").alias("_l"))
        sums = sums.join(given, "node", "left").select("node", "up", (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("leaves"))
        sums = cut(sums)
    return sums.select("node", F.col("saved").alias("more_saved"), F.col("leaves").alias("more_leaves"))


def build(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = cut(family_nodes(conversations))
    ends = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("ends").isNotNull(), F.struct("base", "ends")))), lambda x: x["ends"]), ",")
    childless = F.col("n_children") == 0
    nodes = cut(rows.groupBy("node").agg(
        F.min("depth").alias("depth"), F.any_value("up").alias("up"), F.min("first").alias("conv_id"), F.min("first_above").alias("first_above"), F.count("*").alias("families"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.min("length").alias("length"), F.sum("saved").alias("saved"),
        F.count_if(childless).alias("childless"), ends.alias("ends"),
    ))
    shared = cut(nodes.where("families > 1").select(
        "node", "depth", "up", "conv_id", ((F.col("families") - 1) * F.col("length")).alias("saved"), (F.when(F.col("n_children") == 0, 1).otherwise(0) - F.col("childless")).cast("long").alias("leaves"), (F.col("families") - 1).alias("again"),
    ))
    again = shared.where("depth > 0").groupBy(F.get("up", F.lit(0)).alias("node")).agg(F.sum("again").alias("again"))
    mended = _subtree_sums(shared.select("node", "depth", "up", "saved", "leaves")).join(again, "node", "left")
    # the smallest member of a shared parent; a parent of one family has told it already
    below = nodes.where("depth > 0").select("node", F.get("up", F.lit(0)).alias("above"))
    # (a child's parent is shared if its own families are several, or by this join)
    parents = join_hubs(below, shared.select(F.col("node").alias("above"), F.col("conv_id").alias("of_shared")), "above", below).select("node", "of_shared")
    out = nodes.join(mended, "node", "left").join(parents, "node", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).cast("long")
    return out.select(
        "conv_id", "depth", F.coalesce("of_shared", "first_above").alias("parent_conv_id"), F.col("n_convs").cast("long").alias("n_convs"), (F.col("n_children") - F.coalesce("again", F.lit(0))).cast("long").alias("n_children"),
        plus("n_leaves", "more_leaves").alias("n_leaves"), plus("saved", "more_saved").alias("saved_tokens"), F.sha2(F.col("ends").cast("binary"), 256).alias("ends_sha256"),
    )
