"""Benchmark decontamination with SimHash windows, in DataFrame functions alone.

Words are runs of ASCII letters and digits and of anything beyond ASCII, in lower case. A window as
long as a benchmark item is compared with the items of that length: its SimHash (PRINTS numbers of 64
bits; each shingle of SIZE words votes as often as it occurs) is cut into blocks, an item is stored
under all values within FLIPS flips of each of its blocks, and a window looks up its own. If two
fingerprints are within RADIUS bits, one block is within FLIPS, so no such pair is missed; of unlike
pairs of one length about one in eight becomes a candidate. Candidates are checked on all bits, then by
weighted shingle similarity: the sum of the smaller over the sum of the larger multiplicities, at least
SIMILARITY. Texts just at that similarity are 19 bits apart on average, with a deviation of 4; RADIUS is
29, so some 99 of 100 of these are found, and more of those that are more alike (a test measures it).

Not every window has to be hashed. One that is similar enough to an item begins, after being moved
right, with a shingle of that item without its similarity falling (what it loses on the left is not in
the item), so windows begin at shingles that some item of their length has; and SIMILARITY of a
window's shingles have to be in the benchmark. Equal windows are compared once, however often they
occur. The benchmark side (its shingles, and its stored blocks) is broadcast when it is measured to be
small and joined by shuffling otherwise.

Cases: null or blank texts hold nothing; an item of fewer than SIZE words is one shingle, that of its
whole sequence, and so matches wherever its words stand one after the other; items without words match
nothing; a null item_id is an item like others; a window at the end of a text may be shorter; repeated
rows give one result for each doc_id and item_id; equal items all match; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import LINKS, cut, small

SIZE = 5
SIMILARITY = 0.8
#: 64-bit numbers of a fingerprint, the widths of its blocks, and the flips of a block under which an item is stored.
PRINTS = 2
WIDTHS = (13,) * 4 + (12,) + (13,) * 4 + (12,)
FLIPS = 2
#: Bytes of stored block values that may be broadcast.
STORED_BYTES = 2 << 20
#: Windows that a task takes the fingerprints of, about.
WINDOWS = 500
#: Fingerprints so far apart or nearer have a block within FLIPS, as one flip more in each would be too many.
RADIUS = len(WIDTHS) * (FLIPS + 1) - 1


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle(w: Column, i: Column, size: int = SIZE) -> Column:
    """The hash of so many words from i (from 0)."""
    return F.xxhash64(*[F.get(w, i + k) for k in range(size)])


def positions(w: Column, size: int = SIZE) -> Column:
    """0 to the number of shingles, less one; empty for a short text."""
    return F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))


def shingles(w: Column) -> Column:
    """All shingles, with copies; of fewer than SIZE words the only one of them all."""
    out = F.transform(positions(w), lambda i: shingle(w, i))
    for n in range(1, SIZE):
        out = F.when(F.size(w) == n, F.array(shingle(w, F.lit(0), n))).otherwise(out)
    return out


def simhash(grams: Column) -> Column:
    """PRINTS numbers: a bit is set if more than half of the shingles, by multiplicity, have it set in their hash."""

    def number(seed: int) -> Column:
        def from_hashes(h: Column) -> Column:
            one = lambda b: F.aggregate(h, F.lit(0), lambda n, g: n + F.getbit(g, b).cast("int"))
            bit = lambda b: F.when(2 * one(b) > F.size(h), F.expr("1L")).otherwise(F.expr("0L"))
            return F.aggregate(F.sequence(F.lit(63), F.lit(0), F.lit(-1)), F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(bit(b)))

        return let(F.transform(grams, lambda g: F.xxhash64(g, F.lit(seed))) if seed else grams, from_hashes)

    return F.array(*[number(seed) for seed in range(PRINTS)])


def distance(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(PRINTS)), F.lit(0))


def blocks(fingerprint: Column) -> list[Column]:
    """The value of each block; blocks lie within one number each."""
    starts = [0, *accumulate(WIDTHS)]
    return [F.shiftrightunsigned(F.get(fingerprint, F.lit(s // 64)), s % 64).bitwiseAND((1 << w) - 1).cast("int") for s, w in zip(starts, WIDTHS)]


def flips(width: int) -> list[int]:
    """Masks of all ways to flip at most FLIPS bits of a block."""
    return [sum(1 << b for b in c) for n in range(FLIPS + 1) for c in combinations(range(width), n)]


def counted(grams: Column) -> Column:
    """A multiset as a sorted array: the k-th copy of a shingle carries k, so that intersections count copies."""
    s = F.array_sort(grams)
    return F.transform(s, lambda g, i: F.struct(g.alias("g"), (i - F.array_position(s, g)).alias("k")))


def similarity(a: Column, b: Column) -> Column:
    """Of two counted multisets: the smaller multiplicities over the larger ones."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, n (words), grams, counted, simhash of the items that can match."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    g = cut(w.select("item_id", F.size("w").alias("n"), let(F.col("w"), shingles).alias("grams")))
    return cut(g.select("*", counted(F.col("grams")).alias("counted"), simhash(F.col("grams")).alias("simhash")))


def _hits(base: DataFrame, known: DataFrame, size: int, limit: int) -> DataFrame:
    """base (doc_id, text_hash, w) with hits, the places of known (g) shingles of a size; rows without any go."""
    if (n := known.count()) <= limit:  # a bounded set of hashes, looked up in place
        listed = [r["g"] for r in known.collect()]
        found = base.select("doc_id", "w", let(F.col("w"), lambda w: F.filter(positions(w, size), lambda i: shingle(w, i, size).isin(listed) if n else F.lit(False))).alias("hits"))
    else:
        # rows of equal doc_id and text have equal hits
        flat = base.select("doc_id", "text_hash", F.posexplode(let(F.col("w"), lambda w: F.transform(positions(w, size), lambda i: shingle(w, i, size)))).alias("pos", "g"))
        at = flat.join(small(known), "g", "left_semi").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.array_sort(F.collect_set("pos")).alias("hits"))
        found = base.join(at, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("doc_id", "w", "hits")
    return found.where(F.size("hits") > 0)


def windows(docs: DataFrame, bench: DataFrame, share: float = SIMILARITY, limit: int = 200_000) -> DataFrame:
    """doc_id, start, n and grams of the item-sized windows that can match."""
    # in as many partitions as their number needs, as each step on them is so many tasks
    parts = 1 + bench.select(F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()[0] // LINKS
    known = cut(bench.coalesce(parts).select("n", F.explode("grams").alias("g")).distinct().coalesce(parts)).coalesce(parts)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    hits = _hits(base, known.where(F.col("n") >= SIZE).select("g").distinct(), SIZE, limit)
    start = hits.select("doc_id", "w", "hits", F.posexplode("hits").alias("j", "start"))
    sized = start.withColumn("g", shingle(F.col("w"), F.col("start"))).join(small(known.where(F.col("n") >= SIZE)), "g")
    need = F.ceil(F.lit(share) * (F.col("n") - SIZE + 1) - F.lit(1e-9)).cast("int")
    last = F.col("start") + F.col("n") - SIZE
    able = sized.where(F.coalesce(F.get("hits", F.col("j") + need - 1) <= last, F.lit(False)))
    upto = F.least(last, F.size("w") - SIZE)
    grams = let(F.col("w"), lambda w: F.transform(F.sequence(F.col("start"), upto), lambda i: shingle(w, i)))
    out = able.select("doc_id", "start", "n", grams.alias("grams"))
    for r in known.where(F.col("n") < SIZE).select("n").distinct().collect():  # SIZE - 1 lengths at most
        short = _hits(base, known.where(F.col("n") == r["n"]).select("g"), r["n"], limit).select("doc_id", "w", F.explode("hits").alias("start"))
        out = out.union(short.select("doc_id", "start", F.lit(r["n"]), F.array(shingle(F.col("w"), F.col("start"), r["n"]))))
    return out


def candidates(prints: DataFrame, bench: DataFrame) -> DataFrame:
    """n, window, of_window and item_id of the windows and items of one length that agree in a block, within FLIPS."""
    values = lambda stored: F.array(*[F.struct(F.lit(i).alias("block"), v.alias("value"), *([F.array(*map(F.lit, flips(w))).alias("masks")] if stored else [])) for i, (v, w) in enumerate(zip(blocks(F.col("simhash")), WIDTHS))])
    stored = bench.select("item_id", "n", F.explode(values(True)).alias("b"))
    stored = stored.select("item_id", "n", "b.block", F.explode(F.transform("b.masks", lambda m: F.col("b.value").bitwiseXOR(m))).alias("value"))
    asked = prints.select("n", "window", F.col("simhash").alias("of_window"), F.explode(values(False)).alias("b"))
    asked = asked.select("n", "window", "of_window", "b.block", "b.value")
    # some thousand values an item: beyond few items they are dealt, as a broadcast of them takes several times its size of the driver
    return asked.join(small(cut(stored), STORED_BYTES), ["n", "block", "value"]).select("n", "window", "of_window", "item_id").distinct()


def _alike(docs: DataFrame, benchmark: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """The windows (doc_id, start, n, window, grams), and n, window, item_id and similarity of those that are alike to an item."""
    bench = items(benchmark)
    found = cut(windows(docs, bench, share).withColumn("window", F.xxhash64("n", "grams")))
    distinct = found.groupBy("n", "window", "grams").agg(F.lit(1).alias("one")).select("n", "window", "grams")
    prints = cut(distinct.coalesce(1 + found.count() // WINDOWS).select("*", simhash(F.col("grams")).alias("simhash"), counted(F.col("grams")).alias("counted")))
    listed = small(bench.select(F.col("item_id").alias("_item"), "n", F.col("simhash").alias("of_item"), F.col("counted").alias("item")))
    near = candidates(prints, bench).join(listed.withColumnRenamed("n", "_n"), F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("n") == F.col("_n")))
    near = near.where(distance(F.col("of_window"), F.col("of_item")) <= RADIUS).select("n", "window", "item_id", "item")
    alike = near.join(prints.select("n", "window", F.col("counted").alias("text")), ["n", "window"]).withColumn("similarity", similarity(F.col("text"), F.col("item")))
    return found, alike.where(F.col("similarity") >= share - 1e-12).select("n", "window", "item_id", "similarity").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity, start and n_words of the best window for every item that a document holds."""
    found, alike = _alike(docs, benchmark, share)
    pairs = found.select("doc_id", "start", "n", "window").join(alike, ["n", "window"])
    best = pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"), F.col("n").alias("n_words"))).alias("best"))
    return best.select("doc_id", "item_id", "best.similarity", (-F.col("best.before")).cast("long").alias("start"), F.col("best.n_words").cast("long").alias("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item, told apart by doc_id and text, so that null ids are no one document."""
    key = F.xxhash64("doc_id", "text")
    found, alike = _alike(docs.select(key.alias("doc_id"), "text"), benchmark, SIMILARITY)
    found = found.select(F.col("doc_id").alias("_leak"), "n", "window").join(alike, ["n", "window"], "left_semi").select("_leak").distinct()
    return docs.join(found, key == F.col("_leak"), "left_anti").select(*docs.columns)
