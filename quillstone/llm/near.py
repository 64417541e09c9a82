"""Near-duplicate documents by b-bit MinHash.

A document's set are its distinct SIZE-word shingles (A-Z lowered, words split at ASCII white space).
Documents with one and the same set form a class, which goes on as its smallest doc_id. For the
classes, MinHash minima are cut into bands, whose hashes deal the classes into buckets, and only the low
BITS bits of every minimum are kept, packed. Members of a bucket are candidates; for a pair of these the
similarity is estimated from the count of equal packed values, corrected for chance collisions, and pairs
whose estimate comes near the threshold are confirmed on their full sets. What is returned is a forest of
confirmed links with the same components as all links between members.

As only components count, pairs that are already joined are left out. First every member meets the
smallest one of each of its buckets, of which the most alike is confirmed first: so many pairs a member
as it has bands at most, however large the buckets. That settles buckets of two, and those that have come
to lie in one component. What is left, members of larger buckets that lie in several, is put into groups
of connected buckets, and there all candidate pairs that no links join yet are looked into. Groups are
dealt to tasks of a bounded size: small groups share one, a large group is split into chunks and every two
chunks meet in a task of their own. Nothing is capped. Two documents at the threshold meet in no band with
a probability below 1e-6 (see bands()), and the margin on estimates is MARGIN standard deviations.

Cases: null or blank text has an empty set and links with nothing; a null doc_id takes no part and is
its own, kept; rows that share a doc_id are one node, whatever their texts; fewer words than SIZE make
one shingle of the whole sequence; an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import LINKS, connected_components, cut, join_hubs, small, tasks_of
from quillstone.llm.wordhash import mix, shingles

SIZE = 5
BITS = 4
MARGIN = 5.5
#: Shingles that a task holds of each of two chunks, about, 8 bytes each; and as how many a document counts besides its own.
CHUNK, ROW = 1_000_000, 200
#: Documents, and pairs with both their sets, that one partition holds: steps are dealt to as many tasks as their rows need, however many partitions the input or a shuffle has.
DOCS, PAIRS = 20_000, 500

_FEATURES = "doc_id long, n long, f1 long, f2 long, bands array<long>, sig binary"
_SAME = ["n", "f1", "f2"]


def bands(percent: int) -> tuple[int, int]:
    """(bands, rows): the most rows with which 40 bands miss a pair at the threshold less than once in a million."""
    rows = max([r for r in range(1, 13) if (1 - (percent / 100) ** r) ** 40 < 1e-6], default=1)
    return 40, rows


def set_of(text: str | None, size: int = SIZE) -> np.ndarray:
    return shingles((text or "").encode("utf-8", "surrogatepass").lower().split(), size)


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**31, count).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, count).astype(np.uint32)


def minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each permutation over the set's upper 32 bits."""
    x, out = (s >> np.uint64(32)).astype(np.uint32), np.full(len(a), 2**32 - 1, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 1024):
            out = np.minimum(out, (a[:, None] * x[None, i : i + 1024] + b[:, None]).min(1))
    return out


def _band_hashes(m: np.ndarray, count: int, rows: int) -> np.ndarray:
    """A hash for each of the count bands of so many minima."""
    odd = np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    with np.errstate(over="ignore"):
        v = (m.reshape(count, rows).astype(np.uint64) * odd).sum(1, dtype=np.uint64)
        return mix(v + np.arange(count, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).astype(np.int64)


def signature(m: np.ndarray) -> bytes:
    """The low BITS bits of each minimum, two to a byte, padded to whole 8 bytes with zeros."""
    low = (m & np.uint32(2**BITS - 1)).astype(np.uint8)
    low = np.r_[low, np.zeros(-len(low) % 16, np.uint8)]
    return (low[::2] | low[1::2] << np.uint8(4)).tobytes()


def estimates(sig: np.ndarray, others: np.ndarray, count: int) -> np.ndarray:
    """Similarity of a signature (uint64 words) with others, from count packed values."""
    x = others ^ sig
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    unlike = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(1, dtype=np.int64)
    chance = 2.0**-BITS
    return ((count - unlike) / count - chance) / (1 - chance)


def lowest(percent: int, count: int) -> float:
    """The estimate below which a pair at the threshold falls MARGIN standard deviations off."""
    chance = 2.0**-BITS
    p = percent / 100 + (1 - percent / 100) * chance
    return percent / 100 - MARGIN * math.sqrt(p * (1 - p) / count) / (1 - chance)


class Chunk:
    def __init__(self, ids: np.ndarray, joined: np.ndarray, bands_: np.ndarray, sigs: list[bytes], sets: list[np.ndarray]):
        self.ids, self.joined, self.bands = ids, joined, bands_.reshape(len(ids), -1)
        self.sigs = np.frombuffer(b"".join(sigs), np.uint64).reshape(len(ids), -1)
        self.size = np.fromiter(map(len, sets), np.int64, len(ids))
        self.values = np.concatenate(sets)


class Joined:
    """Labels of rows under unions; the smaller side takes the larger one's label, so a row changes its own rarely."""

    def __init__(self, labels: np.ndarray):
        self.label = np.unique(labels, return_inverse=True)[1]
        order = np.argsort(self.label, kind="stable")
        self.rows = np.split(order, np.flatnonzero(np.diff(self.label[order])) + 1)

    def union(self, x: int, others: np.ndarray) -> None:
        for other in np.unique(self.label[others]).tolist():
            mine = int(self.label[x])
            if other != mine:
                big, little = (mine, other) if len(self.rows[mine]) >= len(self.rows[other]) else (other, mine)
                self.label[self.rows[little]] = big
                self.rows[big] = np.concatenate((self.rows[big], self.rows[little]))


def confirm(left: Chunk, right: Chunk | None, percent: int, count: int) -> list[tuple[int, int]]:
    """(id, smallest id joined with it) for the links between two chunks, or within one, beyond those that join them already."""
    n = len(left.ids)
    parts = [left] if right is None else [left, right]
    ids, sigs, size, bands_ = (np.concatenate([getattr(c, k) for c in parts]) for k in ("ids", "sigs", "size", "bands"))
    values, codes = np.unique(np.concatenate([c.values for c in parts]), return_inverse=True)
    start = np.cumsum(size) - size
    group = Joined(np.concatenate([c.joined for c in parts]))
    low, marked, touched = lowest(percent, count), np.zeros(len(values), bool), False
    for x in range(n):
        lo = x + 1 if right is None else n
        s, t = size[x], size[lo:]
        open_ = np.flatnonzero((group.label[lo:] != group.label[x]) & (100 * np.minimum(s, t) >= percent * np.maximum(s, t))) + lo
        open_ = open_[(bands_[open_] == bands_[x]).any(1)]
        open_ = open_[estimates(sigs[x], sigs[open_], count) >= low]
        if not len(open_):
            continue
        mine = codes[start[x] : start[x] + s]
        marked[mine] = True
        before = np.cumsum(size[open_]) - size[open_]
        at = np.repeat(start[open_] - before, size[open_]) + np.arange(size[open_].sum())
        both = np.add.reduceat(marked[codes[at]].astype(np.int64), before)
        marked[mine] = False
        linked = open_[100 * both >= percent * (s + size[open_] - both)]
        if len(linked):
            group.union(x, linked)
            touched = True
    if not touched:
        return []
    order = np.lexsort((ids, group.label))
    label = group.label[order]
    first = np.r_[True, label[1:] != label[:-1]]
    least = ids[order][np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))]
    return [(int(i), int(m)) for i, m in zip(ids[order], least) if i != m]


def features(docs: DataFrame, percent: int, size: int = SIZE) -> DataFrame:
    """_FEATURES of each row: the set's size and 128-bit fingerprint, its band hashes and its packed signature."""
    count, rows = bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations(count * rows)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text in batch.column(1):
                s = set_of(text.as_py(), size)
                f, keys, sig = (0, 0), None, None
                if len(s):
                    with np.errstate(over="ignore"):
                        m = minima(s, a, b)
                        keys = _band_hashes(m, count, rows)
                        f = int(s.sum(dtype=np.uint64).astype(np.int64)), int(mix(s + np.uint64(1)).sum(dtype=np.uint64).astype(np.int64))
                        sig = signature(m)
                for c, v in zip(out, (len(s), *f, keys, sig)):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(out, kinds)]], ["doc_id", "n", "f1", "f2", "bands", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _FEATURES)


def _sets(rows: DataFrame, percent: int, size: int) -> DataFrame:
    """Of rows (id, joined, part, text) the sets, band hashes and packed signatures, in place of the text."""
    count, per_band = bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations(count * per_band)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [set_of(t.as_py(), size) for t in part.column(3)]
                least = [minima(s, a, b) for s in sets]
                columns = [pa.array([_band_hashes(m, count, per_band) for m in least], pa.list_(pa.int64())), pa.array(map(signature, least), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(3)], *columns], ["id", "joined", "group", "bands", "sig", "set"])

    return rows.mapInArrow(run, "id long, joined long, group long, bands array<long>, sig binary, set binary")


def _texts(docs: DataFrame, ids: DataFrame, repeats: DataFrame) -> DataFrame:
    """id and text of the ids; texts that rows of one doc_id repeat come once."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(small(ids), "id")
    r = small(repeats)
    return texts.join(r, "id", "left_anti").unionByName(texts.join(r, "id", "left_semi").distinct())


def likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, sig_a, sig_b) those whose estimate comes near the threshold: a, b, estimate."""
    count, low = math.prod(bands(percent)), lowest(percent, math.prod(bands(percent)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in (2, 3))
                e = estimates(x, y, count)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(e)], ["a", "b", "estimate"]).filter(pa.array(e >= low))

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, estimate double")


def confirmed(pairs: DataFrame, docs: DataFrame, repeats: DataFrame, percent: int, size: int) -> DataFrame:
    """Of materialised pairs (a, b) of doc_ids those that the full sets confirm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [set_of(t.as_py(), size).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "set"])

    n = pairs.count()
    parts = 1 + n // PAIRS
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().coalesce(1 + n // LINKS))
    sets = cut(_texts(docs, ids, repeats).mapInArrow(run, "id long, set array<long>"))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").coalesce(parts)
    both = join_hubs(both, sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b", pairs).coalesce(parts)
    common = F.size(F.array_intersect("set_a", "set_b"))
    counted = both.select("a", "b", common.alias("i"), (F.size("set_a") + F.size("set_b")).alias("m"))
    return cut(counted.where(100 * F.col("i") >= percent * (F.col("m") - F.col("i"))).select("a", "b").distinct().coalesce(1 + n // LINKS))


def components(docs: DataFrame, percent: int = 85, size: int = SIZE) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_shingles, component_id, kept."""
    feats = cut(features(docs, percent, size))
    rows = feats.coalesce(tasks_of(feats.sparkSession)).count()
    parts, wide = 1 + rows // DOCS, 1 + rows * bands(percent)[0] // LINKS
    feats = feats.coalesce(parts)
    alive = feats.where("n > 0 and doc_id is not null")
    classes = cut(alive.groupBy(*_SAME).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig")).coalesce(parts)).coalesce(parts)
    # rows of one doc_id are one node: their classes hang together
    repeats = cut(alive.groupBy(F.col("doc_id").alias("id")).count().where("count > 1").select("id").coalesce(parts))
    shared = alive.join(small(repeats), alive.doc_id == repeats.id).join(classes.select(*_SAME, "rep"), _SAME).where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct().coalesce(parts)
    # every member of a bucket with its smallest one
    buckets = classes.select("rep", F.explode("bands").alias("band"))
    live = cut(buckets.groupBy("band").agg(F.min("rep").alias("least"), F.max("rep").alias("most"), F.count("*").alias("n")).where("least < most").select("band", "least", "n").coalesce(wide))
    stars = cut(buckets.join(small(live), "band").where("rep != least").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct().coalesce(wide))
    sigs = lambda x: classes.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}"))
    signed = join_hubs(stars.join(sigs("a"), "a").coalesce(wide), sigs("b"), "b", stars).coalesce(wide)
    alike = cut(likely(signed, percent).groupBy("a", "b").agg(F.max("estimate").alias("estimate")).coalesce(wide))
    best = cut(alike.groupBy("a").agg(F.max_by("b", F.struct("estimate", -F.col("b"))).alias("b")).coalesce(parts))
    links = confirmed(best, docs, repeats, percent, size).union(shared)
    joined = cut(connected_components(links))
    root = lambda df, x: df.join(small(joined.select(F.col("node").alias(x), F.col("root").alias(f"_root_{x}"))), x, "left").withColumn(f"root_{x}", F.coalesce(f"_root_{x}", x)).drop(f"_root_{x}")
    # members of buckets that still lie in several components: of two members (here the alike ones that were not confirmed), or of more
    apart = root(root(alike.join(best, ["a", "b"], "left_anti").coalesce(wide), "a"), "b").where("root_a <> root_b")
    apart = apart.select(F.inline(F.array(F.struct(F.col("a").alias("rep"), F.col("root_a").alias("root"), F.col("root_b").alias("least")), F.struct(F.col("b").alias("rep"), F.col("root_b").alias("root"), F.col("root_b").alias("least")))))
    placed = cut(root(buckets.join(small(cut(live.where("n > 2").select("band"))), "band"), "rep").select("band", "rep", F.col("root_rep").alias("root")))
    open_ = cut(placed.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("band", "least").coalesce(wide))
    inside = cut(placed.join(small(open_), "band").select("rep", "root", "least").union(apart).distinct().coalesce(wide))
    if inside.count():
        more = cut(_within(docs, feats, inside, repeats, percent, size))
        joined = cut(connected_components(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)))
    reps = classes.join(joined, classes.rep == joined.node, "left").select(*_SAME, F.coalesce("root", "rep").alias("component_id"))
    full = feats.select("doc_id", *_SAME).join(reps, _SAME, "left").coalesce(parts)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return full.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _within(docs: DataFrame, feats: DataFrame, inside: DataFrame, repeats: DataFrame, percent: int, size: int) -> DataFrame:
    """Confirmed links between members (rep) of different components (root), each of a bucket whose smallest root is least."""
    parts = 1 + inside.count() // LINKS
    groups = cut(connected_components(inside.select(F.col("root").alias("a"), F.col("least").alias("b")).distinct()))
    ids = inside.select(F.col("rep").alias("id"), "root").distinct().join(small(groups.select(F.col("node").alias("root"), F.col("root").alias("group"))), "root")
    sizes = feats.where("n > 0").groupBy(F.col("doc_id").alias("id")).agg((F.sum("n") + ROW * F.count("*")).alias("weight"))
    members = cut(ids.join(sizes, "id").select("id", F.col("root").alias("joined"), "group", "weight").coalesce(parts))
    weight = cut(members.groupBy("group").agg(F.ceil(F.sum("weight") / CHUNK).cast("int").alias("chunks")).coalesce(parts))
    tasks = max(1, math.ceil(members.select(F.sum("weight")).first()[0] / CHUNK))
    rows = _texts(docs, members.select("id", "joined", "group"), repeats).select("id", "joined", "group", "text")
    sets = _sets(rows, percent, size).join(small(weight), "group")
    mine = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    place = F.when(F.col("chunks") == 1, F.array(F.struct(F.pmod(F.xxhash64("group"), F.lit(tasks)).alias("key"), F.lit(-1).alias("part"), F.lit(0).alias("side")))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("chunks") - 1),
            lambda j: F.struct(F.col("group").alias("key"), (F.least(mine, j) * F.col("chunks") + F.greatest(mine, j)).cast("int").alias("part"), F.when(mine <= j, 0).otherwise(1).alias("side")),
        )
    )
    dealt = sets.withColumn("place", F.explode(place)).select("place.key", "place.part", "place.side", "group", "joined", "id", "bands", "sig", "set")
    count = math.prod(bands(percent))

    def chunk(t: pa.Table) -> Chunk:
        id_, joined = (t.column(c).to_numpy() for c in ("id", "joined"))
        return Chunk(id_, joined, np.array(t.column("bands").to_pylist(), np.int64), t.column("sig").to_pylist(), [np.frombuffer(s, np.uint64) for s in t.column("set").to_pylist()])

    def look(t: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        group, side, ids_ = (t.column(c).to_numpy() for c in ("group", "side", "id"))
        order = np.lexsort((ids_, side, group))
        cuts = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1], True]) if len(order) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            sides = [order[a:b][side[order[a:b]] == s] for s in (0, 1)]
            chunks = [chunk(t.take(pa.array(at))) for at in sides if len(at)]
            out += confirm(chunks[0], chunks[1] if len(chunks) == 2 else None, percent, count)
        return pa.table([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return dealt.groupBy("key", "part").applyInArrow(look, "a long, b long")


def dedup(docs: DataFrame, percent: int = 80, size: int = SIZE) -> DataFrame:
    """docs without the documents that are not the first of their component."""
    gone = components(docs, percent, size).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
