"""Line dedup by deletion neighbourhoods.

A line repeats an earlier one if their words (A-Z lowered, split at ASCII white space) differ by at
most one word left out, put in or exchanged. Of a line of fewer than min_words words (MIN_WORDS unless given) one
word is too large a share (any two lines of one word would be alike), so the bound is zero for these: they repeat a line
that has just their words. With min_words 1 the bound holds for lines of any length. Lines without words, such as blank ones, are never touched.
Lines are ordered by (doc_id, line number), and every line that repeats an earlier one goes, so the
earliest stays.

Equal lines are found by a 128-bit hash with partial aggregation. For the distinct ones the hashes of
all variants within the bound are emitted: the line itself, and the line without its i-th word for
each i. Two lines that agree without their i-th words differ in that word alone; a line that equals
another without one of its words is that line with a word left out. So each variant key only has to
tell its earliest line, again by partial aggregation: a key of any size costs no pairs. The links from
each line to these earliest ones are verified by their word-level edit distance.

Before the variants are emitted, lines without any possible partner are left out by a lossless test:
of two lines within the bound, of which the longer has N words, one changed word leaves either the
first or the last (N - 1) // 2 words as they are, so a line has to share one of these runs with
another distinct line, for N its own number of words or one more.

Cases: null or empty text has no lines to touch and stays as it is; rows with equal doc_id and text are
one document and get the same result; null ids order first; a document whose lines all go is left with
an empty text; an empty table stays empty; other columns are carried along, of whatever names, but for
n_lines, n_dropped and n_near, which the result replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import cut, small, with_rest
from quillstone.llm.wordhash import mix, word_hashes

#: Lines of fewer words have to be equal, unless another number is given.
MIN_WORDS = 5
_M = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_M), -1, 2**64))


def line_words(line: bytes) -> list[bytes]:
    return line.lower().split()


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _M, np.uint64))


def _hash_of(h: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of a sequence of word hashes."""
    with np.errstate(over="ignore"):
        p = _powers(len(h))
        return np.array([(h * p).sum(dtype=np.uint64), (mix(h + _M) * p).sum(dtype=np.uint64)], np.uint64)


def deletions(h: np.ndarray) -> np.ndarray:
    """_hash_of the sequence without its i-th word, for each i: a row of two hashes each."""
    with np.errstate(over="ignore"):
        p = _powers(len(h))
        out = []
        for v in (h, mix(h + _M)):
            before = np.cumsum(np.r_[np.uint64(0), v * p])[:-1]
            after = np.cumsum(np.r_[np.uint64(0), (v[1:] * p[:-1])[::-1]])[::-1]
            out.append(before + after)
        return np.stack(out, 1)


def edit_distance_within_one(a: list, b: list) -> bool:
    """Whether two word sequences differ by at most one insertion, deletion or exchange."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = len(a) > len(b) or len(a) == len(b)
    k = len(b) > len(a) or len(a) == len(b)
    return a[i + j :] == b[i + k :]


def _split(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def _line_keys(lines: list[list[bytes]]) -> list[np.ndarray]:
    """Of each line two hashes, and four of the runs that the test compares."""
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    h = word_hashes([w for x in lines for w in x])
    end = np.cumsum(n)
    start = end - n
    with np.errstate(over="ignore"):
        p, back = _powers(int(n.max())), np.cumprod(np.full(int(n.max()) + 1, _INVERSE, np.uint64))
        inside = np.arange(len(h)) - np.repeat(start, n)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * p[inside])))
        out = [total[end] - total[start], np.add.reduceat(mix(h + _M) * p[inside], start)]
        for longer in (n, n + 1):
            run = (longer - 1) // 2
            first = total[start + run] - total[start]
            last = (total[end] - total[end - run]) * np.where(run < n, back[np.maximum(n - run - 1, 0)], np.uint64(1))
            seed = longer.astype(np.uint64) * np.uint64(2)
            out += [mix(first + mix(seed)), mix(last + mix(seed + np.uint64(1)))]
    return [x.astype(np.int64) for x in out]


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each line that may be touched: doc_id, text_hash, line, its hashes h1 and h2, and runs (null under min_words)."""
    names = ["doc_id", "text_hash", "line", "h1", "h2", "a", "b", "c", "d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list] = [[], [], [], []]
            size = 0
            for i in range(batch.num_rows):
                t = batch.column(2)[i].as_py()
                for j, line in enumerate(t.encode("utf-8", "surrogatepass").split(b"\n") if t else ()):
                    w = line_words(line)
                    if w:
                        for c, v in zip(held, (i, j, w)):
                            c.append(v)
                size += len(t or "")
                if held[0] and (size > 500_000 or i == batch.num_rows - 1):
                    at, keys, whole = pa.array(held[0]), _line_keys(held[2]), np.fromiter((len(w) < min_words for w in held[2]), bool, len(held[2]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(held[1], pa.int32()), *map(pa.array, keys[:2]), *[pa.array(k, mask=whole) for k in keys[2:]]], names)
                    held, size = [[], [], [], []], 0

    return _split(docs).mapInArrow(run, "doc_id long, text_hash long, line int, h1 long, h2 long, a long, b long, c long, d long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """pos and words (joined by spaces) of the wanted lines (doc_id, text_hash, lines)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lines, words = [], [], []
            for i in range(batch.num_rows):
                split = batch.column(2)[i].as_py().encode("utf-8", "surrogatepass").split(b"\n")
                for j in batch.column(3)[i].as_py():
                    at.append(i)
                    lines.append(j)
                    words.append(b" ".join(line_words(split[j])))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), batch.column(1).take(pa.array(at, pa.int64())), pa.array(lines, pa.int32()), pa.array(words, pa.binary())], ["doc_id", "text_hash", "line", "words"])

    d, w = _split(docs), wanted
    joined = d.join(w, d.doc_id.eqNullSafe(w.doc_id) & (d.text_hash == w.text_hash)).select(d.doc_id, d.text_hash, "text", "lines")
    out = joined.mapInArrow(run, "doc_id long, text_hash long, line int, words binary")
    return out.groupBy(F.struct("doc_id", "text_hash", "line").alias("pos")).agg(F.min("words").alias("words"))


def _variants(texts: DataFrame) -> DataFrame:
    """A row for each variant: h1, h2, gone (the word left out, -1: none) and the line's pos."""
    names = ["h1", "h2", "gone", "doc_id", "text_hash", "line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, rows = [], 0
            first = 0
            for i in range(batch.num_rows):
                h = word_hashes(batch.column(3)[i].as_py().split(b" "))
                held.append(np.concatenate((_hash_of(h)[None], deletions(h))).astype(np.int64))
                rows += len(h) + 1
                if rows > 50_000 or i == batch.num_rows - 1:
                    v, sizes = np.concatenate(held), [len(x) for x in held]
                    at = pa.array(np.repeat(np.arange(first, i + 1), sizes))
                    gone = pa.array(np.concatenate([np.arange(-1, n - 1) for n in sizes]), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(v[:, 0]), pa.array(v[:, 1]), gone, *[batch.column(c).take(at) for c in range(3)]], names)
                    held, rows, first = [], 0, i + 1

    rows = texts.select("pos.*", "words").mapInArrow(run, "h1 long, h2 long, gone int, doc_id long, text_hash long, line int")
    return rows.select("h1", "h2", "gone", F.struct("doc_id", "text_hash", "line").alias("pos"))


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The later lines (pos) of those pairs (earlier, pos) whose edit distance is in bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = [edit_distance_within_one(a.as_py().split(b" "), b.as_py().split(b" ")) for a, b in zip(batch.column(3), batch.column(4))]
            yield batch.select([0, 1, 2]).filter(pa.array(fine, pa.bool_()))

    t = texts.select(F.col("pos").alias("earlier"), F.col("words").alias("a"))
    both = pairs.join(t, "earlier").join(texts.select("pos", F.col("words").alias("b")), "pos")
    return both.select("pos.*", "a", "b").mapInArrow(run, "doc_id long, text_hash long, line int")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash and line of the lines that repeat an earlier one, and near: whether only nearly."""
    lines = cut(_lines(docs, min_words))
    keys, runs = ["h1", "h2"], ["a", "b", "c", "d"]
    pos = F.struct("doc_id", "text_hash", "line")
    distinct = cut(lines.groupBy(*keys).agg(F.min(pos).alias("pos"), F.count("*").alias("times"), *[F.min(c).alias(c) for c in runs]))
    several = distinct.where("times > 1").select(*keys, F.col("pos").alias("earlier"))
    equal = lines.select(*keys, pos.alias("pos")).join(small(several), keys).where(F.col("pos") != F.col("earlier")).select("pos.*", F.lit(False).alias("near"))
    run = distinct.where("a is not null").select(F.col("h1").alias("of"), "pos", F.explode(F.array(*runs)).alias("run"))
    shared = cut(run.groupBy("run").agg(F.min("of").alias("least"), F.max("of").alias("most")).where("least < most").select("run"))
    gated = run.join(small(shared), "run", "left_semi").select("pos").distinct()
    wanted = cut(gated.groupBy("pos.doc_id", "pos.text_hash").agg(F.collect_list("pos.line").alias("lines")))
    texts = cut(_texts(docs, small(wanted)))
    variants = cut(_variants(texts))
    whole = F.col("gone") < 0
    least = variants.groupBy(*keys, "gone").agg(F.min("pos").alias("least"), F.max("pos").alias("most"))
    # for each hash: the line that is it, and the earliest that becomes it by leaving out a word
    by_hash = least.groupBy(*keys).agg(F.min(F.when(whole, F.col("least"))).alias("line"), F.min(F.when(~whole, F.col("least"))).alias("longer"))
    longer = cut(by_hash.where("line is not null and longer is not null"))
    exchanged = cut(least.where(~whole & (F.col("least") < F.col("most"))).select(*keys, "gone", F.col("least").alias("earlier")))
    by_gone = variants.join(small(exchanged), [*keys, "gone"]).where(F.col("earlier") < F.col("pos")).select("earlier", "pos")
    shorter = variants.where(~whole).join(small(longer.select(*keys, F.col("line").alias("earlier"))), keys).where(F.col("earlier") < F.col("pos")).select("earlier", "pos")
    itself = longer.where(F.col("longer") < F.col("line")).select(F.col("longer").alias("earlier"), F.col("line").alias("pos"))
    pairs = by_gone.union(shorter).union(itself).distinct()
    # a distinct line that nearly repeats goes; its equals went already
    near = _verify(pairs, texts).distinct()
    return equal.union(near.withColumn("near", F.lit(True)))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text less the repeated lines, and n_lines, n_dropped and n_near, which replace columns of these names."""
    return with_rest(docs, ("doc_id", "text"), lambda d: _dedup(d, min_words), ("n_lines", "n_dropped", "n_near"))


def _dedup(docs: DataFrame, min_words: int) -> DataFrame:
    # a set, as rows repeated as a whole name each of their lines once a row
    gone = cut(repeated_lines(docs, min_words).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set(F.struct("line", "near")).alias("_gone")))
    d = docs.withColumn("_text_hash", F.xxhash64("text"))
    joined = d.join(small(gone), F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left")
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone.line"))
    rest = F.get(F.transform(F.array(lines), lambda x: F.array_join(F.transform(kept, lambda i: F.get(x, i)), "\n")), F.lit(0))
    counts = {
        "n_lines": F.when(F.length("text") > 0, F.size(lines)).otherwise(0).cast("int"),
        "n_dropped": F.coalesce(F.size("_gone"), F.lit(0)).cast("int"), "n_near": F.coalesce(F.size(F.filter("_gone", lambda x: x["near"])), F.lit(0)).cast("int"),
    }
    out = joined.withColumns(counts).withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(rest))
    return out.drop("_text_hash", "_id", "_hash", "_gone")
