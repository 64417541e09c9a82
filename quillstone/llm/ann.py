"""Nearest neighbours by inner product, from randomly rotated one-bit codes.

The index holds every vector once: less a common centre (the mean of about SAMPLE rows, picked by hash),
turned by a random rotation (padded with zeros to whole 64-bit words) and reduced to the signs of its
coordinates, one bit for each, packed; with two scalars, the length of the centred vector and the inner
product of its direction with its code. A query is turned alike and rounded to QUERY_BITS bits a
coordinate, one packed plane for each; its inner product with a code is then a weighted sum of bit counts
of the code and a plane, and with the scalars an estimate of that with the vector, whose error stays
within EPSILON standard units with high probability. For a query, the best FIRST estimates of a block are
scored on the original vectors; the k-th of these scores and the error bounds tell which other vectors
could still be among the nearest, and just those are scored too.

Codes are built once, in the rows' own partitions. Queries and vectors are dealt by hash into blocks of
bounded size and every block of queries meets every block of vectors; a pair of blocks gives k rows for
each query, of which the best k stay. Scores are sums in double precision in the order of the coordinates.

Cases: vectors that are null, zero, empty, or hold null or non-finite components take no part; null ids
take no part; rows are told apart even where they share a vec_id: each but the query's own is a candidate,
and each with a query's id is a query with ranks of its own; vectors compare only with those of as many
dimensions; equal scores rank by vec_id; without candidates a query has no rows; an empty table has no
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import cut

K = 20
QUERY_BITS = 6
EPSILON = 1.9
#: Rows whose mean is the centre, about.
SAMPLE = 10_000
#: Vectors and bytes of vectors in a block, and queries in one.
VECTORS, BYTES, QUERIES = 8_192, 16 << 20, 4_096
FIRST = 64
RESULT = "query_row long, query_id long, vec_id long, score double"
_INDEX = "row long, id long, dims int, x array<{}>, code binary, length double, along double"
_rotations: dict[int, np.ndarray] = {}


def bits(dims: int) -> int:
    return 64 * math.ceil(dims / 64)


def rotation(dims: int) -> np.ndarray:
    """A random rotation into bits(dims) dimensions: a matrix with orthonormal columns, the same everywhere."""
    if dims not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((bits(dims), dims)))
        _rotations[dims] = q * np.sign(np.diag(r))
    return _rotations[dims]


def encode(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes (uint64 words), lengths, and inner products of directions with their codes."""
    centred = x - centre
    length = np.linalg.norm(centred, axis=1)
    turned = np.divide(centred, length[:, None], out=np.zeros_like(centred), where=length[:, None] > 0) @ rotation(x.shape[1]).T
    return np.packbits(turned > 0, axis=1).view(np.uint64), length, np.abs(turned).sum(1) / math.sqrt(turned.shape[1])


class Block:
    """Indexed vectors by ascending id: rows, ids, vectors, codes and scalars."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, length: np.ndarray, along: np.ndarray, centre: np.ndarray, k: int):
        order = np.lexsort((rows, ids))
        # of equal vectors, all but the k + 1 smallest ids can be nobody's nearest
        _, same = np.unique(np.ascontiguousarray(x[order]).view(f"V{x.shape[1] * 8}").ravel(), return_inverse=True)
        by = np.argsort(same, kind="stable")
        first = np.flatnonzero(np.r_[True, same[by][1:] != same[by][:-1]])
        nth = np.empty(len(ids), np.int64)
        nth[by] = np.arange(len(ids)) - np.repeat(first, np.diff(np.r_[first, len(ids)]))
        order = order[nth <= k]
        self.rows, self.ids, self.x, self.codes, self.length = rows[order], ids[order], x[order], codes[order], length[order]
        self.centre, self.bits = centre, 64 * codes.shape[1]
        along = np.maximum(along[order], 1e-6)
        self.scale = self.length / along / math.sqrt(self.bits)
        self.ones = np.bitwise_count(self.codes).sum(1, dtype=np.int64)
        self.error = EPSILON * self.length * np.sqrt(np.maximum(1 - along**2, 0)) / along / math.sqrt(self.bits - 1)
        self.scored = 0

    def estimates(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of a query with all vectors, from bit counts, and the bounds of their errors."""
        turned = rotation(len(q)) @ q
        low = turned.min()
        step = max((turned.max() - low) / (2**QUERY_BITS - 1), 1e-300)
        levels = np.rint((turned - low) / step).astype(np.uint8)
        inner = np.zeros(len(self.ids), np.int64)
        for b in range(QUERY_BITS):
            plane = np.packbits(levels >> b & 1).view(np.uint64)
            inner += np.bitwise_count(self.codes & plane).sum(1, dtype=np.int64) << b
        total = low * self.bits + step * float(levels.sum())
        product = 2 * (low * self.ones + step * inner) - total
        size = float(np.linalg.norm(q))
        bound = self.error * size + EPSILON * step / math.sqrt(12) * self.scale * math.sqrt(self.bits) + 1e-9 * size * (1 + self.length)
        return float(self.centre @ q) + product * self.scale, bound

    def exact(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at))
        for d, v in enumerate(q.tolist()):
            out += v * self.x[at, d]
        return out

    def nearest(self, rows: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[list, list, list, list]:
        """Of each query: its row and id, and the ids and scores of the k nearest."""
        found: tuple[list, list, list, list] = ([], [], [], [])
        for i in range(len(q)):
            e, bound = self.estimates(q[i])
            e[self.rows == rows[i]] = -np.inf
            best = np.argpartition(-e, FIRST)[:FIRST] if len(e) > FIRST else np.arange(len(e))
            best = best[np.isfinite(e[best])]
            rough = self.x[best] @ q[i]
            if len(e) > FIRST and len(best) >= k:
                e[best] = -np.inf
                more = np.flatnonzero(e + bound >= np.partition(rough, len(rough) - k)[len(rough) - k])
                best, rough = np.r_[best, more], np.r_[rough, self.x[more] @ q[i]]
            self.scored += len(best)
            if len(best) > k:  # sums in another order differ by less than this
                near = 1e-12 * (1 + float(np.abs(rough).max()) + float(np.abs(q[i]).sum() * np.abs(self.x[best]).max()))
                best = best[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - near]
            scores = self.exact(q[i], best)
            order = np.lexsort((self.ids[best], -scores))[:k]
            for c, v in zip(found, (np.full(len(order), rows[i]), np.full(len(order), ids[i]), self.ids[best[order]], scores[order])):
                c.append(v)
        return found


def _matrix(t: pa.Table | pa.RecordBatch, column: str) -> np.ndarray:
    x = t.column(column)
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in (x.chunks if isinstance(x, pa.ChunkedArray) else [x])]
    return np.concatenate(flat).astype(np.float64).reshape(t.num_rows, -1)


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """row (a number of its own), id, x and dims of the rows that take part."""
    kind = vectors.select(f"`{vector_col}`").schema[0].dataType.elementType.simpleString()
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast(f"array<{'float' if kind == 'float' else 'double'}>").alias("x")).where("id is not null and x is not null")
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("x", lambda c: c != 0)
    return cut(v.where(F.coalesce(fine, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), "id", F.size("x").alias("dims"), "x"))


def centres(rows: DataFrame, n: int) -> dict[int, np.ndarray]:
    """By dims, the mean of about SAMPLE rows; zero for dims that the sample misses."""
    some = rows.where(F.pmod(F.xxhash64("id", "row"), F.lit(max(1, n // SAMPLE))) == 0)
    means = some.select("dims", F.posexplode("x").alias("at", "c")).groupBy("dims", "at").agg(F.avg("c").alias("c")).collect()  # as many as a sample row has components
    out: dict[int, np.ndarray] = {}
    for r in means:
        out.setdefault(r["dims"], np.zeros(r["dims"]))[r["at"]] = r["c"]
    return out


def index(rows: DataFrame, centre: dict[int, np.ndarray]) -> DataFrame:
    """rows with code, length and along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                codes, length, along = encode(_matrix(part, "x"), centre.get(d, np.zeros(d)))
                columns = [part.column(c) for c in ("row", "id", "dims", "x")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(along)], ["row", "id", "dims", "x", "code", "length", "along"])

    return rows.select("row", "id", "dims", "x").mapInArrow(run, _INDEX.format(rows.schema["x"].dataType.elementType.simpleString()))


def search(vectors: DataFrame, is_query: str, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row for which is_query (SQL over id) holds: query_id, rank from 1, vec_id, score."""
    rows = valid(vectors, id_col, vector_col)
    n, n_queries, n_bytes = rows.select(F.count("*"), F.count_if(F.expr(is_query)), F.coalesce(8 * F.sum("dims"), F.lit(0))).first()
    blocks, asked = max(1, math.ceil(n / VECTORS), math.ceil(n_bytes / BYTES)), max(1, math.ceil(n_queries / QUERIES))
    centre = centres(rows, n)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    data = index(rows, centre).select("*", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")).select("*", every(asked).alias("ask"))
    queries = rows.where(is_query).select("dims", every(blocks).alias("block"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(asked)).cast("int").alias("ask"), "row", "id", "x")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        columns: tuple = ([], [], [], [])
        if left.num_rows and right.num_rows:
            d = left.column("dims")[0].as_py()
            codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint64).reshape(left.num_rows, -1)
            parts = [left.column(c).to_numpy() for c in ("row", "id", "length", "along")]
            block = Block(parts[0], parts[1], _matrix(left, "x"), codes, parts[2], parts[3], centre.get(d, np.zeros(d)), k)
            columns = block.nearest(right.column("row").to_numpy(), right.column("id").to_numpy(), _matrix(right, "x"), k)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(columns, kinds)], ["query_row", "query_id", "vec_id", "score"])

    keys = ["dims", "block", "ask"]
    found = data.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(meet, RESULT)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
