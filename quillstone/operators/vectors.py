"""Exact vector search with cosine scores, and keyed upserts of points."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions.text import deterministic_id, embedding_text
from quillstone.lineage import spread

#: Fixed value: the text before a name whose hash is its id.
NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
EMBED_BATCH = 50
#: Queries in a block, and vectors and bytes of vectors in one.
QUERY_BLOCK, POINT_BLOCK, BYTES = 10_000, 65_536, 32 << 20
#: Vectors and queries that are multiplied at once, and by how much a rough score may fall short of one that ranks.
_POINTS, _QUERIES, _MARGIN = 4_096, 512, 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is null or zero, or their sizes differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def valid_points(points: DataFrame, dim: int, vector: str = "vector") -> DataFrame:
    """V1: the points whose vectors have the collection's dimension."""
    return points.where((F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull()))


def assemble(symbols: DataFrame) -> DataFrame:
    """Points without vectors, of the symbols that are embedded: id, text, payload."""
    s = symbols.where(~F.col("kind").isin("import", "export"))
    qn = F.concat("file", F.lit("::"), "name")
    text = embedding_text(*[F.col(c) for c in ("kind", "name", "signature", "calls_to", "called_by", "file", "start_line", "end_line")])
    payload = F.struct("name", "kind", "file", "start_line", "end_line", "signature", qn.alias("qualified_name"), "calls_to", "called_by")
    return s.select(deterministic_id(qn, NAMESPACE).alias("id"), text.alias("text"), payload.alias("payload"), "ord")


def embed(rows: DataFrame, fn: Callable[[list[str]], list[list[float]]], text: str = "text", batch: int = EMBED_BATCH) -> DataFrame:
    """Rows with vector, from a function over lists of at most batch texts."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            values = p.tolist()
            yield pd.Series([v for i in range(0, len(values), batch) for v in fn(values[i : i + batch])])

    return spread(rows).withColumn("vector", run(text))


def hashed_embedding(texts: list[str], dim: int = 64) -> list[list[float]]:
    """A stand-in for an embedding model: words hashed to signed dimensions, of unit length."""
    import hashlib

    out = []
    for t in texts:
        v = [0.0] * dim
        for w in (t or "").lower().split():
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
            v[h % dim] += 1.0 if h >> 63 else -1.0
        n = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / n for x in v])
    return out


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """V5: of new points with one id the last; they replace old ones."""
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n", order)
    return old.join(last.select(key), key, "left_anti").unionByName(last)


def delete_by_file(points: DataFrame, file: str) -> DataFrame:
    """The points of other files."""
    return points.where(~F.col("payload.file").eqNullSafe(F.lit(file)))


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths, summed in the order of the coordinates as scores are."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * x[:, d]
    return np.sqrt(out)


def _unit(x: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, and which are so long, short or broken that they have to be scored themselves."""
    odd = ~((norms > 1e-150) & (norms < 1e150)) & (x != 0).any(1)
    fine = ~odd & (norms > 0)
    return np.divide(x, norms[:, None], out=np.zeros_like(x), where=fine[:, None]), odd


def _first_of_equal(x: np.ndarray, k: int) -> np.ndarray:
    """Of equal rows the first k, as flags."""
    same = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * 8}").ravel(), return_inverse=True)[1]
    by = np.argsort(same, kind="stable")
    starts = np.flatnonzero(np.r_[True, same[by][1:] != same[by][:-1]])
    nth = np.empty(len(x), np.int64)
    nth[by] = np.arange(len(x)) - np.repeat(starts, np.diff(np.r_[starts, len(x)]))
    return nth < k


def _nearest(x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q, rows of x (in the order of ties) and scores of pairs among which are the k best of each q; and the k best ranks of each.

    Products of matrices tell which pairs come near the k best so far; these are scored coordinate by coordinate.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    best = np.full((len(q), k), -np.inf)
    with np.errstate(all="ignore"):
        norm_x, norm_q = _norms(x), _norms(q)
        (unit_x, odd_x), (unit_q, odd_q) = _unit(x, norm_x), _unit(q, norm_q)
        for a in range(0, len(q), _QUERIES):
            to = slice(a, a + _QUERIES)
            for b in range(0, len(x), _POINTS):
                rough = unit_q[to] @ unit_x[b : b + _POINTS].T
                rough[:, odd_x[b : b + _POINTS]] = -np.inf
                least = best[to, k - 1].copy()
                if rough.shape[1] > k and np.isneginf(least).any():
                    least = np.maximum(least, np.where(odd_q[to], -np.inf, np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k]))
                near = rough >= (least - _MARGIN)[:, None]
                near[:, odd_x[b : b + _POINTS]] = True
                near[odd_q[to]] = True
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                at, of = i + a, j + b
                score, both = np.zeros(len(i)), norm_x[of] * norm_q[at]
                for d in range(x.shape[1]):
                    score += x[of, d] * q[at, d]
                score = np.where((both > 0) | np.isnan(both), score / both, 0.0)
                rank = np.where(np.isnan(score), np.inf, np.round(score, 9))
                order = np.lexsort((of, -rank, i))
                i = i[order]
                starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                nth = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)]))
                order, i, nth = order[nth < k], i[nth < k], nth[nth < k]
                found.append((at[order], of[order], score[order]))
                new = np.full((len(rough), k), -np.inf)
                new[i, nth] = rank[order]
                best[to] = -np.sort(-np.concatenate((best[to], new), axis=1), axis=1)[:, :k]
    at, of, score = (np.concatenate(c) if found else np.empty(0, t) for c, t in zip(zip(*found) if found else ((), (), ()), (np.int64, np.int64, np.float64)))
    with np.errstate(invalid="ignore"):
        still = np.where(np.isnan(score), np.inf, np.round(score, 9)) >= best[at, k - 1]
    return at[still], of[still], score[still], best


def top_k(points: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", vector: str = "vector", where: Column | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """V6, T4: for each query (query_id, query_vector) the k points of the highest cosine to nine digits, ties by id.

    Every query meets every point, as the definition asks, so the work grows with their product. Both are dealt by a hash into
    blocks of bounded size (queries of about the size given), each block of queries meets each of points in one task, and keeps k rows a query.
    """
    spark = points.sparkSession
    float_ = lambda df, c: "float" if df.select(c).schema[0].dataType.elementType == T.FloatType() else "double"
    dims = lambda v: F.coalesce(F.when(F.forall(v, lambda c: c.isNotNull()) & (F.size(v) > 0), F.size(v)), F.lit(-1))
    p = points if where is None else points.where(where)
    p = p.select(F.col(id_col).alias("id"), F.col(vector).cast(f"array<{float_(points, vector)}>").alias("v")).withColumn("dims", dims("v"))
    q = queries.select("query_id", F.col("query_vector").cast(f"array<{float_(queries, 'query_vector')}>").alias("v")).withColumn("dims", dims("v"))
    size = lambda df: df.select(F.count("*"), F.coalesce(F.sum(8 * F.greatest("dims", F.lit(0)).cast("long")), F.lit(0))).first()
    (n, n_bytes), (m, m_bytes) = size(p), size(q)
    asked = max(1, math.ceil(m / block), math.ceil(m_bytes / BYTES))
    # smaller blocks where there would be fewer tasks than cores
    blocks = max(1, math.ceil(n / POINT_BLOCK), math.ceil(n_bytes / BYTES), min(math.ceil(n / _POINTS), math.ceil(4 * spark.sparkContext.defaultParallelism / asked)))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = lambda key, count: F.pmod(F.xxhash64(key, "v"), F.lit(count)).cast("int")
    left = p.withColumn("block", dealt("id", blocks)).withColumn("ask", every(asked))
    right = q.withColumn("ask", dealt("query_id", asked)).withColumn("block", every(blocks))
    result = T.StructType([T.StructField("query_id", q.schema["query_id"].dataType), T.StructField("id", p.schema["id"].dataType), T.StructField("score", T.DoubleType())])

    def meet(some: pa.Table, ask: pa.Table) -> pa.Table:
        ids, asks = some.column("id").combine_chunks(), ask.column("query_id").combine_chunks()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if some.num_rows and ask.num_rows:
            order = pc.sort_indices(ids, null_placement="at_start").to_numpy()
            dims_, dims_q = some.column("dims").to_numpy()[order], ask.column("dims").to_numpy()
            vectors, asked_for = some.column("v").combine_chunks(), ask.column("v").combine_chunks()
            for d in np.unique(dims_q).tolist():
                at = np.flatnonzero(dims_q == d)
                mine, other = order[dims_ == d] if d > 0 else order[:0], order[dims_ != d][:k] if d > 0 else order[:k]
                best = np.full((len(at), k), -np.inf)
                if len(mine):
                    x = _matrix(vectors.take(pa.array(mine)), d)
                    kept = _first_of_equal(x, k)  # mine are in the order of ids, so the others can be nobody's nearest
                    i, j, score, best = _nearest(x[kept], _matrix(asked_for.take(pa.array(at)), d), k)
                    found.append((at[i], mine[kept][j], score))
                # vectors of other sizes, and broken ones, score 0
                open_ = at[best[:, k - 1] <= 0]
                found.append((np.repeat(open_, len(other)), np.tile(other, len(open_)), np.zeros(len(open_) * len(other))))
        i, j, score = (np.concatenate([f[c] for f in found]) if found else np.empty(0, t) for c, t in enumerate((np.int64, np.int64, np.float64)))
        return pa.table([asks.take(pa.array(i, pa.int64())), ids.take(pa.array(j, pa.int64())), pa.array(score, pa.float64())], ["query_id", "id", "score"])

    scored = left.groupBy("block", "ask").cogroup(right.groupBy("block", "ask")).applyInArrow(meet, result)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k_of_text(points: DataFrame, text: str, fn: Callable = hashed_embedding, k: int = 10) -> DataFrame:
    """V7: the points nearest to a text."""
    q = points.sparkSession.createDataFrame([(0, fn([text])[0])], "query_id int, query_vector array<double>")
    return top_k(points, q, k)
