"""Quality scores from a sparse ensemble of rules.

Statistics of a text (shares of kinds of bytes, repetition, word and line lengths) are computed by
an Arrow function. Shallow boosted trees are fitted to them; each path from a root to an inner node
or a leaf is a rule, a conjunction of comparisons; logistic regression with an L1 penalty keeps few
of the rules and weighs them; and the rules that stay are compiled into one Spark column over the
statistics. Fitting takes at most MAX_TRAIN labelled rows, the first by hash of doc_id: that bound is
the only thing that does not cover all data.

Cases: null text is empty and is scored like any other; without labels of both kinds the score is the
share of label 1 (1 without labels); several labels of a document: the lowest counts; null labels
don't; repeated rows are scored each; an empty table stays empty; labels for absent documents are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import with_rest

#: Labelled rows that are gathered for fitting, at most.
MAX_TRAIN = 20_000
TREES, DEPTH, BINS, RATE = 24, 3, 32, 0.3
PENALTY, STEPS = 2e-3, 300
THRESHOLD = 0.7

NAMES = (
    "bytes", "words", "lines", "upper", "digit", "space", "newline", "dot", "pipe", "symbol", "wide", "control",
    "word_bytes", "longest_word", "distinct_words", "repeats", "top_word", "distinct_lines", "line_words", "ends",
)
_KIND = np.zeros(256, np.int64)
for _i, _s in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".,;:!?'\"()-", b"|", b"#$%&*+/<=>@[\\]^_`{}~"), 1):
    _KIND[list(_s)] = _i
_KIND[128:] = 8
_KIND[[i for i in range(32) if i not in (9, 10, 13)] + [127]] = 9


def statistics(text: bytes) -> list[float]:
    """One number for each of NAMES, finite, all 0 for an empty text."""
    if not text:
        return [0.0] * len(NAMES)
    n = len(text)
    kinds = np.bincount(_KIND, np.bincount(np.frombuffer(text, np.uint8), minlength=256), 10) / n
    words = text.split()
    lines = text.split(b"\n")
    m = len(words)
    if not m:
        return [float(n), 0.0, float(len(lines)), *kinds[1:].tolist(), *[0.0] * 8]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    return [
        float(n), float(m), float(len(lines)), *kinds[1:].tolist(),
        sum(map(len, words)) / m, float(max(map(len, words))), len(seen) / m, sum(map(eq, words, words[1:])) / m, max(seen.values()) / m,
        len(set(lines)) / len(lines), m / len(lines), sum(w.endswith((b".", b"!", b"?")) for w in words) / m,
    ]


def _statistics_of(text: pa.Array) -> pa.Array:
    rows = [statistics(t or b"") for t in text.cast(pa.large_binary()).to_pylist()]
    return pa.array(rows, pa.list_(pa.float64()))


def statistics_column(text: Column) -> Column:
    return F.arrow_udf(_statistics_of, "array<double>")(text)


Rule = tuple[tuple[int, bool, float], ...]  #: (statistic, whether above, bound), all of which hold


@dataclass(frozen=True)
class Model:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def column(self, stats: Column) -> Column:
        """The score, 0 to 1, over an array of statistics."""
        total = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights):
            holds = F.lit(True)
            for i, above, bound in rule:
                x = F.get(stats, F.lit(i))
                holds = holds & ((x > bound) if above else (x <= bound))
            total = total + F.when(holds, F.lit(w)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, w in zip(self.rules, self.weights):
            z += w * _holds(rule, x)
        return 1 / (1 + np.exp(-z))


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for i, above, bound in rule:
        out &= (x[:, i] > bound) if above else (x[:, i] <= bound)
    return out


def _tree_rules(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """The paths of one tree fitted to gradients g and curvatures h, and its output."""
    out, rules, todo = np.zeros(len(x)), [], [((), np.arange(len(x)))]
    while todo:
        path, at = todo.pop()
        if path:
            rules.append(path)
        best = (1e-3, 0, 0)
        if len(path) < DEPTH and len(at) >= 20:
            total_g, total_h = g[at].sum(), h[at].sum() + 1.0
            for i in range(x.shape[1]):
                b = binned[at, i]
                left_g, left_h, left_n = (np.cumsum(np.bincount(b, v, BINS + 1))[: len(edges[i])] for v in (g[at], h[at], None))
                ok = (left_n >= 5) & (len(at) - left_n >= 5)
                gain = np.where(ok, left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h) - total_g**2 / total_h, 0)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), i, int(gain.argmax()))
        if best[0] <= 1e-3:
            out[at] = g[at].sum() / (h[at].sum() + 1)
            continue
        _, i, k = best
        bound = float(edges[i][k])
        above = x[at, i] > bound
        todo += [((*path, (i, True, bound)), at[above]), ((*path, (i, False, bound)), at[~above])]
    return rules, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """x: rows of statistics; y: labels 0 or 1."""
    share = float(y.mean()) if len(y) else 1.0
    if share in (0.0, 1.0):
        return Model((), (), 40.0 if share else -40.0)
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], 1)
    rng, z, rules = np.random.default_rng(7), np.full(len(y), np.log(share / (1 - share))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        keep = rng.random(len(y)) < 0.7
        found, step = _tree_rules(x, binned, edges, np.where(keep, y - p, 0), np.where(keep, p * (1 - p), 0))
        z += RATE * step
        rules.update(dict.fromkeys(found))
    columns, kept = {}, []
    for rule in rules:
        c = _holds(rule, x)
        if 0.002 < c.mean() < 0.998 and (key := c.tobytes()) not in columns:
            columns[key] = c
            kept.append(rule)
    a = np.stack(list(columns.values()), 1).astype(float) if kept else np.zeros((len(y), 0))
    w, b = _lasso(a, y)
    strong = np.flatnonzero(np.abs(w) > 1e-6)
    return Model(tuple(kept[i] for i in strong), tuple(float(w[i]) for i in strong), b)


def _lasso(a: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic weights under an L1 penalty (accelerated proximal gradient); the intercept goes free."""
    n = len(y)
    full = np.concatenate((a, np.ones((n, 1))), 1)
    v = np.ones(full.shape[1])
    for _ in range(20):
        v = full.T @ (full @ v)
        v /= np.linalg.norm(v)
    rate = 4 * n / max(float(v @ (full.T @ (full @ v))), 1e-9)
    w = np.zeros(full.shape[1])
    u, t = w.copy(), 1.0
    for _ in range(STEPS):
        new = u - rate * (full.T @ (1 / (1 + np.exp(-(full @ u))) - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * PENALTY, 0)
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        u, w = new + (was - 1) / t * (new - w), new
    return w[:-1], float(w[-1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """From labels (doc_id, quality) of documents (doc_id, text) that are not held out."""
    known = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)  # so the broadcast has max_train rows at most
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "quality", statistics_column(F.col("text")).alias("stats"))
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("stats", "quality")).alias("r")).select("r.stats", "r.quality").collect()
    return fit(np.array([r["stats"] for r in rows]).reshape(len(rows), len(NAMES)), np.array([float(r["quality"] > 0) for r in rows]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score double and predicted int, which replace columns of these names; no other name can clash."""

    def add(d: DataFrame) -> DataFrame:
        scored = d.withColumn("_stats", statistics_column(F.col("text"))).withColumn("score", model.column(F.col("_stats")))
        return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

    return with_rest(docs, ("text",), add, ("score", "predicted"))
