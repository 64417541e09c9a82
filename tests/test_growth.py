"""Work that has to grow with the input, and results that must stay as they were."""

from __future__ import annotations

import math
import random

from quillstone.lineage import cut, small
from quillstone.operators import code_index as C
from quillstone.operators import graph as G
from quillstone.operators import vectors as V


def test_export_edges_meet_by_equality(spark):
    names = ["", "run", "runner", "é", "ru", "x y", None, "run"]
    texts = ["export run", "export runner é", "", "x  y x y", None, "export run"]
    rows = [(f, "function", n) for f in ("a", "b") for n in names if (f, n) != ("b", "run")] + [("a", "export", t) for t in texts] + [("b", "export", texts[1]), (None, "export", "run"), ("a", "import", "run"), ("c", "export", "run")]
    edges = G.export_edges(spark.createDataFrame(rows, "file string, kind string, name string"))
    want = {(f"{f}::{t}", f"{g}::{n}", "EXPORTS_TO") for f, k, t in rows if k == "export" and t is not None for g, h, n in rows if g == f and h == "function" and n is not None and n in t}
    got = [tuple(r) for r in edges.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "contains" not in edges._jdf.queryExecution().executedPlan().toString().lower()


def cosines(p, q, k):
    """The k best of each query by definition: scores to nine digits, ties by id, what cannot be compared scores 0."""
    out = set()
    for qid, v in q:
        rows = []
        for i, x in p:
            s = 0.0
            if v and x and len(v) == len(x) and None not in v and None not in x:
                both = math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(a * a for a in v))
                s = sum(a * b for a, b in zip(x, v)) / both if both > 0 else 0.0
            rows.append((-round(s, 9), i))
        out |= {(qid, i, -s + 0.0, n) for n, (s, i) in enumerate(sorted(rows)[:k], 1)}
    return out


def test_top_k_by_blocks_is_the_definition(spark, monkeypatch):
    rng = random.Random(4)
    v = lambda d: [rng.choice([-1.5, 0.0, 0.25, 1.0]) for _ in range(d)]
    p = [(f"p{i:03}", v(6)) for i in range(150)] + [(f"s{i:03}", [1.0, 1.0, 0.0, 0.0, 0.0, 2.0]) for i in range(60)]  # 60 copies
    p += [("a", None), ("b", [1.0, None, 1.0, 0.0, 0.0, 0.0]), ("c", [0.0] * 6), ("d", v(3)), ("e", []), ("f", [1e-200] * 6), ("g", [1e152] * 6)]
    q = [(i, x) for i, (_, x) in enumerate(p) if i % 7 == 0] + [(1000 + i, x) for i, (_, x) in enumerate(p[-7:])]
    points = spark.createDataFrame(p, "id string, vector array<double>")
    asked = spark.createDataFrame(q, "query_id long, query_vector array<double>")
    monkeypatch.setattr(V, "POINT_BLOCK", 90)
    monkeypatch.setattr(V, "_POINTS", 32)
    monkeypatch.setattr(V, "_QUERIES", 5)
    for k in (1, 10, 300):
        got = {(r["query_id"], r["id"], round(r["score"], 9) + 0.0, r["rank"]) for r in V.top_k(points, asked, k, block=20).collect()}
        assert got == {x for x in cosines(p, q, k)}


def test_top_k_multiplies_blocks(spark):
    points = spark.range(50).selectExpr("id", "array(float(id), 1f) AS vector")
    plan = V.top_k(points, points.selectExpr("id AS query_id", "vector AS query_vector"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_parsing_and_embedding_are_spread_over_tasks(spark):
    one = spark.createDataFrame([(f"a{i}.py", f"def f{i}(x):\n    return g(x)\n") for i in range(100)], "path string, text string").coalesce(1)
    found = C.index(one)
    assert found.rdd.getNumPartitions() >= 32 and {(r["file"], r["name"]) for r in found.collect()} == {(f"a{i}.py", f"f{i}") for i in range(100)}
    vectors = V.embed(one, V.hashed_embedding)
    assert vectors.rdd.getNumPartitions() >= 32 and vectors.count() == 100
    many = one.repartition(64)
    assert C.index(many).rdd.getNumPartitions() == 64


def test_broadcasts_go_by_measured_bytes(spark):
    keys = spark.range(10).selectExpr("id AS k")
    made = cut(keys.selectExpr("k", "explode(sequence(1, 500)) AS v"))  # Spark estimates the ten rows that these were made of
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for how in ("inner", "left", "left_semi", "left_anti"):
        dealt, sent = keys.join(small(made, 1000), "k", how), keys.join(small(made), "k", how)
        assert "SortMergeJoin" in plan(dealt) and "BroadcastHashJoin" not in plan(dealt) and "BroadcastHashJoin" in plan(sent)
        assert sorted(dealt.collect()) == sorted(sent.collect())


def test_broadcasts_are_gathered_in_few_tasks(spark):
    many = cut(spark.range(1000).repartition(50))
    assert small(many).rdd.getNumPartitions() == 1 and small(many, 10).rdd.getNumPartitions() == 50
    assert sorted(r["id"] for r in spark.range(2000).join(small(many), "id").collect()) == list(range(1000))
