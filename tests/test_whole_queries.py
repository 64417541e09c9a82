"""Queries take in all rows and whole texts of their tables."""

from __future__ import annotations

from quillstone import plans, registry  # noqa: F401
from quillstone.functions import text as T

SF = "/root/testdata/sf0.001"


def rows(spark, name, *columns):
    return {tuple(r) for r in registry.QUERIES[name](spark, SF).select(*columns).collect()}


def test_overlaps_of_all_orders(spark):
    assert {r[0] % 7 for r in rows(spark, "j12_overlaps", "l_orderkey")} == set(range(7))


def test_all_runs_with_feedback(spark):
    docs = {r["doc_id"]: r["source"] for r in registry.table(spark, SF, "documents").collect()}
    got = {r["run_id"]: r["outputs"] for r in registry.QUERIES["j16_runs_with_feedback"](spark, SF).collect()}
    assert {k: v for k, v in got.items() if v} == {k: [v] for k, v in docs.items()}


def test_risk_of_all_suppliers(spark):
    import __spark_entry__

    suppliers = {r["s_suppkey"] for r in registry.table(spark, SF, "supplier").collect()}
    assert len(suppliers) > 1 and {r["root"] for r in __spark_entry__.entry(spark).collect()} == suppliers


def test_top_k_of_every_20th(spark):
    ids = {r["vec_id"] for r in registry.table(spark, SF, "embeddings").collect()}
    assert {r[0] for r in rows(spark, "v6_t4_p8_top_k", "query_id")} == {i for i in ids if i % 20 == 0}


def test_feedback_gate_of_whole_texts(spark, tmp_path):
    texts = [(1, "a " * 300 + "The rain was ending there"), (2, "a " * 300 + "the rain")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["j8_k3_feedback_gate"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["matched"] for r in got} == {1: "the rain ending there", 2: None}


def test_suspicious_characters_of_whole_texts(spark, tmp_path):
    odd = [chr(c) for points in T.SUSPICIOUS.values() for c in points] + [chr(T.PRIVATE_USE[0]), chr(T.PRIVATE_USE[1])]
    texts = [(r["doc_id"], r["text"]) for r in registry.table(spark, SF, "documents").collect()]
    texts += [(-1, "x" * 5000 + "".join(c + "é😀 word " for c in odd) + "\n"), (-2, None), (-3, ""), (-4, odd[0] * 30)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    kinds = {c: k for k, points in reversed(T.SUSPICIOUS.items()) for c in points}
    want = {}
    for d, t in texts:
        s = None if t is None else "\u200b" + t
        for i, c in enumerate(s or ""):
            kind = kinds.get(ord(c)) or ("private_use_area" if T.PRIVATE_USE[0] <= ord(c) <= T.PRIVATE_USE[1] else None)
            if kind:
                want.setdefault((d, kind, s[max(0, i - 10) : i + 11]), (i, f"U+{ord(c):04X}"))
    got = {(r["doc_id"], r["kind"], r["context"]): (r["pos"], r["char"]) for r in registry.QUERIES["c21_suspicious_characters"](spark, str(tmp_path)).collect()}
    assert got == want and any(i >= 5000 for i, _ in got.values())
