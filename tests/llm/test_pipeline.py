"""Each stage of the pipeline against brute force on what the stage before it has kept."""

from __future__ import annotations

import corpus_pipeline
from quillstone.llm import quality, stages
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        kept[name] = (pairs(docs), spark.read.parquet(str(tmp_path / name)))
        docs = kept[name][1]
        if name != "packing":
            assert docs.columns == columns
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    before, after = kept["quality_classifier"]
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scored = quality.score(spark.read.parquet(f"{SF}/documents.parquet"), model).collect()
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in scored if r["score"] >= 0.7}
    before, after = kept["line_dedup"]
    assert dict(pairs(after)) == {d: t for d, t in brute.kept_lines(before).items() if t.strip() or dict(before)[d] == t}
    before, after = kept["minhash_near_dedup"]
    assert {d for d, _ in pairs(after)} == {r[2] for r in brute.near_components(before, 80)}
    before, after = kept["benchmark_decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {d for d, _ in pairs(after)} == {d for d, _ in before} - {d for d, _ in brute.leaks(before, items)}
    before, after = kept["packing"]
    assert {r["doc_id"] for r in after.collect()} == {d for d, _ in before}


def test_run_is_the_stages_in_order(spark):
    assert [n for n, _ in stages.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "packing"]
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_empty_corpus(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
