"""The stored inverted index against BM25 over the texts, and the table function against the columns."""

from __future__ import annotations

import random

import pytest

from quillstone.functions import tables
from quillstone.operators import diffs, postings
from quillstone.operators.ranking import bm25


def texts(n: int, seed: int = 5) -> list[tuple]:
    r = random.Random(seed)
    words = [f"word{int(r.paretovariate(0.7))}" for _ in range(4000)]
    return [(i, " ".join(r.choice(words) for _ in range(r.choice((1, 3, 8, 40, 300))))) for i in range(n)]


def as_set(df):
    return {tuple(sorted(r.asDict().items())) for r in df.collect()}


@pytest.fixture(scope="module")
def docs(spark):
    rows = texts(600) + [(1000, "word1 word1 rare"), (1001, "word1 word1 rare"), (1002, ""), (1003, None), (1004, "a b"), (None, "rare word7"), (1005, "word1 " * 20000)]
    return spark.createDataFrame(rows, "id long, text string")


@pytest.mark.parametrize("results", [1, 3, 50])
@pytest.mark.parametrize("block", [700, 1 << 18])
def test_the_index_finds_what_a_scan_finds(spark, docs, tmp_path, results, block):
    queries = spark.createDataFrame([(1, "word1 word2 rare"), (2, "rare rare"), (3, "nowhere"), (4, ""), (5, None), (6, "word5 word17 word900 word2"), (6, "word5"), (None, "word3 rare")], "query_id long, query string")
    index = postings.InvertedIndex(spark, str(tmp_path / "index")).build(docs, block=block)
    got = index.search(queries, results)
    assert as_set(got) == as_set(bm25(docs, queries, results=results))
    ranks = [r["rank"] for r in got.where("query_id = 2").orderBy("rank").collect()]
    assert ranks == list(range(1, min(3, results) + 1)), "three documents hold it, the null id among them"


def test_blocks_that_cannot_reach_the_best_are_not_read(spark, docs, tmp_path, monkeypatch):
    index = postings.InvertedIndex(spark, str(tmp_path / "index")).build(docs, block=700)
    read = []
    scores = index._scores
    monkeypatch.setattr(index, "_scores", lambda p, share, asked: (read.append(asked.select("block").distinct().count()), scores(p, share, asked))[1])
    index.search(spark.createDataFrame([(1, "word1 rare")], "query_id long, query string"), 2).collect()
    there = spark.read.parquet(str(tmp_path / "index" / "postings")).where("term in ('word1', 'rare')").select("block").distinct().count()
    assert read[0] == 2 and sum(read) < there / 4, (read, there)


def test_a_search_reads_the_buckets_of_its_terms(spark, docs, tmp_path):
    import shutil

    index = postings.InvertedIndex(spark, str(tmp_path / "index")).build(docs)
    folder = tmp_path / "index" / "postings"
    bucket = spark.read.parquet(str(folder)).where("term = 'rare'").select("bucket").first()[0]
    for f in folder.glob("bucket=*"):
        if f.name != f"bucket={bucket}":
            shutil.rmtree(f)
    q = spark.createDataFrame([(1, "rare")], "query_id long, query string")
    assert as_set(index.search(q)) == as_set(bm25(docs, q))


def test_an_index_of_nothing_and_of_repeated_ids(spark, tmp_path):
    q = spark.createDataFrame([(1, "rare word1")], "query_id long, query string")
    none = postings.InvertedIndex(spark, str(tmp_path / "none")).build(spark.createDataFrame([], "id string, text string"))
    assert none.search(q).collect() == [] and none.search(q).dtypes[1] == ("id", "string")
    blank = postings.InvertedIndex(spark, str(tmp_path / "blank")).build(spark.createDataFrame([("a", None), ("b", "x")], "id string, text string"))
    assert blank.search(q).collect() == [] and blank.search(q.limit(0)).collect() == []
    twice = spark.createDataFrame([(1, "rare word1"), (1, "word1 rare"), (2, "rare other")], "id long, text string")
    index = postings.InvertedIndex(spark, str(tmp_path / "twice")).build(twice)
    assert as_set(index.search(q)) == as_set(bm25(twice, q)) == as_set(bm25(twice, q, vocabulary=0))


DIFFS = [
    (1, "diff --git a/x b/y z\n@@ -1 +1 @@\n" + "a" * 150 + "\n@@ two\n" + "b" * 90 + "\n@@ three\n" + "c" * 500 + "\n+++ b/other\nshort\ndiff --git a/x b/y z\nagain\n@@ 4\nlast"),
    (2, "no header\nat all\n" + "x" * 300), (3, ""), (4, None), (5, "diff --git a/é b/é\r\n+é" * 40), (6, "+++ b/one"),
    (7, "diff --git a/q b/q rest\n" + "y" * 250 + "\n+++ b/r\r\n" + "z" * 30),
]


@pytest.mark.parametrize("most", [40, 60, 6000])
def test_chunks_by_the_table_function_are_those_of_the_columns(spark, most):
    tables.register(spark)
    df = spark.createDataFrame([(i, f"note {i}", d) for i, d in DIFFS], "mr_iid int, note string, diff string")
    got = spark.sql("SELECT * FROM change_chunks(changes => TABLE(SELECT * FROM {df}) PARTITION BY mr_iid, max_tokens => {most})", df=df, most=most)
    want = diffs.chunk_rows(df, max_tokens=most)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_chunks_are_numbered_through_a_review(spark):
    tables.register(spark)
    df = spark.createDataFrame([(1, 2, "second"), (1, 1, "first"), (1, 3, None), (2, 1, "other")], "mr_iid int, at int, diff string")
    got = spark.sql("SELECT mr_iid, at, chunk_no, content FROM change_chunks(TABLE(SELECT * FROM {df}) PARTITION BY mr_iid ORDER BY at)", df=df)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 1, "first"), (1, 2, 2, "second"), (2, 1, 1, "other")]
    for bad in ("SELECT * FROM change_chunks(TABLE(SELECT 1 AS x))", "SELECT * FROM change_chunks(TABLE(SELECT '' AS diff, 1 AS Content))", "SELECT * FROM change_chunks(TABLE(SELECT '' AS diff), 0)"):
        with pytest.raises(Exception, match="change_chunks|max_tokens|clash"):
            spark.sql(bad)


def test_tasks_of_an_index_grow_with_its_blocks(spark, tmp_path, monkeypatch):
    counts = []
    kind = type(spark.range(1))
    plain = kind.repartition

    def counted(self, n, *cols):
        counts.append(n)
        return plain(self, n, *cols)

    monkeypatch.setattr(kind, "repartition", counted)
    monkeypatch.setattr(postings, "BLOCK", 700)
    docs = spark.createDataFrame([(i, f"word{i % 7} and word{i % 11} again") for i in range(120)], "id long, text string")
    index = postings.InvertedIndex(spark, str(tmp_path / "many")).build(docs, block=700)
    blocks = spark.read.parquet(str(tmp_path / "many/postings")).select("block").distinct().count()
    assert blocks > 8 and counts[0] >= blocks and all(isinstance(n, int) for n in counts)
    queries = spark.createDataFrame([(1, "word3 word5")], "query_id long, query string")
    assert index.search(queries, 5).count() == 5 and len(counts) == 4 and counts[2] >= 5
