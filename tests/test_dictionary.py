"""Dictionary matching against one regular expression a term, on small and on large dictionaries."""

from __future__ import annotations

import re
import time

import pytest
from pyspark.sql import functions as F

from quillstone.operators import aggregates, dictionary, stories

SF = "/root/testdata/sf0.001"


def plain(docs, terms, whole=True):
    out = []
    for d, text in docs:
        for t in sorted({t for t in terms if t}):
            p = re.escape(t.lower())
            if text and re.search(rf"\b{p}\b" if whole else p, text.lower()):
                out.append((d, t))
    return sorted(out, key=str)


ROWS = [(1, "Herr Müller and the O'Neil-case; c++ is fun"), (1, "Herr Müller and the O'Neil-case; c++ is fun"), (2, None), (3, ""), (4, "müllers HERR  Müller"), (None, "of the of the OF THE"), (5, "😀 x😀y 漢字 of\nthe"), (6, "ab " * 50_000 + "zz")]
TERMS = ["Müller", "müller", "Herr Müller", "of the", "the", "c++", "O'Neil", "neil-case", "zz", "b a", "漢字", "x", "ü", "", None, "absent"]


@pytest.mark.parametrize("limit", [dictionary.TERM_BYTES, 400])
@pytest.mark.parametrize("whole", [True, False])
def test_occurrences(spark, limit, whole):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("term", F.lit("other"))
    terms = spark.createDataFrame([(t,) for t in [*TERMS, "the"]], "term string")
    got = sorted((tuple(r) for r in dictionary.occurrences(docs, terms, whole_words=whole, limit=limit).collect()), key=str)
    assert got == plain(ROWS, TERMS, whole)
    assert dictionary.occurrences(docs, terms.limit(0)).collect() == [] and dictionary.occurrences(docs.limit(0), terms).collect() == []


def test_mentions_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    words = [r[0] for r in docs.select(F.explode(F.split("text", " ")).alias("w")).where("length(w) > 3").distinct().orderBy("w").limit(300).collect()]
    terms = [re.sub(r"^\W+|\W+$", "", w) for w in words] + ["of the", "en la", "und die"]
    got = sorted((tuple(r) for r in stories.mentions(docs, spark.createDataFrame([(t,) for t in terms], "term string")).collect()), key=str)
    assert got == plain([tuple(r) for r in docs.collect()], terms)


def test_votes_count_keywords_anywhere(spark):
    docs = spark.createDataFrame([(1, "The thesis and AND"), (2, None), (3, "nothing"), (3, "the")], "id long, text string")
    words = spark.createDataFrame([("a", 0, "the"), ("a", 0, "thesis"), ("b", 1, "and"), ("b", 1, "THE")], "class string, ord int, keyword string")
    got = sorted((tuple(r) for r in aggregates.keyword_votes(docs, "id", "text", words, "none").collect()), key=str)
    assert got == [(1, "a", 2), (2, "none", 0), (3, "a", 1), (3, "a", 1)]


def test_time_does_not_grow_with_the_terms(spark):
    """100,000 terms over the documents of sf0.01; one regular expression a term would take hours."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").cache()
    docs.count()
    took = {}
    for n in (10, 100_000):
        terms = spark.range(n).select(F.concat(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 8), F.lit(" the")).alias("term")).union(spark.createDataFrame([("of the",), ("und",)], "term string"))
        began = time.time()
        found = dictionary.occurrences(docs, terms).groupBy("term").count().collect()
        took[n] = time.time() - began
        assert {"of the", "und"} <= {r["term"] for r in found}
    assert took[100_000] < 5 * took[10] + 20, took
