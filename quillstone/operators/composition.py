"""X11: one question put to several corpora, with the rule of its category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.ranking import bm25, find_rule


def compose(corpora: dict[str, tuple[DataFrame, int]], queries: DataFrame, rules: DataFrame) -> DataFrame:
    """For each query (query_id, query) the best documents (id, text) of every corpus, so many each, with the category
    of the first rule that fits the query: query_id, domain, id, score, rank, category."""
    out = None
    for name, (docs, results) in corpora.items():
        found = bm25(docs, queries, results=results).withColumn("domain", F.lit(name))
        out = found if out is None else out.unionByName(found)
    category = find_rule(queries, rules, "query_id", "query").select("query_id", "category")
    return out.join(category, "query_id", "left").select("query_id", "domain", "id", "score", "rank", "category")
