"""E5: the tools of the review service as functions over tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone import models
from quillstone.operators import graph, vectors
from quillstone.plans import review


class CodeReview:
    """The tables are given to it: edges (src, dst, rel), symbols by qualified name, points with vectors."""

    def __init__(self, edges: DataFrame, nodes: DataFrame, points: DataFrame | None = None, model: models.ModelFn = models.stub, embed: Callable = vectors.hashed_embedding):
        self.edges, self.nodes, self.points, self.model, self.embed = edges, nodes, points, model, embed

    def review_snippet(self, diff: str) -> DataFrame:
        spark = self.edges.sparkSession
        none = spark.createDataFrame([], "pattern string, count long")
        return review.review(spark.createDataFrame([(0, diff)], "mr_iid int, diff string"), none, self.model)["consensus"]

    def check_risk(self, files: list[str], max_depth: int = 3) -> DataFrame:
        changed = self.edges.sparkSession.createDataFrame([(f,) for f in files], "path string")
        return review.risk_of(self.edges, changed, max_depth)

    def find_patterns(self, text: str, limit: int = 10) -> DataFrame:
        if self.points is None:
            return self.edges.sparkSession.createDataFrame([], "query_id int, id string, score double, rank int")
        return vectors.top_k_of_text(self.points, text, self.embed, limit)

    def explain_symbol(self, name: str) -> DataFrame:
        """The symbol with its callers."""
        s = graph.find_symbols(self.nodes, name)
        callers = self.edges.where("rel = 'CALLS'").groupBy("dst").agg(F.array_sort(F.collect_set("src")).alias("callers"))
        return s.join(callers, F.col("qualified_name") == F.col("dst"), "left").drop("dst")

    def query_graph(self, name: str, max_depth: int = 3) -> DataFrame:
        """What depends on a symbol, to a depth from 1 to 5, by depth and name."""
        seeds = graph.find_symbols(self.nodes, name).select(F.col("qualified_name").alias("root"), F.col("qualified_name").alias("node"))
        deps = self.edges.where("rel in ('CALLS', 'IMPORTS')")
        return graph.reach(deps, seeds, min(max(max_depth, 1), 5)).orderBy("depth", "node")
