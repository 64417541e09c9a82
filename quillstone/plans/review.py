"""The whole review as one plan: change sets to chunks, landscape, reviewers, consensus, feedback gate, verification and report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone import models
from quillstone.functions.text import json_of
from quillstone.lineage import cut
from quillstone.operators import diffs, findings, graph

#: Tier of each reviewer, and what it is told.
REVIEWERS = {"logic": ("frontier", "Find errors of logic."), "risk": ("frontier", "Find risks that spread."), "consistency": ("base", "Find deviations from the codebase.")}
_FINDING = "struct<findings:array<struct<issue:string,location:string,corner_case:string,risk:string,propagation:string,deviation:string,evidence:string,confidence:string,emotion:string>>>"
#: Characters of a change set that the landscape scan, and each verification, is shown. Fixed values.
SCANNED, SHOWN = 8000, 6000


def landscape(changes: DataFrame, fn: models.ModelFn = models.stub, budget: models.Budget | None = None) -> DataFrame:
    """L2: changes (mr_iid, diff) to mr_iid and landscape, a model's summary of each; {} where it gave no JSON or was not asked."""
    asked = changes.select("mr_iid", F.substring("diff", 1, SCANNED).alias("prompt"))
    answered = models.ask(asked, fn, "cheap", "Describe what this change touches, as JSON.", budget=budget, order=("mr_iid",))
    return answered.select("mr_iid", F.coalesce(F.to_json(F.try_parse_json(json_of(F.col("answer")))), F.lit("{}")).alias("landscape"))


def reviews(chunks: DataFrame, fn: models.ModelFn = models.stub, budget: models.Budget | None = None) -> dict[str, DataFrame]:
    """L2: each reviewer's rows for the chunks (mr_iid, chunk_no, content)."""
    out = {}
    for name, (tier, system) in REVIEWERS.items():
        answered = models.ask(chunks.select("mr_iid", "chunk_no", F.col("content").alias("prompt")), fn, tier, system, budget=budget, order=("mr_iid", "chunk_no"))
        rows = answered.select("mr_iid", "chunk_no", F.posexplode(F.from_json(json_of(F.col("answer")), _FINDING)["findings"]).alias("i", "f"))
        out[name] = rows.select("mr_iid", (F.col("chunk_no") * 1000 + F.col("i")).alias("ord"), "f.*")
    return out


def verify(found: DataFrame, changes: DataFrame, scans: DataFrame, fn: models.ModelFn = models.stub, budget: models.Budget | None = None) -> DataFrame:
    """L2: findings (mr_iid, id, ...) put to a model once more, with the change and its landscape: finding_id, verdict, reasoning; null without an answer."""
    shown = found.select("mr_iid", "id", F.to_json(F.struct("id", "issue", "locations", "confidence")).alias("finding")).join(changes.select("mr_iid", F.substring("diff", 1, SHOWN).alias("diff")), "mr_iid").join(scans, "mr_iid", "left")
    prompt = F.concat_ws("\n", F.lit("Verify this finding independently."), F.concat(F.lit("<finding>"), "finding", F.lit("</finding>")), F.concat(F.lit("<diff>"), "diff", F.lit("</diff>")), F.concat(F.lit("<landscape>"), F.coalesce("landscape", F.lit("{}")), F.lit("</landscape>")))
    answered = models.ask(shown.select("mr_iid", "id", prompt.alias("prompt")), fn, "base", "Answer with a verdict and your reasoning, as JSON.", budget=budget, order=("mr_iid", "id"))
    r = F.from_json(json_of(F.col("answer")), "struct<verdict:string,reasoning:string>")
    return answered.where("answer is not null").select("mr_iid", F.col("id").alias("finding_id"), F.coalesce(r["verdict"], F.lit("confirmed")).alias("verdict"), F.coalesce(r["reasoning"], F.lit("")).alias("reasoning"))


def report(judged: DataFrame, scans: DataFrame, fn: models.ModelFn = models.stub, budget: models.Budget | None = None) -> DataFrame:
    """Of the findings of each review (mr_iid, ..., verdict) the model's report: mr_iid, inline, summary."""
    listed = judged.groupBy("mr_iid").agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "status", "issue", "locations", "confidence", "verdict")))).alias("findings"))  # the findings of one review
    rows = listed.join(scans, "mr_iid", "left").select("mr_iid", F.concat(F.lit("<landscape>"), F.coalesce("landscape", F.lit("{}")), F.lit("</landscape>\n<verified_findings>"), "findings", F.lit("</verified_findings>")).alias("prompt"))
    answered = models.ask(rows, fn, "base", "Write the review as JSON: inline comments and a summary.", budget=budget, order=("mr_iid",))
    return findings.parse_report(answered.where("answer is not null").select("mr_iid", json_of(F.col("answer")).alias("raw")))


def review(changes: DataFrame, patterns: DataFrame, fn: models.ModelFn = models.stub, max_tokens: int = diffs.MAX_TOKENS, verify_most: int = 5, budget: models.Budget | None = None) -> dict[str, DataFrame]:
    """changes (mr_iid, diff) and dismissed patterns (pattern, count) to chunks, landscape, findings, consensus (gated),
    to_verify, verdicts and report. Answers are materialised, so every step sees the same ones; a budget binds all of them."""
    chunks = diffs.chunk_rows(changes.select("mr_iid", "diff"), max_tokens=max_tokens)
    scans = landscape(changes, fn, budget)
    found = findings.all_findings(reviews(chunks, fn, budget))
    agreed = cut(findings.feedback_gate(findings.consensus(found, ["mr_iid"]), patterns))
    chosen = findings.to_verify(agreed, ["mr_iid"], "id", verify_most)
    verdicts = verify(chosen, changes, scans, fn, budget)
    judged = agreed.join(verdicts.select("mr_iid", F.col("finding_id").alias("id"), "verdict", "reasoning"), ["mr_iid", "id"], "left")
    kept = judged.where("verdict is null or lower(verdict) <> 'rejected'")
    return {"chunks": chunks, "landscape": scans, "findings": found, "consensus": agreed, "to_verify": chosen, "verdicts": verdicts, "report": report(kept, scans, fn, budget)}


def risk_of(edges: DataFrame, changed: DataFrame, max_depth: int = 3) -> DataFrame:
    """G9 for changed files (path) over edges (src, dst, rel): what calls or imports their symbols, directly or not."""
    deps = edges.where("rel in ('CALLS', 'IMPORTS')")
    inside = edges.where("rel = 'CONTAINS'").join(changed, F.col("src") == F.col("path")).select(F.col("path").alias("root"), F.col("dst").alias("node"))
    seeds = inside.union(changed.select(F.col("path").alias("root"), F.col("path").alias("node")))
    return graph.risk_map(graph.reach(deps, seeds, max_depth), changed.select(F.col("path").alias("root")))
