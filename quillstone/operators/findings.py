"""Reviewers' findings: one shape, consensus, feedback gate, verdicts and report."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import coerce_emotion, coerce_number, coerce_severity, coerce_verdict, consensus_status, finding_id, parse_confidence
from quillstone.lineage import cut
from quillstone.operators.windows import first_per_group

ESCALATE_BELOW, GATED, FREQUENT = 0.8, 0.4, 3
#: Frequent patterns that are taken.
MAX_PATTERNS = 200
#: Where each reviewer's rows have what a finding has. E3: further reviewers are further entries.
REVIEWERS = {
    "logic": {"issue": "issue", "location": "location"},
    "risk": {"issue": "risk", "location": "propagation"},
    "consistency": {"issue": "deviation", "location": "evidence"},
}


def map_findings(rows: DataFrame, reviewer: str, semantics: str = "documented") -> DataFrame:
    """K4: a reviewer's rows in the common shape."""
    m = REVIEWERS[reviewer]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    given = F.col("confidence").cast("string") if "confidence" in rows.columns else F.lit(None).cast("string")
    confidence = F.when(given.isNull(), F.lit(0.5)).otherwise(parse_confidence(given, semantics))
    return rows.select(
        *[c for c in ("mr_iid", "ord") if c in rows.columns], F.lit(reviewer).alias("reviewer"), text(m["issue"]).alias("issue"), text(m["location"]).alias("location"),
        text("corner_case").alias("corner_case"), confidence.alias("confidence"), coerce_emotion(text("emotion")).alias("emotion"), text("evidence").alias("evidence"),
    )


def all_findings(reviews: dict[str, DataFrame]) -> DataFrame:
    """The findings of all reviewers."""
    out = None
    for name, rows in reviews.items():
        f = map_findings(rows, name)
        out = f if out is None else out.unionByName(f)
    return out


def consensus(findings: DataFrame, by: list[str] | None = None, agg: str = "average") -> DataFrame:
    """K2: findings on one place and issue are one: agreed from two reviewers on, escalated if any source is below 0.8."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    middle = F.avg("confidence") if agg == "average" else F.percentile("confidence", 0.5)
    g = findings.groupBy(*(by or []), norm("location").alias("_l"), norm("issue").alias("_i")).agg(
        F.min("issue").alias("issue"), F.array_sort(F.collect_set("reviewer")).alias("sources"), F.array_sort(F.collect_set("location")).alias("locations"),
        middle.alias("confidence"), (F.min("confidence") < ESCALATE_BELOW).alias("escalate"),
    )
    status = F.when(F.size("sources") >= 2, "agreed").otherwise("disputed")
    return g.select(*(by or []), finding_id(F.col("issue"), F.col("locations")).alias("id"), status.alias("status"), "issue", "sources", "locations", "confidence", "escalate", F.concat(F.size("sources").cast("string"), F.lit(" reviewer(s)")).alias("reason"))


def normalise_consensus(raw: DataFrame, semantics: str = "documented") -> DataFrame:
    """K1: given consensus rows with status, confidence, escalation, lists and id made regular."""
    none = F.array().cast("array<string>")
    issue, locations = F.coalesce("issue", F.lit("")), F.coalesce("locations", none)
    n = F.when(F.col("confidence").isNull(), F.lit(0.5)).otherwise(coerce_number(F.col("confidence")) if semantics == "as_coded" else parse_confidence(F.col("confidence")))
    said = F.lower(F.trim(F.coalesce(F.col("escalate").cast("string"), F.lit(""))))
    given = (said != "") if semantics == "as_coded" else said.isin("true", "1", "yes")
    out = raw.select(
        *[c for c in raw.columns if c not in ("id", "status", "issue", "sources", "locations", "confidence", "escalate", "reason")], finding_id(issue, locations).alias("id"), consensus_status(F.coalesce("status", F.lit("disputed"))).alias("status"),
        issue.alias("issue"), F.coalesce("sources", none).alias("sources"), locations.alias("locations"), n.alias("confidence"), given.alias("_given"), F.coalesce("reason", F.lit("")).alias("reason"),
    )
    low = ~F.isnan("confidence") & (F.col("confidence") < ESCALATE_BELOW)
    return out.withColumn("escalate", F.col("_given") | low).drop("_given")


def pattern_words(pattern: Column) -> Column:
    return F.filter(F.split(F.lower(pattern), r"\s+"), lambda w: F.length(w) > 3)


def matching_pattern(findings: DataFrame, patterns: DataFrame) -> DataFrame:
    """Findings with the first pattern (pattern, count; by count, then name) of whose longer words at least two, and half, occur in the issue.

    Patterns are a short report; more than MAX_PATTERNS frequent ones are refused. They become constants, so that
    no finding is moved and nothing is joined.
    """
    p = patterns.where(F.col("count") >= FREQUENT).select("pattern", "count", pattern_words(F.col("pattern")).alias("words"))
    listed = p.orderBy(F.desc("count"), "pattern").limit(MAX_PATTERNS + 1).collect()
    if len(listed) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} frequent patterns")
    issue = F.lower("issue")
    fits = [(r, len(r["words"])) for r in listed if len(r["words"]) >= 2]
    hits = lambda r: sum((F.contains(issue, F.lit(w)).cast("int") for w in r["words"]), F.lit(0))
    match = F.lit(None).cast("struct<pattern:string,count:bigint>")
    for r, n in reversed(fits):
        match = F.when((hits(r) >= 2) & (hits(r) / n >= 0.5), F.struct(F.lit(r["pattern"]).alias("pattern"), F.lit(r["count"]).cast("long").alias("count"))).otherwise(match)
    return findings.withColumn("_match", match).withColumns({"matched": F.col("_match.pattern"), "matched_count": F.col("_match.count")}).drop("_match")


def feedback_gate(findings: DataFrame, patterns: DataFrame) -> DataFrame:
    """K3, P5: matched findings are capped at 0.4, no longer escalated, and say why."""
    m = matching_pattern(findings, patterns)
    hit = F.col("matched").isNotNull()
    note = F.concat("reason", F.lit(" [FEEDBACK: similar pattern dismissed "), F.col("matched_count").cast("string"), F.lit("x]"))
    return m.withColumns({"confidence": F.when(hit, F.least("confidence", F.lit(GATED))).otherwise(F.col("confidence")), "escalate": F.col("escalate") & ~hit, "reason": F.when(hit, note).otherwise(F.col("reason"))})


def to_verify(findings: DataFrame, by: list[str], order: str, limit: int = 5) -> DataFrame:
    """The first escalated findings of each review."""
    return first_per_group(findings.where("escalate"), by, [order], limit)


def with_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings with the verdict on their id; null where there is none."""
    v = verdicts.select("finding_id", F.when(F.col("verdict").isNotNull(), coerce_verdict(F.col("verdict"))).otherwise("confirmed").alias("verdict"), "reasoning")
    return findings.join(v, findings.id == v.finding_id, "left").drop("finding_id")


REPORT = "struct<inline:array<struct<file:string,line:string,severity:string,body:string>>,summary:string>"


def parse_report(raw: DataFrame, col: str = "raw") -> DataFrame:
    """Inline comments with defaults and known severities, and the summary; text that is no JSON is the summary."""
    r = F.from_json(col, REPORT)
    none = F.array().cast("array<struct<file:string,line:int,severity:string,body:string>>")
    inline = F.transform(r["inline"], lambda x: F.struct(F.coalesce(x["file"], F.lit("")).alias("file"), F.coalesce(x["line"].try_cast("int"), F.lit(0)).alias("line"), coerce_severity(x["severity"]).alias("severity"), F.coalesce(x["body"], F.lit("")).alias("body")))
    is_json = F.try_parse_json(F.col(col)).isNotNull() & F.trim(F.col(col)).startswith("{")
    return raw.withColumns({"inline": F.when(is_json, F.coalesce(inline, none)).otherwise(none), "summary": F.when(is_json, F.coalesce(r["summary"], F.lit(""))).otherwise(F.col(col))})


def inline_note(file: Column, line: Column, body: Column) -> Column:
    """O1: the plain note that stands in for an inline comment."""
    return F.concat(F.lit("**"), file, F.lit(":"), line.cast("string"), F.lit("**\n\n"), body)


def inline_requests(comments: DataFrame, refs: DataFrame) -> DataFrame:
    """O1: inline comments (mr_iid, file, line, body, and old_file where it was renamed) with the diff_refs of their review
    as requests: path, payload, and fallback, the payload of the plain note that is posted where the first is refused."""
    c = comments if "old_file" in comments.columns else comments.withColumn("old_file", F.lit(None).cast("string"))
    j = c.join(refs.select("mr_iid", "base_sha", "start_sha", "head_sha"), "mr_iid")
    position = F.struct("base_sha", "start_sha", "head_sha", F.col("file").alias("new_path"), F.col("line").alias("new_line"), F.lit("text").alias("position_type"), F.coalesce(F.nullif("old_file", F.lit("")), "file").alias("old_path"))
    note = F.to_json(F.struct(inline_note(F.col("file"), F.col("line"), F.col("body")).alias("body")))
    return j.select("mr_iid", F.lit("discussions").alias("path"), F.to_json(F.struct("body", position.alias("position"))).alias("payload"), note.alias("fallback"))


def summary_requests(reports: DataFrame) -> DataFrame:
    """O2: the summary (mr_iid, summary) of each review as a note's request."""
    return reports.select("mr_iid", F.lit("notes").alias("path"), F.to_json(F.struct(F.col("summary").alias("body"))).alias("payload"), F.lit(None).cast("string").alias("fallback"))


def post(requests: DataFrame, send: Callable[[int, str, str], None], attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """O1, O2: sends requests from the executors, each up to so many times, then its fallback as a note; mr_iid, path and how it
    was posted (posted, fallback or failed). Materialised, so that nothing is posted twice; fit for foreachBatch."""

    def tried(mr: int, path: str, payload: str) -> bool:
        for n in range(1, attempts + 1):
            try:
                send(mr, path, payload)
                return True
            except Exception:  # noqa: BLE001  whatever the service raises
                if n < attempts:
                    wait(float(n))
        return False

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            done = []
            for mr, path, payload, fallback in zip(p["mr_iid"], p["path"], p["payload"], p["fallback"]):
                how = "posted" if tried(mr, path, payload) else "failed"
                if how == "failed" and fallback is not None and tried(mr, "notes", fallback):
                    how = "fallback"
                done.append(how)
            yield p[["mr_iid", "path"]].assign(result=done)

    return cut(requests.select("mr_iid", "path", "payload", "fallback").mapInPandas(run, "mr_iid long, path string, result string"))
