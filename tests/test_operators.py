"""Operators on hand-made rows, with the awkward cases of each."""

from __future__ import annotations

import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import aggregates as A
from quillstone.operators import code_index as C
from quillstone.operators import diffs as D
from quillstone.operators import findings as N
from quillstone.operators import graph as G
from quillstone.operators import joins as J
from quillstone.operators import pivots as P
from quillstone.operators import ranking as R
from quillstone.operators import stories as S
from quillstone.operators import vectors as V
from quillstone.operators import windows as W
from quillstone.sources import config, files


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def values(spark, column, items, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r["v"] for r in df.orderBy("i").select(column(F.col("x")).alias("v")).collect()]


# coercions -----------------------------------------------------------------------------------
def test_coercions(spark):
    assert values(spark, T.token_estimate, ["hello world", ""]) == [3, 0]
    assert values(spark, lambda c: T.token_estimate(c, utf16=True), ["a😀bcd"]) == [2]
    assert values(spark, T.coerce_emotion, ["certain", "uneasy", " Concerned ", "invalid", "", None]) == ["certain", "uneasy", "concerned", "uneasy", "uneasy", "uneasy"]
    assert values(spark, T.parse_confidence, ["0.8", "1.5", "-0.5", "not a number", "NaN", None, ""]) == [0.8, 1, 0, 0.5, 0.5, 0, 0]
    assert values(spark, T.import_target, ["import a from './x'", "import a from './x.tsx'", "import {b} from \"pkg\"", "from a.b import c", 'import "fmt"', "use a::b;", "none"]) == ["./x.ts", "./x.tsx", "pkg", "a/b.py", "fmt", "a/b.rs", None]
    assert values(spark, T.json_of, ['x ```json\n{"a": 1}\n``` y', '{"a": 2}', "none"]) == ['{"a": 1}', '{"a": 2}', None]
    assert values(spark, T.to_list, ["- a\n\n• b\n  c  ", ""]) == [["a", "b", "c"], []]
    assert values(spark, lambda c: T.extract_field(c, "issue"), ["Issue:  bad \nx", "none"]) == ["bad", None]


# diffs ---------------------------------------------------------------------------------------
def brute_chunks(diff, max_tokens):
    """A plain restatement of the packing rules."""
    import re

    most = 4 * max_tokens
    names = []
    for line in diff.split("\n"):
        for m in (re.match(r"^diff --git a/.+ b/(.+)$", line), re.match(r"^\+\+\+ b/(.+)$", line)):
            if m and m[1] not in names:
                names.append(m[1])
    if len(diff) <= most:
        return [(diff, -(-len(diff) // 4), names)]
    sections, file, held = {}, "", []
    for line in diff.split("\n"):
        m = re.match(r"^diff --git a/(.+?) b/(.+)$", line)
        n = re.match(r"^\+\+\+ b/(.+)$", line)
        if m or n:
            if file:
                sections[file] = "\n".join(held)
            file, held = m[2] if m else n[1], []
        held.append(line)
    if file:
        sections[file] = "\n".join(held)
    units = []
    for file, s in sections.items():
        if len(s) <= most:
            units.append((file, s, False))
            continue
        hunks, lines = [], s.split("\n")
        for i, line in enumerate(lines):
            if i and line.startswith("@@") or not hunks:
                hunks.append([])
            hunks[-1].append(line)
        units += [(file, "\n".join(h), i == 0) for i, h in enumerate(hunks)]
    out, parts, files_, size = [], [], [], 0
    for file, text, opens in units:
        if parts and (opens or len(text) > most or size + len(text) > most):
            out.append(("\n".join(parts), -(-len("\n".join(parts)) // 4), files_))
            parts, files_, size = [], [], 0
        if len(text) > most:
            out.append((text[: most - 100] + "\n... [TRUNCATED - diff too large] ...\n", max_tokens, [file]))
        else:
            parts, files_, size = [*parts, text], files_ if file in files_ else [*files_, file], size + len(text)
    if parts:
        out.append(("\n".join(parts), -(-len("\n".join(parts)) // 4), files_))
    return out


def test_small_and_large_diffs(spark):
    small = "diff --git a/file.ts b/file.ts\n+hello"
    large = "\n".join(f"diff --git a/f{i} b/f{i}\n" + "a" * 5000 for i in range(3))
    got = values(spark, lambda c: D.chunks(c, 1000), [small, large])
    assert [tuple(c) for c in got[0]] == [(small, 10, ["file.ts"])]
    assert len(got[1]) == 3 and all(c["estimated_tokens"] == 1000 for c in got[1])


def test_random_diffs(spark):
    rng = random.Random(4)
    diffs = ["", "no header at all" * 40]
    for _ in range(60):
        lines = []
        for _ in range(rng.randrange(1, 60)):
            f = f"src/f{rng.randrange(4)}.ts"
            lines.append(rng.choice([f"diff --git a/{f} b/{f}", f"+++ b/{f}", "--- a/x", "+++ /dev/null", "@@ -1 +1 @@", "+" + "x" * rng.randrange(300), " ctx", "index 1..2"]))
        diffs.append("\n".join(lines))
    got = values(spark, lambda c: D.chunks(c, 120), diffs)
    for d, g in zip(diffs, got):
        assert [(c["content"], c["estimated_tokens"], c["files"]) for c in g] == brute_chunks(d, 120)


def test_paths_and_prompt(spark):
    d = "--- a/x\n+++ b/y\n+z"
    assert values(spark, D.changed_paths, [d]) == [["a/x", "b/y"]]
    assert "--- Chunk 1/1 (y) ---" in values(spark, lambda c: D.chunk_prompt(D.chunks(c)), [d])[0]


# graph ---------------------------------------------------------------------------------------
def test_reach_with_cycle_diamond_and_clamp(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "b"), ("d", "a"), ("e", "d"), ("f", "e")], "src string, dst string")
    seeds = spark.createDataFrame([("a", "a")], "root string, node string")
    r = lambda d: {x["node"]: x["depth"] for x in G.reach(e, seeds, d).collect()}
    assert r(3) == {"b": 1, "d": 1, "c": 2, "e": 2, "f": 3} and r(0) == {"b": 1, "d": 1} and r(11) == r(10)
    m = G.risk_map(G.reach(e, seeds, 3), seeds.union(spark.createDataFrame([("z", "z")], "root string, node string")))
    rows = {x["root"]: x for x in m.collect()}
    assert rows["a"]["risk"] == pytest.approx(7 / 20) and rows["z"]["risk"] == 0 and rows["z"]["direct"] == []


def test_dependents_as_coded(spark):
    e = spark.createDataFrame([("x::f", "m.ts", "IMPORTS"), ("y::g", "x::f", "CALLS"), ("m.ts", "m.ts::a", "CONTAINS"), ("m.ts", "m.ts::b", "CONTAINS")], "src string, dst string, rel string")
    f = spark.createDataFrame([("m.ts",)], "path string")
    got = sorted(tuple(r) for r in G.dependents_as_coded(e, f).collect())
    assert got == [("m.ts", "x::f", 2, "CONTAINS")] * 2 + [("m.ts", "y::g", 3, "CONTAINS")] * 2
    assert {tuple(r) for r in G.direct_dependents(e, f).collect()} == {("m.ts", "x::f")}
    assert G.direct_dependents(e, f, "as_coded").count() == 0


def test_call_resolution(spark):
    rows = [(0, "run", "function", "a.py", ["helper", "b.py::run", "nothing"]), (1, "run", "function", "b.py", ["run", "x.y.helper"]), (2, "helper", "function", "a.py", []), (3, "helper", "function", "b.py", ["run"]), (4, "helper", "import", "c.py", [])]
    s = spark.createDataFrame(rows, "ord long, name string, kind string, file string, calls_to array<string>").withColumn("called_by", F.array().cast("array<string>"))
    got = {(r["caller"], r["callee"]): r["target"] for r in G.resolve_calls(s).collect()}
    assert got == {("a.py::run", "helper"): "a.py::helper", ("a.py::run", "b.py::run"): "b.py::run", ("b.py::run", "x.y.helper"): "b.py::helper", ("b.py::helper", "run"): "b.py::run"}
    by = {f"{r['file']}::{r['name']}": r["called_by"] for r in G.called_by(s).collect() if r["kind"] == "function"}
    assert by["b.py::run"] == ["a.py::run", "b.py::helper"] and by["a.py::run"] == []


def test_risk_map_from_json(spark):
    raw = spark.createDataFrame([(1, "oops", ["a", "b"]), (2, '[{"risk": 0.7}, {"changed": "z"}]', ["a", "b"])], "mr int, json string, changed_files array<string>")
    assert sorted((r["mr"], r["changed"], r["risk"]) for r in G.risk_map_from_json(raw).collect()) == [(1, "a", 0.1), (1, "b", 0.1), (2, "a", 0.7), (2, "z", 0.1)]


# code ----------------------------------------------------------------------------------------
def test_symbols(spark):
    py = "import os\nX = f()\nclass A:\n    def run(self):\n        self.go(1)\n        a.b.c()\n\ndef broken_not(): pass\n"
    ts = "import { a } from './a'\nexport function go(x) {\n  a.b(x)\n  if (x) { go2() }\n}\nclass K {}\nconst v = call()\n"
    df = spark.createDataFrame([("m.py", py), ("m.ts", ts), ("bad.py", "def ("), ("x.md", "def f(): pass"), ("n.py", None)], "path string, text string")
    rows = C.index(df).collect()
    got = {(r["file"], r["name"], r["kind"]): r for r in rows}
    assert got["m.py", "run", "function"]["calls_to"] == ["self.go", "a.b.c"] and got["m.py", "A", "class"]["end_line"] == 6
    assert ("m.py", "X", "variable") in got and ("m.py", "import os", "import") in got
    assert got["m.ts", "go", "function"]["calls_to"] == ["a.b", "go2"] and ("m.ts", "K", "class") in got and ("m.ts", "v", "variable") in got
    assert {r["file"] for r in rows} == {"m.py", "m.ts"}


# findings ------------------------------------------------------------------------------------
def test_consensus_and_gate(spark):
    logic = spark.createDataFrame([(1, "Null  deref here", "a.ts:1", 0.9, "certain"), (1, "other", "b.ts:2", None, "x")], "mr_iid int, issue string, location string, confidence double, emotion string")
    risk = spark.createDataFrame([(1, "null deref here", "A.ts:1", 0.7)], "mr_iid int, risk string, propagation string, confidence double")
    c = {r["issue"].lower(): r for r in N.consensus(N.all_findings({"logic": logic, "risk": risk}), ["mr_iid"]).collect()}
    both = c["null  deref here"] if "null  deref here" in c else c["null deref here"]
    assert both["status"] == "agreed" and both["confidence"] == pytest.approx(0.8) and both["escalate"] and both["sources"] == ["logic", "risk"]
    assert c["other"]["status"] == "disputed" and c["other"]["confidence"] == 0.5
    f = spark.createDataFrame([(1, "Missing null check on user input", 0.9, True, "r"), (2, "something else entirely", 0.3, True, "r")], "id int, issue string, confidence double, escalate boolean, reason string")
    p = spark.createDataFrame([("null check missing", 3), ("user input check", 2), ("abc", 9), ("a1b2c3d4e5f6", 8)], "pattern string, count long")
    got = {r["id"]: r for r in N.feedback_gate(f, p).collect()}
    assert got[1]["confidence"] == 0.4 and not got[1]["escalate"] and got[1]["reason"].endswith("dismissed 3x]")
    assert got[2]["matched"] is None and got[2]["escalate"]
    assert N.feedback_gate(f, p.limit(0)).count() == 2


def test_consensus_rows_made_regular(spark):
    raw = spark.createDataFrame([("AGREED", "x", None, ["l"], "0.8", "false", None), ("contested", None, ["a"], None, "1.5", None, "r"), ("dismissed", "y", [], [], "nan?", "true", "")], "status string, issue string, sources array<string>, locations array<string>, confidence string, escalate string, reason string")
    a, b, c = N.normalise_consensus(raw).collect()
    assert (a["status"], a["confidence"], a["escalate"], a["sources"]) == ("agreed", 0.8, False, []) and (b["status"], b["confidence"], b["issue"], b["escalate"]) == ("disputed", 1.0, "", False)
    assert (c["status"], c["confidence"], c["escalate"]) == ("dismissed", 0.5, True)
    assert N.normalise_consensus(raw, "as_coded").collect()[0]["escalate"]


def test_report(spark):
    raw = spark.createDataFrame([('{"inline": [{"file": "a", "line": "3", "severity": "bad"}]}',), ("plain text",)], "raw string")
    a, b = N.parse_report(raw).collect()
    assert tuple(a["inline"][0]) == ("a", 3, "note", "") and a["summary"] == "" and b["inline"] == [] and b["summary"] == "plain text"


# order ---------------------------------------------------------------------------------------
def test_budget_gate_limits(spark):
    df = spark.createDataFrame([("r", i, "frontier", 10_000) for i in range(6)], "run_id string, seq int, tier string, tokens long")
    ok = lambda **k: [r["admitted"] for r in W.budget_gate(df, "run_id", ["seq"], **k).orderBy("seq").collect()]
    assert ok(max_calls=2, max_cost=9.0) == [True, True, False, False, False, False]
    assert ok(max_calls=9, max_cost=0.3) == [True, True, False, False, False, False]


def test_clusters_are_anchored(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.0, 0.4, 0.8, 1.2, 5.0])], "g int, i int, top double")
    assert [r["cluster"] for r in W.clusters(df, ["g"], "top", 0.5).orderBy("i").collect()] == [1, 1, 2, 2, 3]


def test_allocation():
    assert W.allocate([1, 1, 1], 10) == [4, 3, 3] and sum(W.allocate([5, 0.1, 0.1], 8)) == 8 and W.allocate([], 3) == []


# joins, votes, pivots ------------------------------------------------------------------------
def test_overlaps_match_all_pairs(spark):
    rng = random.Random(2)
    boxes = [(g, i, rng.uniform(0, 30), rng.uniform(0, 30), rng.uniform(0, 9), rng.uniform(0, 9)) for g in (1, 2) for i in range(40)]
    df = spark.createDataFrame(boxes, "page int, id int, left double, top double, width double, height double")
    want = set()
    for a in boxes:
        for b in boxes:
            w, h = (min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k]) for k in (2, 3))
            if a[0] == b[0] and a[1] < b[1] and w > 0.05 and h > 0.05:
                want.add((a[0], a[1], b[1], round(w * h, 2)))
    assert {tuple(r) for r in J.overlaps(df, ["page"]).collect()} == want


def test_pivots_skip_and_fill(spark):
    df = spark.createDataFrame([(None, "x", "1"), ("a", "x", "2.005"), ("a", "y", "text"), ("b", "y", "n/a")], "r string, c string, v string")
    assert sorted((r["r"], r["v_count"]) for r in P.flat_pivot(df, ["r"], [("v", "sum"), ("v", "count")]).collect()) == [("None", 1.0), ("a", 1.0)]
    assert {r["r"] for r in P.flat_pivot(df, ["r"], [("v", "sum")]).collect()} == {"None", "a"}
    assert {tuple(r) for r in P.cross_tab(df, ["r"], "c", "v").collect()} >= {("None", 1.0, 0.0), ("b", 0.0, 0.0)}


def test_alerts_on_bounds(spark):
    w = spark.createDataFrame([("a", 1.0, 10.0, 5.0, True, "buy", 10.0, "sell"), ("b", 1.0, 10.0, 5.0, True, None, 5.0, "x"), ("c", 1.0, 3.0, 5.0, False, "x", 4.0, "y")], "ticker string, price_at_add double, target_price double, stop_price double, alert_on_signal boolean, last_signal string, current_price double, current_signal string")
    assert sorted((r["ticker"], r["alert"]) for r in P.alerts(w).collect()) == [("a", "signal_change"), ("a", "target_hit"), ("b", "stop_hit"), ("c", "stop_hit"), ("c", "target_hit")]


def test_statistics_of_few_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 4.0), ("c", None)], "k string, v double")
    got = {r["k"]: tuple(r)[1:] for r in A.group_stats(df, ["k"], "v").collect()}
    assert got["a"] == (1, 1.0, 0.0, 1.0, 1.0) and got["b"] == (2, 3.0, 1.4142, 2.0, 4.0) and got["c"] == (0, 0.0, 0.0, 0.0, 0.0)


def test_best_match(spark):
    df = spark.createDataFrame([(1, 0, "Minimal", "dark", ["Dark"]), (1, 1, "dark theme", "x", ["Dark"]), (2, 0, "qq", "y", ["dark"]), (2, 1, "zz", "dark", ["dark"]), (3, 0, "c", "x", []), (3, 1, "d", "x", [])], "q int, ord int, name string, kw string, want array<string>")
    assert {r["q"]: r["name"] for r in R.best_match(df, ["q"], "name", "kw", [], "want", "ord").collect()} == {1: "dark theme", 2: "zz", 3: "c"}


def test_stories(spark):
    assert one(spark, S.time_markers(F.lit("At dawn on Day 3; 2 days later. **Date:** May 1\nx"))) == [(11, "3"), (18, "2"), (32, "May 1")]
    assert one(spark, S.listed_names(F.lit("**Characters:** Ann, Bob & Cy and Di\n**POV:** Ann"))) == ["Ann", "Bob", "Cy", "Di", "Ann"]
    docs = spark.createDataFrame([(1, "ann met Bob. Ann is a 30 year old with brown hair. Ann has eyes.")], "doc_id int, text string")
    sheets = spark.createDataFrame([("p", "# Ann\n**Age:** 31 years\nHair: red\nEyes: blue\n**Aliases:** A; Annie"), ("q", "no title")], "path string, text string")
    prof = S.profiles(sheets)
    assert [(r["name"], r["aliases"]) for r in prof.collect()] == [("Ann", ["A", "Annie"])]
    got = sorted((r["attribute"], r["known"]) for r in S.contradictions(docs, prof).collect())
    assert got == [("age", "31"), ("hair", "red")]
    assert [tuple(r) for r in S.name_variants(docs, prof).collect()] == [(1, "Ann", ["ann"])]


def test_vectors(spark):
    p = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0, 1.0]), ("d", [2.0, 0.0])], "id string, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vector array<double>")
    assert [(r["id"], round(r["score"], 6)) for r in V.top_k(p, q, 3).orderBy("rank").collect()] == [("a", 1.0), ("d", 1.0), ("c", 0.707107)]


def test_top_k_in_blocks(spark):
    rng = random.Random(9)
    p = spark.createDataFrame([(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(40)], "id int, vector array<double>")
    q = p.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    at_once, dealt = ({tuple(r) for r in V.top_k(p, q, 5, block=n).collect()} for n in (40, 7))
    assert dealt == at_once and len(dealt) == 200
    many = spark.range(10_001).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("query_vector"))
    assert V.top_k(p, many, 1).count() == 10_001


# sources -------------------------------------------------------------------------------------
def test_files(spark, tmp_path):
    for f, t in {"a/x.py": "x = 1", "a/node_modules/y.py": "y", "b.ts": "let z = 1", "c.txt": "no", "n/r.md": "# t", ".h/s.md": "# s"}.items():
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text(t)
    assert sorted(r["text"] for r in files.repository(spark, str(tmp_path)).collect()) == ["let z = 1", "x = 1"]
    assert [r["text"] for r in files.markdown(spark, str(tmp_path)).collect()] == ["# t"]
    assert one(spark, files.decoded(F.lit(base64.b64encode("é".encode()).decode()))) == "é" and one(spark, files.decoded(F.lit("***"))) is None


def test_ranges(spark):
    assert files.parse_range("Sales!A1:AB10") == ("Sales", 1, 1, 28, 10) and files.parse_range("'My sheet'!$B$2:C3") == ("My sheet", 2, 2, 3, 3)
    with pytest.raises(ValueError):
        files.parse_range("nothing")
    cells = spark.createDataFrame([("S", 1, 1, "k"), ("S", 1, 2, "v"), ("S", 2, 1, "a"), ("S", 2, 2, "1"), ("S", 4, 2, "2"), ("T", 2, 1, "no")], "sheet string, row int, col int, value string")
    assert sorted(tuple(r) for r in files.cell_range(cells, "S!A1:B9").select("row", "k", "v").collect()) == [(2, "a", "1"), (4, None, "2")]


def test_run_results(spark, tmp_path):
    for path, body in {
        "eval-1/with/run-1/grading.json": {"summary": {"pass_rate": 0.5, "passed": 1, "failed": 1, "total": 2}, "execution_metrics": {"output_chars": 40, "total_tool_calls": 3}},
        "eval-1/with/run-1/timing.json": {"total_duration_seconds": 7.5},
        "eval-2/without/run-3/grading.json": {"summary": {"pass_rate": 1.0, "passed": 2, "failed": 0, "total": 2}, "timing": {"total_duration_seconds": 2.0}},
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(json.dumps(body))
    (tmp_path / "eval-2/without/run-4").mkdir()
    (tmp_path / "eval-2/without/run-4/grading.json").write_text("{broken")
    got = sorted((r["config"], r["eval_id"], r["run_number"], r["time_seconds"], r["tokens"], r["tool_calls"]) for r in files.run_results(spark, str(tmp_path)).collect())
    assert got == [("with", 1, 1, 7.5, 40, 3), ("without", 2, 3, 2.0, 0, 0)]


def test_config():
    s = config.Settings.of({"MAX_LLM_CALLS": "3", "ENABLE_COVE": "false"})
    assert s.max_llm_calls == 3 and s.enable_cove is False
    with pytest.raises(ValueError):
        config.Settings.of({"PORT": "-1"})
    m = config.parse_model_map('{"report": "frontier", "x": "base", "riskMap": "odd"}')
    assert m["report"] == "frontier" and m["riskMap"] == "base" and len(m) == 8 and config.parse_model_map("{") == config.DEFAULT_TIERS
    assert [config.max_tokens(t) for t in ("cheap", "base", "frontier", "embedding")] == [2048, 4096, 8192, 8192]


# review --------------------------------------------------------------------------------------
def test_review_and_tools(spark):
    from quillstone import api, models
    from quillstone.plans import review

    diff = "diff --git a/x.ts b/x.ts\n+++ b/x.ts\n@@ -1 +1 @@\n+// TODO check null user input\n+ok"
    changes = spark.createDataFrame([(1, diff), (2, "diff --git a/y b/y\n+fine")], "mr_iid int, diff string")
    none = spark.createDataFrame([], "pattern string, count long")
    out = review.review(changes, none)
    rows = out["consensus"].collect()
    assert [(r["mr_iid"], r["status"], len(r["sources"])) for r in rows] == [(1, "agreed", 3)]
    gated = review.review(changes, spark.createDataFrame([("check null input", 3)], "pattern string, count long"))["consensus"].first()
    assert gated["confidence"] == 0.4 and "FEEDBACK" in gated["reason"]
    edges = spark.createDataFrame([("a.ts", "a.ts::f", "CONTAINS"), ("b.ts::g", "a.ts::f", "CALLS"), ("c.ts::h", "b.ts::g", "CALLS"), ("d.ts", "a.ts", "IMPORTS")], "src string, dst string, rel string")
    nodes = spark.createDataFrame([("a.ts::f", "f"), ("b.ts::g", "g")], "qualified_name string, name string")
    tool = api.CodeReview(edges, nodes)
    r = tool.check_risk(["a.ts", "z.ts"]).orderBy("root").collect()
    assert (r[0]["direct"], r[0]["indirect"], r[0]["risk"]) == (["b.ts::g", "d.ts"], ["c.ts::h"], 0.25) and r[1]["risk"] == 0.0
    assert [x["node"] for x in tool.query_graph("f").collect()] == ["b.ts::g", "c.ts::h"]
    assert tool.explain_symbol("f").first()["callers"] == ["b.ts::g"] and tool.review_snippet(diff).count() == 1 and tool.find_patterns("x").count() == 0
    assert models.stub("base", "", "+ TODO a") == models.stub("base", "", "+ TODO a")


def test_budget_and_retries():
    from quillstone import models

    b, waits, fails = models.Budget(max_calls=2), [], [models.Transient(), models.Transient()]

    def fn(tier, system, prompt):
        if fails:
            raise fails.pop()
        return "ok"

    call = models.with_budget(fn, b, wait=waits.append)
    assert call("base", "", "x") == "ok" and waits == [1.0, 2.0]
    call("cheap", "", "x")
    with pytest.raises(models.BudgetExceeded):
        call("base", "", "x")
    assert b.calls == {"base": 1, "cheap": 1}
    b.reset()
    assert b.cost == 0 and b.calls == {}


def test_budget_binds_over_partitions(spark):
    """Of calls and cost, whichever runs out first; what was used is on the budget; no answer is paid twice."""
    from quillstone import models

    rows = spark.range(40).selectExpr("id", "concat('prompt ', id) AS prompt").repartition(8)
    asked = spark.sparkContext.accumulator(0)

    def fn(tier, system, prompt):
        asked.add(1)
        return "x" * 400

    b = models.Budget(max_calls=3)
    out = models.ask(rows, fn, "base", "sys", budget=b, order=("id",))
    got = {r["id"]: r["answer"] for r in out.collect()}
    assert len(got) == 40 and {i for i, a in got.items() if a} == {0, 1, 2} and out.count() == 40
    assert asked.value == 3 and b.calls == {"base": 3} and b.tokens["base"] == 3 * 103
    assert all(r["answer"] is None for r in models.ask(rows, fn, "base", "sys", budget=b, order=("id",)).collect()) and asked.value == 3
    dear = models.Budget(max_calls=25, max_cost=0.04)  # 0.015 USD a call of some 1000 tokens
    models.ask(rows, fn, "frontier", "sys", budget=dear, order=("id",), reserve=1000)
    assert dear.calls == {"frontier": 3}


def test_review_steps(spark):
    import json

    from quillstone import models
    from quillstone.plans import review

    def fn(tier, system, prompt):
        if system.startswith("Describe"):
            return json.dumps({"files": prompt.count("diff --git")})
        if system.startswith("Find"):
            return json.dumps({"findings": [{"issue": "null check missing", "location": "a.py:1", "risk": "null check missing", "propagation": "a.py:1", "deviation": "odd", "evidence": "a.py:2", "confidence": 0.6}]})
        if system.startswith("Answer"):
            return json.dumps({"verdict": "rejected" if "odd" in prompt else "confirmed", "reasoning": "r"})
        return json.dumps({"inline": [{"file": "a.py", "line": 1, "severity": "critical", "body": "b"}], "summary": f"{prompt.count('issue')} left"})

    changes = spark.createDataFrame([(1, "diff --git a/a.py b/a.py\n@@ -1 +1 @@\n+x\n")], "mr_iid int, diff string")
    none = spark.createDataFrame([], "pattern string, count long")
    out = review.review(changes, none, fn)
    assert [r["landscape"] for r in out["landscape"].collect()] == ['{"files":1}']
    assert {r["issue"]: r["status"] for r in out["consensus"].collect()} == {"null check missing": "agreed", "odd": "disputed"}
    verdicts = {r["verdict"] for r in out["verdicts"].collect()}
    assert "rejected" in verdicts
    report = out["report"].first()
    assert report["summary"] == "1 left" and report["inline"][0]["severity"] == "critical"
    bound = review.review(changes, none, fn, budget=models.Budget(max_calls=2))
    assert bound["findings"].count() == 1 and bound["report"].count() == 0


def test_posting(spark):
    sent = []

    def send(mr, path, payload):
        if path == "discussions" and mr == 2 or mr == 3:
            raise ConnectionError("refused")

    requests = spark.createDataFrame([(1, "discussions", "p", "f"), (2, "discussions", "p", "f"), (3, "notes", "p", None)], "mr_iid long, path string, payload string, fallback string")
    from quillstone.operators import findings

    got = {r["mr_iid"]: r["result"] for r in findings.post(requests, send, wait=sent.append).collect()}
    assert got == {1: "posted", 2: "fallback", 3: "failed"}


def test_words_beyond_ascii(spark):
    from quillstone.operators import stories

    docs = spark.createDataFrame([(1, "Herr Müller kam"), (2, "Müllers Haus"), (3, "der MÜLLER"), (4, "x")], "doc_id int, text string")
    names = spark.createDataFrame([("Müller",), ("Herr Müller",)], "term string")
    assert {tuple(r) for r in stories.mentions(docs, names).collect()} == {(1, "Müller"), (1, "Herr Müller"), (3, "Müller")}
    assert [tuple(r) for r in stories.name_variants(docs, spark.createDataFrame([("Müller",)], "name string")).collect()] == [(3, "Müller", ["MÜLLER"])]


def test_oldest_leaves_the_newest(spark):
    from quillstone.operators import aggregates

    df = spark.range(50).selectExpr("id", "id % 17 AS x")
    assert [r["id"] for r in aggregates.oldest(df, "id", 45).collect()] == [0, 1, 2, 3, 4]
    assert aggregates.oldest(df, "id", 60).count() == 0 and aggregates.oldest(df, "id", 0).count() == 50
