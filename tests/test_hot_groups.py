"""Operators on ordered rows whose groups are spread over several tasks, against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import windows as W


@pytest.fixture
def spread(spark):
    """Ranges that stay apart, as with many rows."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def numbered_in_order(values, tolerance):
    start, n, out = None, 0, {}
    for v in sorted(values):
        if start is None or v - start > tolerance:
            start, n = v, n + 1
        out[v] = n
    return out


@pytest.mark.parametrize("tolerance", [0.0, 0.1, 3.0, 40.0, 1000.0])
def test_clusters_over_many_chunks(spread, tolerance):
    rng = random.Random(int(tolerance * 10))
    rows = [("hot", i, rng.choice([round(rng.uniform(-50, 50), 1), rng.expovariate(0.05)])) for i in range(1500)]
    rows += [("hot", 5000 + i, 7.5) for i in range(500)] + [(f"k{i % 9}", 6000 + i, float(rng.randrange(20))) for i in range(60)]
    rows += [(None, 7000 + i, i * 2.0) for i in range(5)] + [("hot", 8000, None), ("hot", 8001, float("nan")), ("none", 8002, None)]
    got = W.clusters(spread.createDataFrame(rows, "k string, id long, v double").repartition(5), ["k"], "v", tolerance).collect()
    assert len(got) == len(rows)
    want = {k: numbered_in_order([r[2] for r in rows if r[0] == k and r[2] is not None and r[2] == r[2]], tolerance) for k in {r[0] for r in rows}}
    for r in got:
        known = want[r["k"]]
        assert r["cluster"] == (known[r["v"]] if r["v"] in known else max(known.values(), default=1)), r


def test_clusters_of_no_rows(spark):
    assert W.clusters(spark.createDataFrame([], "k string, v int"), ["k"], "v", 1.0).collect() == []


@pytest.mark.parametrize("total", [5, 60, 999, 5000])
def test_allocations_over_many_chunks(spread, total):
    rng = random.Random(total)
    groups = {"hot": [rng.choice([0.0, 1.0, 1.0, rng.uniform(0, 90), 500.0]) for _ in range(400)], "zero": [0.0] * 4, "one": [3.0], "even": [1.0] * 7, None: [1.0, 4.0, 4.0]}
    rows = [(k, i, w) for k, ws in groups.items() for i, w in enumerate(ws)] + [("lack", 0, None), ("lack", 1, 2.0)]
    groups["lack"] = [0.0, 2.0]
    got = W.allocations(spread.createDataFrame(rows, "k string, i long, w double"), ["k"], "i", "w", total).collect()
    assert len(got) == len(rows)
    for k, ws in groups.items():
        size = W.allocate(ws, total)
        mine = sorted((r["i"], r["size"], r["start"]) for r in got if r["k"] == k)
        assert mine == [(i, n, sum(size[:i])) for i, n in enumerate(size)], k


def test_sections_spans_budgets_and_skips_of_a_hot_key(spread):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, rng.randrange(6) if rng.random() > 0.05 else None) for i in range(900)] + [(None, 1000 + i, i % 4) for i in range(9)]
    df = spread.createDataFrame(rows, "k string, i long, x int").withColumns({"tier": F.lit("frontier"), "tokens": F.col("x") * 1000})
    sections, ends, skips, gates = {}, {}, set(), {}
    for k in {r[0] for r in rows}:
        n, cost, last = 0, 0.0, None
        mine = sorted((i, x) for g, i, x in rows if g == k)
        for nth, (i, x) in enumerate(mine):
            n += x == 0
            if n:
                sections[i] = n
            ends[i] = mine[nth + 1][0] if nth + 1 < len(mine) else -1
            if last is not None and x is not None and x - last > 1:
                skips.add((i, last))
            last = x
            gates[i] = (nth, round(cost, 9), nth < 100 and cost < 3.001)
            cost += (x or 0) * 1000 / 1e6 * 15.0
    assert {r["i"]: r["section"] for r in W.sections(df, ["k"], "i", F.col("x") == 0).collect()} == sections
    assert {r["i"]: r["end"] for r in W.spans(df, ["k"], "i", F.lit(-1)).collect()} == ends
    assert {(r["i"], r["previous"]) for r in W.level_skips(df, ["k"], "i", "x").collect()} == skips
    got = {r["i"]: (r["prior_calls"], round(r["prior_cost"], 9), r["admitted"]) for r in W.budget_gate(df, "k", ["i"], 100, 3.001).collect()}
    assert got == gates


def test_medians_and_capped_lists_of_a_hot_group(spread):
    from quillstone.operators import aggregates as A

    rng = random.Random(1)
    rows = [("hot", rng.choice([5, 5, rng.randrange(40)])) for _ in range(801)] + [(f"k{i % 5}", i) for i in range(32)] + [(None, 1), (None, 2), ("none", None), ("hot", None)]
    got = {r["k"]: r["m"] for r in A.upper_medians(spread.createDataFrame(rows, "k string, v int"), ["k"], "v", "m").collect()}
    values = {k: sorted(v for g, v in rows if g == k and v is not None) for k in {r[0] for r in rows}}
    assert got == {k: v[len(v) // 2] if v else None for k, v in values.items()}
    cells = [(None if i % 4 == 0 else "s", f"A{i:03}", "=X" if i % 7 else None, "#REF!" if i % 2 else "0") for i in range(300)] + [("t", "B1", "=X", "1"), ("u", "B2", None, "1")]
    out = {r["sheet"]: r for r in A.audit(spread.createDataFrame(cells, "sheet string, cell string, formula string, value string"), ["sheet"], 9, 5, 3).collect()}
    assert set(out) == {None, "s", "t"} and out["t"]["error_cells"] == [] and out["t"]["formulas"] == 1
    for sheet in (None, "s"):
        mine = [(c, v) for s, c, f, v in cells if s == sheet and f]
        errors, zeros = sorted(c for c, v in mine if "#" in v), sorted(c for c, v in mine if v == "0")
        r = out[sheet]
        assert (r["formulas"], r["errors"], r["zeros"], r["arrays"]) == (len(mine), len(errors), len(zeros), 0)
        assert (r["error_cells"], r["zero_cells"], r["array_cells"]) == (errors[:9], zeros[:5], [])


def test_oldest_with_ties_and_nulls_and_first_seen(spark):
    from quillstone.operators import aggregates as A

    df = spark.createDataFrame([(i, "d") for i in range(5)] + [(9, None)], "id int, day string")
    assert [r["id"] for r in A.oldest(df, "day", 2, "id").collect()] == [9, 0, 1, 2]
    assert [r["id"] for r in A.oldest(df, "day", 2).collect()] == [9]
    seen = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("b", None, "y"), ("b", 0, "z"), (None, 3, "w")], "k string, o int, v string")
    assert {tuple(r) for r in A.first_seen(seen, ["k"], "o").collect()} == {("a", 1, None), ("b", None, "y"), (None, 3, "w")}


def test_search_tokens_part_at_any_white_space(spark):
    from quillstone.functions.text import search_tokens

    df = spark.createDataFrame([("Foo\u00a0bar, snake_case Ünder-way a to",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(search_tokens(F.col("t"))).collect()] == [["foo", "bar", "snake_case", "ünder", "way"], [], None]


def test_bm25_is_the_same_with_looked_up_and_joined_terms(spark):
    from quillstone.operators.ranking import bm25

    docs = spark.createDataFrame([(i, " ".join(f"word{(i * j) % 11}" for j in range(i % 9))) for i in range(60)] + [(90, None), (91, "")], "id long, text string")
    queries = spark.createDataFrame([(1, "word1 word3 word3"), (2, "word0"), (3, "absent"), (4, "")], "query_id long, query string")
    looked_up, joined = ({tuple(sorted(r.asDict().items())) for r in bm25(docs, queries, vocabulary=v).collect()} for v in (20_000, 0))
    assert looked_up == joined and len(looked_up) == 6
