"""Cases that the operators' docstrings state, and independent versions of parts that the tables do not reach."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstone import lineage
from quillstone.llm import chat, common, licenses, lines, near, packing, quality, sharding, stages, urls
from tests.llm import brute

SF = "/root/testdata/sf0.001"
NAMES = "doc_id long, text string, n_chars long, score string, predicted string, n_lines string, n_dropped string, n_near string, _id string, _hash string, _gone string, _text_hash string, _leak string, _rest string"
GOOD = "The committee met on Tuesday to discuss the new proposal. Members agreed that it would help the town. "


def stage_rows(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    texts = [(1, GOOD * 3), (2, GOOD * 3 + "More was said about the roads. "), (2, GOOD * 3 + "More was said about the roads. "), (3, "Short line\nand another one that is longer than five words\n" + GOOD), (4, "short  LINE\n" + GOOD.upper()), (5, None), (6, ""), (7, "   "), (None, "nobody's text"), (None, None), (8, "so " + item), (9, "x " * 60_000)]
    return spark.createDataFrame([(d, t, None if t is None else len(t), *[f"kept{d}"] * 11) for d, t in texts], NAMES)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_and_rows_as_they_are(spark, name, stage):
    docs = stage_rows(spark)
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    rows = out.collect()
    for r in rows:
        assert set(r[3:]) == {f"kept{r['doc_id']}"}
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    ids = [r["doc_id"] for r in rows]
    if name == "line_dedup":
        texts = {r["doc_id"]: r["text"] for r in rows}
        want = {d: t for d, t in brute.kept_lines(list({(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None})).items()}
        assert {d: t for d, t in texts.items() if d is not None} == {d: t for d, t in want.items() if t is None or t.strip() or d in (6, 7)}
        assert ids.count(2) == 2 and ids.count(None) == 2
    if name == "minhash_near_dedup":
        assert 1 in ids and ids.count(2) == 2 and 5 in ids and 6 in ids and 7 in ids and ids.count(None) == 2
    if name == "benchmark_decontamination":
        assert sorted(ids, key=str) == sorted([1, 2, 2, 3, 4, 5, 6, 7, 9, None, None], key=str)
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_last_stage_packs_all_rows(spark):
    docs = stage_rows(spark)
    pieces = stages.pack(spark, docs, SF).collect()
    alone = [r for r in pieces if r["doc_id"] in (5, 6)]
    assert len(alone) == 2 and all(r["length"] == r["doc_tokens"] == 1 for r in alone)
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()}
    twice = [r for r in pieces if r["doc_id"] == 2]
    assert sum(r["length"] for r in twice) == 2 * twice[0]["doc_tokens"]
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_of_long_texts_in_parts(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "PART_CHARS", 50)
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    path = public_tokenizers.path("word_bpe_49k.json")
    t, enc = Tokenizer.from_file(path), packing.WordEncoder(path)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + ["a" * 200 + " b", " " * 130, "x, y. z.. " * 30, ""]
    assert enc.encode(texts) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_packing_looks_up_each_word_of_a_run_once():
    import public_tokenizers

    class Counted(dict):
        asked = 0

        def get(self, word):
            self.asked += 1
            return super().get(word)

    enc = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    enc.cache = Counted()
    texts = ["The cat sat. " * 2000, "the cat, the café### \n" * 2000, ""]
    got = enc.encode(texts)
    assert got == [enc.direct(t) for t in texts]
    assert enc.cache.asked < 20
    assert set(enc.cache) == {"the", "cat", "sat", "café", ".", ",", "###", ""}


@pytest.mark.parametrize("part", [1, 7, 1 << 22])
def test_packing_of_words_with_marks(monkeypatch, part):
    import public_tokenizers

    monkeypatch.setattr(packing, "PART_CHARS", part)
    enc = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    stems = ["", "a", "Z", "é", "É", "ß", "×", "a×", "÷", "º", "½", "a1", "İ", "ı", "ς", "ц", "中", "क़", "e\u0301", "E\u0301", "it's", "a\tb", "a\xa0", "x" * 60]
    marks = ["", ",", "...", "###", "'", "'s", "'s,", "<", "<\u0338", "<|", "<|endoftext|>", ",b.", "\u0301", "_", "\x7f", "»,"]
    texts = [f"{s}{m}{end}" for s in stems for m in marks for end in ("", " ", "\nB,")]
    texts += [" ".join(t for t in texts if "<|" not in t), ",", "é,", "\n"]
    assert enc.encode(texts) == [enc.direct(t) for t in texts]


# chat ------------------------------------------------------------------------------------------
EVENTS = "conv_id long, seq long, message_id string, kind string, role string, text string, n int, nth int"


def test_events_of_unknown_kinds_change_nothing(spark):
    rows = [(1, 1, "a", "message", "user", "Hello"), (1, 2, "a", "tool_call", "tool", "X"), (1, 3, "a", None, None, "Y"), (2, 1, "b", "tool_call", None, "only"), (1, 4, "b", "message", "assistant", "z" * 200_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], EVENTS)
    out = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.read_back(chat.render(chat.fold(df))).collect()}
    assert out == {1: [("user", "Hello"), ("assistant", "z" * 200_000)]}
    assert chat.read_back(chat.render(chat.fold(df.limit(0)))).count() == 0


# licenses --------------------------------------------------------------------------------------
def test_license_labels_and_scores(spark):
    rng = random.Random(4)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(80).collect()]
    for phrase, _ in (*licenses.BASE, *licenses.TEMPLATES):
        w = phrase.split()
        for _ in range(4):
            v = list(w)
            for _ in range(rng.randrange(4)):
                i, kind = rng.randrange(len(v) + 1), rng.randrange(3)
                v[i : i + (kind > 0)] = [] if kind == 2 else ["other"]
            texts.append("so it is " + " ".join(v) + rng.choice(["", " and " + " ".join(w[: len(w) // 2]) + " " * 3 + " ".join(w[len(w) // 2 :])]))
    texts += ["the mit license the mit license", "released under " + "the mit license " * 30, "cc by " * 40, None, "", "x " * 20_000 + "mit license"]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, label string, template int")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for i, t in enumerate(texts):
        labels, score = brute.license_labels(t, licenses.BASE, licenses.TEMPLATES, licenses.SLACK, licenses.COVER)
        assert (got[i]["labels"], round(got[i]["score"], 9)) == (labels, round(score, 9)), t
        assert {s["label"] for s in got[i]["spans"]} == set(filter(None, labels.split(",")))
        longest = max(len(p.split()) for p, _ in licenses.TEMPLATES) + 2 * licenses.SLACK
        assert all(0 <= s["from"] < s["to"] <= got[i]["n_words"] and s["to"] - s["from"] <= longest for s in got[i]["spans"])
    assert licenses.scan(docs.limit(0)).count() == 0


# quality ---------------------------------------------------------------------------------------
def test_lasso_is_at_its_optimum():
    """At the minimum of the penalised loss its slope is the penalty where a weight is not zero, and no more where it is."""
    rng = np.random.default_rng(3)
    a = (rng.random((800, 30)) < 0.4).astype(float)
    y = (rng.random(800) < 1 / (1 + np.exp(-(2 * a[:, 0] - 3 * a[:, 1] + 0.5)))).astype(float)
    w, b = quality._lasso(a, y)
    slope = a.T @ (1 / (1 + np.exp(-(a @ w + b))) - y) / len(y)
    assert np.all(np.abs(slope[w == 0]) <= quality.PENALTY + 1e-4)
    assert np.allclose(slope[w != 0], -quality.PENALTY * np.sign(w[w != 0]), atol=1e-4)
    assert w[0] > 1 and w[1] < -1 and np.sum(w == 0) > 5


def test_rules_state_what_was_planted():
    rng = np.random.default_rng(5)
    x = rng.random((3000, len(quality.NAMES)))
    y = ((x[:, 3] > 0.5) & (x[:, 7] <= 0.3)).astype(float)
    model = quality.fit(x, y)
    test = rng.random((3000, len(quality.NAMES)))
    plain = []
    for row in test:  # a rule holds if all of its comparisons do
        z = model.intercept + sum(w for rule, w in zip(model.rules, model.weights) if all((row[i] > v) == above for i, above, v in rule))
        plain.append(1 / (1 + np.exp(-z)))
    assert np.allclose(plain, model.predict(test))
    assert np.mean((np.array(plain) > 0.5) == ((test[:, 3] > 0.5) & (test[:, 7] <= 0.3))) > 0.97


# urls ------------------------------------------------------------------------------------------
def test_lists_as_tables_of_many_keys(spark):
    listed = spark.range(100_000).select(F.concat(F.lit("Host"), "id", F.lit(".example.com")).alias("host"))
    rules = spark.createDataFrame([("allow", "host7.example.com", "/ok/"), ("block", "ORG", None), (None, "net", "/"), ("block", None, "/")], "verdict string, host string, path string")
    hosts = [f"host{i}.example.com" for i in range(0, 200_000, 97)] + [f"a.host{i}.example.com" for i in range(99_000, 101_000, 13)] + ["x.org", "x.net"]
    rows = [(i, f"http://{h}/ok/{i}", 1, "x") for i, h in enumerate([*hosts, "host7.example.com"])] + [(-1, "http://host5.example.com/" + "y" * 100_000, 1, "x"), (-2, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, n int, key string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, rules, listed).collect()}

    def want(h: str) -> str:
        names = [".".join(h.split(".")[-n:]) for n in range(1, h.count(".") + 2)]
        inside = any(n.startswith("host") and n.endswith(".example.com") and n.count(".") == 2 and int(n[4:-12]) < 100_000 for n in names)
        return "allow" if "host7.example.com" in names else "block" if "org" in names or inside else "allow"

    assert got == {**{i: want(h) for i, h in enumerate([*hosts, "host7.example.com"])}, -1: "block", -2: "allow"}


# sharding --------------------------------------------------------------------------------------
def test_placement_by_definition(spark):
    docs = spark.createDataFrame([(i, "s") for i in [0, 1, 2, 77, -5, 10**15, None, None, 1]], "doc_id long, shard string")
    got = [(r["doc_id"], r["slot"], r["shard"]) for r in sharding.place(docs).collect()]
    known = {k: brute.shard_of(k, sharding.SHARDS, sharding.TABLE_SIZE) for k in {d for d, _, _ in got}}
    assert len(got) == 9 and all((slot, shard) == known[d] for d, slot, shard in got)
    assert sharding.place(docs.limit(0)).count() == 0


# helpers ---------------------------------------------------------------------------------------
def test_broadcasts_are_bounded_by_bytes(spark):
    df = common.cut(spark.createDataFrame([(1, "x" * 1000, [("a", [1, 2])]), (2, None, None)], "a long, b string, c array<struct<s:string,n:array<int>>>"))
    hinted = lambda d: "hint" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(common.small(df)) and hinted(common.small(df, 1500)) and not hinted(common.small(df, 900))


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_results_do_not_depend_on_broadcasts(spark, monkeypatch, limit):
    monkeypatch.setattr(lineage, "BROADCAST_BYTES", limit)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"]: r["text"] for r in lines.dedup(docs).collect()} == brute.kept_lines(pairs)
    assert sorted(tuple(r) for r in near.components(docs).collect()) == sorted(brute.near_components(pairs))


def test_components_of_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "HUB", 3)
    rng = random.Random(2)
    edges = [(0, i) for i in range(1, 40)] + [(100, i) for i in range(101, 120)] + [(39, 119), (7, 7), (200, 201), (201, 202), (None, 5)] + [(i, i + 1) for i in range(300, 330)] + [(rng.randrange(400, 420), rng.randrange(400, 420)) for _ in range(30)]
    got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root: dict = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert got == {x: find(x) for x in root}


def test_components_of_hubs_in_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(common, "HUB", 3)
    monkeypatch.setattr(common, "LINKS", 20)
    edges = [(0, i) for i in range(1, 40)] + [(100, i) for i in range(101, 120)] + [(39, 119), (200, 201), (201, 202)] + [(i, i + 1) for i in range(300, 330)]
    got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: 0 for x in (*range(40), *range(100, 120))} | {x: 200 for x in (200, 201, 202)} | {x: 300 for x in range(300, 331)}


def test_few_documents_take_few_tasks(spark):
    """However many partitions the input and the shuffles have, what is run is dealt to as many tasks as its rows need."""
    rng = random.Random(9)
    docs = []
    for d in range(150):
        w = [f"w{i}" for i in range(80)] if d % 2 else [f"y{d // 10}z{i}" for i in range(80)]
        for _ in range(rng.randrange(4)):
            w[rng.randrange(80)] = f"x{rng.randrange(1000)}"
        docs.append((d, " ".join(w)))
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "1k"}
    before = {k: spark.conf.get(k) for k in held}
    sc = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few tasks", "")
        got = near.components(spark.createDataFrame(docs, "doc_id long, text string").repartition(60)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(tuple(r) for r in got) == sorted(brute.near_components(docs))
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few tasks") for s in tracker.getJobInfo(j).stageIds}
    tasks = [i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s))]
    assert sum(tasks) < 3_000
