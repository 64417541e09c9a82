"""Paged sources, the keyed table and the answer store: retries, replays, repeated runs."""

from __future__ import annotations

import base64
import json
import os
from pathlib import Path

import pytest

from quillstone import answers, models
from quillstone.sources import keyed, reviews
from quillstone.streaming import streams  # noqa: F401

WORKERS = "tests.test_services"


def counted(folder: str, name: str) -> int:
    """How often a name was noted in a folder, this time included; by whichever process."""
    n = len(list(Path(folder).glob(f"{name}.*")))
    (Path(folder) / f"{name}.{n}").touch()
    return n + 1


def flaky(base: str, endpoint: str, headers: dict) -> object:
    """Fails twice for each request, then answers; three pages of two changes for a review, one file, and 25 papers."""
    kind = endpoint.replace("/", "_").replace("?", "_").replace("=", "_").replace("&", "_").replace("%", "_")
    if counted(base, kind) <= 2:
        raise OSError("not now")
    assert headers == {"PRIVATE-TOKEN": "t"}
    if "/repository/files/" in endpoint:
        if "gone" in endpoint:
            raise OSError("404")
        return {"content": base64.b64encode(f"text of {endpoint}".encode()).decode() if "good" in endpoint else base64.b64encode(b"\xff\xfe").decode()}
    if endpoint.startswith("/search"):
        page = int(endpoint.split("page=")[1].split("&")[0])
        return {"data": [{"id": f"p{i}", "title": f"Paper {i}", "year": 2000 + i, "n_citation": i, "authors": ["A"]} for i in range(25)][10 * (page - 1) : 10 * page]}
    page = int(endpoint.split("page=")[1]) if "page=" in endpoint else 1
    iid = endpoint.split("/merge_requests/")[1].split("/")[0]
    return {"diff_refs": {"base_sha": "b", "head_sha": f"h{iid}"}, "changes": [{"new_path": f"{iid}/{page}/{i}", "old_path": "o", "diff": "@@", "new_file": i == 0} for i in range(2)], "next_page": page + 1 if page < 3 else None}


def source(spark, name, folder, keys, **more):
    reviews.register(spark)
    return spark.read.format(name).options(keys=json.dumps(keys), base=str(folder), project="g/p", token="t", transport=f"{WORKERS}:flaky", wait="0.01", **more).load()


def test_changes_are_read_by_pages_with_retries(spark, tmp_path):
    got = source(spark, "review_changes", tmp_path, [1, 2, 3]).collect()
    assert sorted((r["mr_iid"], r["new_path"], r["head_sha"], r["start_sha"], r["new_file"]) for r in got) == sorted((k, f"{k}/{p}/{i}", f"h{k}", None, i == 0) for k in (1, 2, 3) for p in (1, 2, 3) for i in range(2))
    asked = [f.name.rsplit(".", 1)[0] for f in tmp_path.iterdir()]
    assert len(asked) == 27 and all(asked.count(a) == 3 for a in asked), "two failures and one answer for each page, nothing read twice"


def test_a_filter_on_the_key_asks_for_these_keys_alone(spark, tmp_path):
    df = source(spark, "review_changes", tmp_path, [1, 2, 3, 4])
    assert {r["mr_iid"] for r in df.where("mr_iid = 2").collect()} == {2}
    assert all("merge_requests_2_" in f.name for f in tmp_path.iterdir())
    assert {r["mr_iid"] for r in df.where("mr_iid in (3, 9) and new_path like '3/1/%'").collect()} == {3}
    assert not any("merge_requests_1_" in f.name or "merge_requests_4_" in f.name for f in tmp_path.iterdir())
    assert df.where("mr_iid = 99").collect() == [] and source(spark, "review_changes", tmp_path, []).collect() == []


def test_a_request_that_never_succeeds_fails_the_scan(spark, tmp_path, monkeypatch):
    waits = []
    monkeypatch.setattr(reviews.time, "sleep", waits.append)
    tries = []

    def never():
        tries.append(1)
        raise OSError("down")

    with pytest.raises(OSError, match="down"):
        reviews.attempt(never)
    assert len(tries) == 3 and waits == [1.0, 2.0]


def test_files_and_searches(spark, tmp_path):
    got = {r["path"]: r["content"] for r in source(spark, "review_files", tmp_path, [[7, "src/good.ts"], [7, "gone.ts"], [7, "bad.bin"]]).collect()}
    assert got == {"src/good.ts": "text of /projects/g%2Fp/repository/files/src%2Fgood.ts?ref=refs/merge-requests/7/head", "gone.ts": None, "bad.bin": None}
    found = source(spark, "paper_search", tmp_path, ["graph learning"], size="10").collect()
    assert sorted(r["n_citation"] for r in found) == list(range(25)) and {r["query"] for r in found} == {"graph learning"}


# ---------------------------------------------------------------------------------------------------
POINT = "id long, ord long, v string"


def folders(path, version):
    return {p for p in os.listdir(f"{path}/data/version={version}") if p.startswith("part=")}


def test_an_upsert_rewrites_the_touched_parts_alone(spark, tmp_path):
    t = keyed.KeyedTable(spark, str(tmp_path / "t"), POINT, parts=16)
    assert t.read().collect() == []
    t.put(spark.range(1000).selectExpr("id", "0L AS ord", "concat('v', id) AS v"))
    assert len(folders(t.path, 0)) == 16
    touched = t.put(spark.createDataFrame([(5, 1, "new"), (5, 2, "newer"), (2000, 0, "more")], POINT))
    assert len(touched) <= 2 and folders(t.path, 1) == {f"part={p}" for p in touched}
    rows = {r["id"]: r["v"] for r in t.read().collect()}
    assert len(rows) == 1001 and rows[5] == "newer" and rows[2000] == "more" and rows[6] == "v6"
    assert [tuple(r) for r in t.find(5).collect()] == [(5, 2, "newer")] and t.find(-1).collect() == []
    assert t.put(spark.createDataFrame([], POINT)) == []


def test_replays_gaps_late_batches_and_crashes_leave_the_same_rows(spark, tmp_path):
    batches = {0: [(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (None, 1, "n")], 1: [(2, 5, "d"), (3, None, "e")], 7: [(1, 0, "late"), (3, 1, "f"), (3, 1, "f")]}
    frame = lambda i: spark.createDataFrame(batches[i], POINT)
    want = {(1, "b"), (2, "d"), (3, "f"), (None, "n")}
    for n, order in enumerate([(0, 1, 7), (0, 0, 1, 7, 7, 1), (7, 1, 0)]):
        put = keyed.keyed_sink(str(tmp_path / f"t{n}"), POINT, "id", "ord", 4)
        for i in order:
            put(frame(i), i)
        assert {(r["id"], r["v"]) for r in keyed.KeyedTable(spark, str(tmp_path / f"t{n}"), POINT, parts=4).read().collect()} == want
    t = keyed.KeyedTable(spark, str(tmp_path / "crash"), POINT, parts=4)
    t.put(frame(0), 0)
    # a version whose files are there, but which the manifest does not name
    spark.createDataFrame([(1, 99, "half", 0)], POINT + ", part int").write.partitionBy("part").parquet(f"{t.path}/data/version=1")
    assert {(r["id"], r["v"]) for r in t.read().collect()} == {(1, "b"), (2, "c"), (None, "n")}
    t.put(frame(1), 1)
    t.put(frame(7), 7)
    assert {(r["id"], r["v"]) for r in t.read().collect()} == want


def test_a_stream_into_a_keyed_table(spark, tmp_path):
    for i, rows in enumerate([[(1, 1, "a"), (2, 1, "b")], [(2, 2, "c")]]):
        spark.createDataFrame(rows, POINT).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(POINT).json(str(tmp_path / "in"))
        sink = keyed.keyed_sink(str(tmp_path / "t"), POINT, "id", "ord", 4)
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert {(r["id"], r["v"]) for r in keyed.KeyedTable(spark, str(tmp_path / "t"), POINT, parts=4).read().collect()} == {(1, "a"), (2, "c")}


# ---------------------------------------------------------------------------------------------------
def prompts(spark, n=6):
    return spark.range(n).selectExpr("id", "concat('prompt ', id % 4) AS prompt")


def test_the_store_asks_nothing_twice(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def fn(tier, system, prompt):
        asked.add(1)
        return f"{tier} {system} {prompt}"

    store = answers.AnswerStore(spark, str(tmp_path / "s"))
    rows = prompts(spark).union(spark.createDataFrame([(9, None)], "id long, prompt string"))
    got = {r["id"]: r["answer"] for r in store.ask(rows, fn, "base", "sys", at_once=2).collect()}
    assert got == {**{i: f"base sys prompt {i % 4}" for i in range(6)}, 9: "base sys "} and asked.value == 5
    again = answers.AnswerStore(spark, str(tmp_path / "s"))
    assert {r["id"]: r["answer"] for r in again.ask(rows, fn, "base", "sys").collect()} == got and asked.value == 5
    again.ask(rows, fn, "cheap", "sys").count()
    assert asked.value == 10 and again.ask(rows.limit(0), fn, "base", "sys").collect() == []


def test_a_killed_run_keeps_what_it_has_asked(spark, tmp_path):
    folder = tmp_path / "seen"
    folder.mkdir()

    def fn(tier, system, prompt):
        counted(str(folder), prompt.replace(" ", "-"))
        if prompt == "prompt 2" and not (folder / "mended").exists():
            raise RuntimeError("killed")
        return prompt

    store = answers.AnswerStore(spark, str(tmp_path / "s"))
    b = models.Budget()
    with pytest.raises(Exception, match="killed"):
        store.ask(prompts(spark), fn, "base", "", budget=b, order=("id",))
    (folder / "mended").touch()
    got = answers.AnswerStore(spark, str(tmp_path / "s")).ask(prompts(spark), fn, "base", "", budget=models.Budget(), order=("id",)).collect()
    assert {r["id"]: r["answer"] for r in got} == {i: f"prompt {i % 4}" for i in range(6)}
    assert [len(list(folder.glob(f"prompt-{i}.*"))) for i in (0, 1, 3)] == [1, 1, 1]


def test_cost_passes_its_limit_by_one_call_at_most(spark, tmp_path):
    """Answers of 100,000 tokens, 1.50 USD each on the dearest tier: the first is over the limit, the second is not asked."""
    dear = lambda tier, system, prompt: "x" * 400_000
    b = models.Budget(max_cost=0.02)
    got = answers.AnswerStore(spark, str(tmp_path / "s")).ask(prompts(spark), dear, "frontier", "", budget=b, order=("id",)).collect()
    assert b.calls == {"frontier": 1} and 1.5 < b.cost < 1.51 and sum(r["answer"] is not None for r in got) == 2  # two rows of one prompt
    b = models.Budget(max_cost=0.02)
    got = models.ask(prompts(spark), dear, "frontier", "", budget=b, order=("id",)).collect()
    assert b.calls == {"frontier": 1} and 1.5 < b.cost < 1.51 and [r["id"] for r in got if r["answer"]] == [0]
    b = models.Budget(max_calls=3)
    got = answers.AnswerStore(spark, str(tmp_path / "t")).ask(prompts(spark), lambda *a: "ok", "base", "", budget=b, order=("id",)).collect()
    assert b.calls == {"base": 3} and {r["id"] for r in got if r["answer"]} == {0, 1, 2, 4, 5}


def test_a_transient_failure_is_tried_again(spark, tmp_path):
    folder = tmp_path / "seen"
    folder.mkdir()

    def fn(tier, system, prompt):
        if counted(str(folder), prompt.replace(" ", "-")) <= (9 if prompt == "prompt 3" else 1):
            raise models.Transient("429")
        return prompt

    quiet = lambda s: None
    got = models.ask(prompts(spark, 3), fn, "base", "", wait=quiet).collect()
    assert {r["id"]: r["answer"] for r in got} == {i: f"prompt {i}" for i in range(3)}
    got = answers.AnswerStore(spark, str(tmp_path / "s")).ask(prompts(spark, 4), fn, "base", "", wait=quiet).collect()
    assert {r["id"]: r["answer"] for r in got} == {0: "prompt 0", 1: "prompt 1", 2: "prompt 2", 3: None}
    order = spark.createDataFrame([(None, "prompt 0"), (1, "prompt 1")], "id long, prompt string")
    assert all(r["answer"] for r in models.ask(order, fn, "base", "", budget=models.Budget(), order=("id",), wait=quiet).collect())
