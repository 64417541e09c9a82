"""The streaming forms, driven by files."""

from __future__ import annotations

import json

import pandas as pd

from quillstone.streaming import signals, streams


def test_intake(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, (kind, action) in enumerate([("merge_request", "open"), ("merge_request", "close"), ("push", "open")]):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"object_kind": kind, "project": {"id": i}, "object_attributes": {"iid": i, "action": action}}))
    seen = []
    q = streams.intake(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda df, _: seen.extend(df.collect()))
    q.awaitTermination(60)
    assert [(r["project_id"], r["action"]) for r in seen] == [(0, "open")]


def test_signal_changes_keep_state(spark, tmp_path):
    schema = "ticker string, ts long, signal string"
    rows = [[("a", 1, "buy"), ("a", 2, "hold"), ("b", 1, "x")], [("a", 3, "hold"), ("a", 4, "sell"), ("b", 2, "y")]]
    q = None
    for i, r in enumerate(rows):
        spark.createDataFrame(r, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        q = streams.signal_changes(stream).writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.schema("ticker string, previous string, signal string").json(str(tmp_path / "out")).collect()}
    assert got == {("a", "buy", "hold"), ("a", "hold", "sell"), ("b", "x", "y")}


def test_upserts(spark, tmp_path):
    put = streams.upsert_sink(str(tmp_path / "t"), "id", "ord")
    put(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "id int, ord int, v string"), 0)
    put(spark.createDataFrame([(2, 5, "d"), (3, 1, "e")], "id int, ord int, v string"), 1)
    assert {(r["id"], r["v"]) for r in spark.read.parquet(str(tmp_path / "t/version=1")).collect()} == {(1, "b"), (2, "d"), (3, "e")}


def alerts_by_definition(rows, late, idle):
    """What is settled once the stream has ended: signals up to the greatest time less the delay, in seconds."""
    passed = max(r[1] for r in rows) - late
    out = set()
    for ticker in {r[0] for r in rows}:
        settled = {}
        for k, at, s in rows:
            if k == ticker and at <= passed:
                settled[at] = min(s, settled.get(at, s))
        last = None
        for at, s in [*sorted(settled.items()), (passed, None)]:
            if last and at - last[0] >= idle:
                out.add((ticker, last[0] + idle, last[1], None, "expired"))
                last = None
            if s is not None:
                if last and s != last[1]:
                    out.add((ticker, at, last[1], s, "signal_change"))
                last = (at, s)
    return out


def test_signals_late_repeated_and_expired_over_restarts(spark, tmp_path):
    for k, v in signals.STORE.items():
        spark.conf.set(k, v)
    batches = [
        [("a", 10, "buy"), ("a", 30, "sell"), ("b", 12, "x"), (None, 11, "p")],
        [("a", 20, "hold"), ("a", 30, "sell"), ("a", 30, "hold"), ("b", 12, "x"), ("b", 33, "x"), (None, 25, "q")],  # late and repeated
        [("a", 60, "sell"), ("b", 70, "y")],  # 20 s on
        [("a", 65, "sell"), ("c", 300, "z")],  # all fall silent
        [("a", 5, "never"), ("c", 420, "w"), ("a", 410, "buy")],  # too late by far
        [("d", 600, "u")],
    ]
    schema = "ticker string, t long, signal string"
    for rows in batches:  # each batch is a run of its own: state and timers come from the checkpoint
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in")).selectExpr("ticker", "timestamp_seconds(t) AS ts", "signal")
        q = signals.signal_alerts(stream, "20 seconds", 100).writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    got = spark.read.schema("ticker string, ts timestamp, previous string, signal string, kind string").json(str(tmp_path / "out")).selectExpr("ticker", "unix_seconds(ts)", "previous", "signal", "kind").collect()
    want = alerts_by_definition([r for rows in batches for r in rows if r[2] != "never"], 20, 100)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert ("a", 20, "buy", "hold", "signal_change") in want and ("b", 170, "y", None, "expired") in want and ("a", 60, "hold", "sell", "signal_change") in want


class _Handle:
    """A state that counts its calls."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def state(self, *_):
        handle = self

        class State:
            rows = None

            def get(self):
                handle.calls += 1
                return iter(self.rows or []) if self.listed else self.rows

            def put(self, rows):
                handle.calls += 1
                self.rows = list(rows)

            def appendList(self, rows):  # noqa: N802
                handle.calls += 1
                self.rows = [*(self.rows or []), *rows]

            def update(self, row):
                handle.calls += 1
                self.rows = row

            def exists(self):
                handle.calls += 1
                return self.rows is not None

            def clear(self):
                handle.calls += 1
                self.rows = None

            def containsKey(self, key):  # noqa: N802
                return key in (self.rows or {})

            def getValue(self, key):  # noqa: N802
                handle.calls += 1
                return self.rows[key]

            def updateValue(self, key, value):  # noqa: N802
                handle.calls += 1
                self.rows = {**(self.rows or {}), key: value}

        out = State()
        out.listed = len(self.made) == 0
        self.made.append(out)
        return out

    made: list = []
    getListState = getMapState = getValueState = state  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)


def test_signals_take_few_calls_to_their_state(monkeypatch):
    monkeypatch.setattr(signals, "CHUNK", 7, raising=False)

    class Times:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.ms

    rows = [(t * 1_000_000, "xyz"[(t * 7 + t // 3) % 3]) for t in range(2000)]
    handle = _Handle()
    handle.made = []
    s = signals.Signals(100 * 1_000_000)
    s.init(handle)
    got = []
    for a, b in ((0, 1200), (600, 2000)):  # with 600 repeated ones
        part = pd.DataFrame(rows[a:b][::-1], columns=["at", "signal"])
        s.handleInputRows(("k",), iter([part[:300], part[300:]]), Times(0))
    for now in (500, 500_000, 5_000_000):
        while due := [t for t in handle.timers if t <= now]:
            handle.timers.remove(min(due))
            for out in s.handleExpiredTimer(("k",), Times(now), None):
                got += out.values.tolist()
    want = [["k", b[0], a[1], b[1], "signal_change"] for a, b in zip(rows, rows[1:]) if a[1] != b[1]] + [["k", (1999 + 100) * 1_000_000, rows[-1][1], None, "expired"]]
    assert got == want and handle.calls < 40 and not handle.timers
