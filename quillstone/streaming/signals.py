"""Signals by ticker as keyed state with event-time timers.

Signals may come out of order and more than once. Each waits in the state until the watermark has passed it, so it is compared
with the one before it in time, whatever the batches: late ones up to the watermark's delay are put in their place (later ones are
dropped by Spark), repeated ones count once, and of several at one time the least counts. A ticker that is silent for as long as
`idle` is forgotten, with a row that says so; a null ticker is a ticker too, rows without a time or signal go.

States are kept in RocksDB: the session needs the settings of STORE.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Signals in one list of the state at most.
CHUNK = 10_000
ALERT = "ticker string, at long, previous string, signal string, kind string"


def _least(signals: dict[int, str], at: list[int], signal: list[str]) -> None:
    """Adds signals by their time; of several at one time the least counts."""
    for t, s in zip(at, signal):
        if t not in signals or s < signals[t]:
            signals[t] = s


class Signals(StatefulProcessor):
    """State of one ticker: the signals that wait, as the lists in which they came, and the last one that was settled. Times are microseconds.

    A ticker takes a few calls to its state a batch, however many signals it has: they are kept by lists of at most CHUNK, and
    timers stand at the earliest one that waits and at the end of the last one, not at each.
    """

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at array<long>, signal array<string>")
        self.last = handle.getValueState("last", "at long, signal string")

    def _lists(self, signals: dict[int, str]) -> list[tuple[list[int], list[str]]]:
        at, signal = list(signals), list(signals.values())
        return [(at[i : i + CHUNK], signal[i : i + CHUNK]) for i in range(0, len(at), CHUNK)]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new: dict[int, str] = {}
        for part in rows:
            _least(new, part["at"].tolist(), part["signal"].tolist())
        if new:
            self.waiting.appendList(self._lists(new))
            self.handle.registerTimer(min(new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        last = before = self.last.get()
        signals: dict[int, str] = {}
        for at, signal in self.waiting.get():
            _least(signals, at, signal)
        out = []
        for at in sorted(k for k in signals if k <= passed):
            signal = signals.pop(at)
            if last is not None and at - last[0] >= self.idle:
                out.append((key[0], last[0] + self.idle, last[1], None, "expired"))
                last = None
            if last is not None and signal != last[1]:
                out.append((key[0], at, last[1], signal, "signal_change"))
            last = (at, signal)
        if last is not None and last[0] + self.idle <= passed:
            out.append((key[0], last[0] + self.idle, last[1], None, "expired"))
            last = None
        if signals:
            self.waiting.put(self._lists(signals))
            self.handle.registerTimer(min(signals) // 1000 + 1)
        else:
            self.waiting.clear()
        if last is not None and last != before:
            self.last.update((last[0], last[1]))
            self.handle.registerTimer((last[0] + self.idle) // 1000 + 1)
        elif last is None and before is not None:
            self.last.clear()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ALERT.split(", ")], dtype=object)

    def close(self) -> None:
        pass


def signal_alerts(signals: DataFrame, late: str = "10 minutes", idle_seconds: int = 86400) -> DataFrame:
    """A stream (ticker, ts, signal) to rows (ticker, ts, previous, signal, kind), settled once the watermark has passed them."""
    rows = signals.where("ts IS NOT NULL AND signal IS NOT NULL").withWatermark("ts", late)
    rows = rows.select(F.col("ticker").cast("string").alias("ticker"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "signal")
    out = rows.groupBy("ticker").transformWithStateInPandas(Signals(idle_seconds * 1_000_000), ALERT, "Append", "EventTime")
    return out.select("ticker", F.timestamp_micros("at").alias("ts"), "previous", "signal", "kind")
