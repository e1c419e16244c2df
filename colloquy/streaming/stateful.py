"""Stateful operators on collections of the state store: only what changes in a micro-batch is read back or rewritten.

They run as ``transformWithStateInPandas``, which needs the RocksDB state store (``prepare`` sets it for the session).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .live import _EPOCH, _NAMES, LATE_MS, OUT, SETTLED, reconcile

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """Lets streams of this session keep their state in RocksDB, on disk beside the executors and in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def _only_timer(handle: StatefulProcessorHandle, at: int) -> None:
    """One timer of a key in place of those before it."""
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
    handle.registerTimer(at)


class LiveLabels(StatefulProcessor):
    """Revisions of the blocks of a recording (``live.reconcile``): its marks as a value, its turns, held and settled blocks as maps.

    Settled blocks are only added and, beyond ``SETTLED``, removed: a micro-batch reads none of them.

    With ``idle_ms`` a recording is over once event time, which all recordings advance, has passed its latest start by so
    much: its held blocks become final and its state goes. ``whole``: as for ``live.reconcile``.
    """

    def __init__(self, late_ms: int, idle_ms: int | None, whole: bool = False):
        self.late_ms, self.idle_ms, self.whole = late_ms, idle_ms, whole

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.marks = handle.getValueState("marks", "high long, latest long, last_start long, last_end long, odd boolean, next long, done long")
        self.turns = handle.getMapState("turns", "k long", "start long, end long, label string")
        self.settled = handle.getMapState("settled", "k long", "id long, revision int, label string, decided boolean")
        self.held = handle.getMapState("held", "id long", "k long, start long, end long, label string, revision int, best string, overlap long")

    def _read(self) -> tuple[dict | None, dict[int, tuple], dict[int, tuple], int, int]:
        if not self.marks.exists():
            return None, {}, {}, 0, 0
        high, latest, start, end, odd, at, done = self.marks.get()
        turns = {k[0]: tuple(v) for k, v in self.turns.iterator()}
        held = {k[0]: tuple(v) for k, v in self.held.iterator()}
        blocks = [{"id": i, "start": v[1], "end": v[2], "label": v[3], "revision": v[4], "best": v[5], "overlap": v[6], "k": v[0]} for i, v in sorted(held.items(), key=lambda x: x[1][0])]
        last = None if start is None else [start, end]
        return {"turns": [list(turns[k]) for k in sorted(turns)], "held": blocks, "settled": [], "high": high, "last": last, "odd": odd, "latest": latest}, turns, held, at, done

    def _write(self, s: dict, turns: dict[int, tuple], held: dict[int, tuple], at: int, done: int) -> None:
        """Puts what is new and removes what is gone; turns leave in any order, but stay in theirs."""
        left, order = [tuple(t) for t in s["turns"]], sorted(turns)
        for k in order:
            if left and turns[k] == left[0]:
                left.pop(0)
            else:
                self.turns.removeKey((k,))
        for turn in left:
            self.turns.updateValue((at,), turn)
            at += 1
        now = {}
        for b in s["held"]:
            if "k" not in b:
                b["k"], at = at, at + 1
            now[b["id"]] = (b["k"], b["start"], b["end"], b["label"], b["revision"], b["best"], b["overlap"])
        for ident in held.keys() - now.keys():
            self.held.removeKey((ident,))
        for ident, value in now.items():
            if held.get(ident) != value:
                self.held.updateValue((ident,), value)
        for block in s["settled"]:
            self.settled.updateValue((done,), tuple(block))
            if done >= SETTLED:
                self.settled.removeKey((done - SETTLED,))
            done += 1
        self.marks.update((s["high"], s["latest"], *(s["last"] or (None, None)), bool(s["odd"]), at, done))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values("arrival")
        old, turns, held, at, done = self._read()
        s, out = reconcile(old, list(zip(*(pdf[c].tolist() for c in ("kind", "id", "start_ms", "end_ms", "label")), strict=True)), self.late_ms, self.whole)
        self._write(s, turns, held, at, done)
        if self.idle_ms is not None:
            _only_timer(self.handle, max(s["latest"] + _EPOCH + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old, *_ = self._read()
        out = reconcile(old, [("stop", None, None, None, None)], self.late_ms, self.whole)[1] if old else []
        for state in (self.marks, self.turns, self.held, self.settled):
            state.clear()
        yield pd.DataFrame([(key[0], *r) for r in out], columns=_NAMES)

    def close(self) -> None:
        pass


def live_labels(rows: DataFrame, late_ms: int = LATE_MS, idle_ms: int | None = None, whole: bool = False) -> DataFrame:
    """Revisions from a stream of rows: key long, arrival long, kind (turn, block, stop), id, start_ms, end_ms, label.

    With ``idle_ms`` rows that start more than ``late_ms`` behind the latest start of all recordings are dropped. With
    ``whole`` no block is given up and no turn forgotten, however many and late they are (``live.reconcile``).
    """
    prepare(rows.sparkSession)
    if idle_ms is not None:
        rows = rows.withColumn("_at", F.timestamp_millis(F.col("start_ms") + _EPOCH)).withWatermark("_at", f"{late_ms} milliseconds")
    return rows.groupBy("key").transformWithStateInPandas(LiveLabels(late_ms, idle_ms, whole), OUT, "append", "none" if idle_ms is None else "eventTime")


class CountOrTime(StatefulProcessor):
    """Items of a key in batches: closed by a number of items, or by a time without any."""

    def __init__(self, size: int, wait_ms: int, event_time: bool, name: str):
        self.size, self.wait_ms, self.event_time = size, wait_ms, event_time
        self.names = [name, "first_ms", "last_ms", "ids", "closed_by"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", "id long, at long")

    def _row(self, key, items: list[tuple[int, int]], why: str) -> tuple:
        return key[0], items[0][1], items[-1][1], [i for i, _ in items], why

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values(["at", "id"])
        items, out = [tuple(x) for x in self.items.get()] if self.items.exists() else [], []
        for ident, at in zip(pdf["id"].tolist(), pdf["at"].tolist(), strict=True):
            if self.event_time and items and at - items[-1][1] >= self.wait_ms:
                out.append(self._row(key, items, "time"))
                items = []
            items.append((ident, at))
            if len(items) == self.size:
                out.append(self._row(key, items, "count"))
                items = []
        if items:
            self.items.put(items)
            at = items[-1][1] + _EPOCH if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            least = timerValues.getCurrentWatermarkInMs() + 1 if self.event_time else 0
            _only_timer(self.handle, max(at + self.wait_ms, least))
        else:
            self.items.clear()
        yield pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        items = [tuple(x) for x in self.items.get()] if self.items.exists() else []
        self.items.clear()
        yield pd.DataFrame([self._row(key, items, "time")] if items else [], columns=self.names)

    def close(self) -> None:
        pass


def count_or_time(rows: DataFrame, key: str, ident: str, at_ms: str, size: int = 50, wait_ms: int = 5000, late: str | None = None) -> DataFrame:
    """Batches of a stream's items: the key, first_ms, last_ms, ids (array<long>) and closed_by (count or time).

    A batch closes with its ``size``-th item, or once nothing came for ``wait_ms``: by event time (``at_ms``, longs) with
    ``late`` as the watermark's delay, by the clock of the machine where ``late`` is None. What is pending when the stream
    ends stays in its state and goes on with the next run. Items of one micro-batch are taken in the order of their time.
    """
    prepare(rows.sparkSession)
    out = f"{key} {dict(rows.dtypes)[key]}, first_ms long, last_ms long, ids array<long>, closed_by string"
    items = rows.select(key, F.col(ident).cast("long").alias("id"), F.col(at_ms).alias("at"))
    if late:
        items = items.withColumn("_at", F.timestamp_millis(F.col("at") + _EPOCH)).withWatermark("_at", late)
    return items.groupBy(key).transformWithStateInPandas(CountOrTime(size, wait_ms, late is not None, key), out, "append", "eventTime" if late else "processingTime")
