"""State-store operators: bounded state, timers, count-or-time batches, repeated micro-batches."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from colloquy.streaming import live, runner, sinks, stateful

ROWS = "key long, arrival long, kind string, id long, start_ms long, end_ms long, label string"


def streamed(spark, rows, schema, batches):
    """Rows as a file stream, each list of them a micro-batch of its own."""
    import os
    import time

    folder = tempfile.mkdtemp(prefix="spark-")
    for k, some in enumerate(batches):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{folder}/{k}")
        part = next(f for f in os.listdir(f"{folder}/{k}") if f.startswith("part-"))
        os.rename(f"{folder}/{k}/{part}", f"{folder}/{k}.parquet")
        os.utime(f"{folder}/{k}.parquet", (time.time() - 100 + k, time.time() - 100 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(folder)


def test_state_stays_flat():
    state, most = None, 0
    for k in range(1000):
        rows = [("turn", k * 100 + j, (k * 100 + j) * 1000, (k * 100 + j) * 1000 + 1500, "ab"[j % 2]) for j in range(100)]
        rows.append(("block", k, k * 100_000 + 20_000, k * 100_000 + 90_000, None))
        state, out = live.reconcile(state, rows, late_ms=60_000)
        assert out and out[-1][3]
        most = max(most, len(state["turns"]) + len(state["held"]))
    assert most < 70 and len(state["settled"]) <= live.SETTLED
    state, _ = live.reconcile(None, [("block", k, k, 10**9, None) for k in range(live.HELD + 50)])
    assert len(state["held"]) == live.HELD and state["held"][0]["id"] == 50


def test_a_stream_in_batches_equals_its_rows_at_once(spark):
    rows = []
    for n in range(120):
        kind = ("turn", "block", "turn", "turn")[n % 4] if n != 100 else "stop"
        rows.append((n % 3, n, kind, n, None if kind == "stop" else n * 700, None if kind == "stop" else n * 700 + 900 + n * 37 % 2500, "xyz"[n % 3] if kind == "turn" else None))
    stream = streamed(spark, rows, ROWS, [rows[k : k + 30] for k in range(0, 120, 30)])
    got = sorted(tuple(r) for r in runner.run_now(stateful.live_labels(stream)).collect())
    want = sorted(tuple(r) for r in live.live_labels_batch(spark.createDataFrame(rows, ROWS)).collect())
    assert got == want and any(r[4] for r in got)


def test_an_idle_recording_is_over(spark):
    first = [(1, 0, "turn", 0, 0, 1000, "a"), (1, 1, "block", 1, 200, 5000, None)]
    later = [(2, 2, "turn", 2, 10_000_000, 10_001_000, "b")]
    last = [(2, 3, "turn", 3, 20_000_000, 20_001_000, "b")]
    stream = streamed(spark, first, ROWS, [first, later, last])
    got = [tuple(r) for r in runner.run_now(stateful.live_labels(stream, late_ms=60_000, idle_ms=600_000)).collect()]
    assert sorted(got) == [(1, 1, 1, "a", False, False), (1, 1, 1, "a", True, False)]


def test_batches_by_count_or_time(spark):
    items = "k string, id long, at long"
    rows = [("a", n, n * 10) for n in range(7)] + [("a", 7, 9000), ("b", 1, 0), ("b", 2, 100_000)]
    stream = streamed(spark, rows, items, [rows[:4], rows[4:9], rows[9:], [("c", 0, 900_000)], [("c", 1, 900_001)]])
    got = sorted((r.k, r.ids, r.closed_by) for r in runner.run_now(stateful.count_or_time(stream, "k", "id", "at", 5, 5000, "1 second")).collect())
    assert got == [("a", [0, 1, 2, 3, 4], "count"), ("a", [5, 6], "time"), ("a", [7], "time"), ("b", [1], "time"), ("b", [2], "time")]


def test_repeated_batches_change_nothing(spark):
    schema = "k long, revision int, label string"
    folder = tempfile.mkdtemp(prefix="spark-")
    table = sinks.UpsertTable("file://" + folder + "/t", schema, ["k"], ["revision"], every=2)
    assert table.read(spark).count() == 0
    frames = [spark.createDataFrame([(k, r, f"{k}-{r}") for k in range(n, 6) for r in (n, n - 3)], schema) for n in range(6)]
    for n, df in enumerate(frames):
        table.write(df, n)
        before = sorted(map(tuple, table.read(spark).collect()))
        table.write(df, n)
        assert sorted(map(tuple, table.read(spark).collect())) == before
    assert before == [(k, k, f"{k}-{k}") for k in range(6)]
    assert sinks._complete(spark, table.path + "/snapshot") == [2, 4]
    table.write(frames[1], 1)  # also one that a snapshot has taken in
    assert sorted(map(tuple, table.read(spark).collect())) == before
