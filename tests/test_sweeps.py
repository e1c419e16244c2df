"""Sweeps against all pairs of small random spans; no pairs are made where only the best or a sum counts."""

from __future__ import annotations

import random

import pytest

from colloquy.operators import intervals as iv
from colloquy.operators import metrics as m
from colloquy.operators import sweeps
from colloquy.streaming import live

HOUR = 3_600_000
SPAN = "k long, i long, label string, start_ms long, end_ms long"


def spans(seed, n, labels="abc"):
    rng, rows = random.Random(seed), []
    for i in range(n):
        start = rng.randrange(0, 6 * HOUR, HOUR // 20)
        rows.append((i % 2, i, rng.choice(labels), start, start + rng.choice([0, HOUR // 20, HOUR // 4, HOUR, 5 * HOUR])))
    return rows


def right_of(df):
    return df.selectExpr("k", "label as r_label", "i as r_id", "start_ms as r_start", "end_ms as r_end")


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join")


def over(a, b):
    return b[3] < a[4] and a[3] < b[4]


@pytest.mark.parametrize("seed", range(3))
def test_best_rights(spark, monkeypatch, seed):
    a, b = spans(seed, 150), spans(seed + 50, 90)
    left, right = spark.createDataFrame(a, SPAN), right_of(spark.createDataFrame(b, SPAN))
    best = iv.max_overlap(left, right, ["k"], ["i"], ["r_start", "r_id"])
    assert not joins(best) and set(best.columns) == {*SPAN.replace(" long", "").replace(" string", "").split(", "), "r_label", "r_id", "r_start", "r_end", "overlap_ms"}
    want = {}
    for x in a:
        pairs = [(-(min(x[4], y[4]) - max(x[3], y[3])), y[3], y[1]) for y in b if x[0] == y[0] and over(x, y)]
        if pairs:
            want[x[1]] = (min(pairs)[2], -min(pairs)[0])
    assert {r.i: (r.r_id, r.overlap_ms) for r in best.collect()} == want
    near = iv.nearest_within(left, right, ["k"], ["i"], ["r_start", "r_id"], HOUR // 10)
    want = {}
    for x in a:
        pairs = [(max(x[3] - y[4], y[3] - x[4], 0), y[3], y[1]) for y in b if x[0] == y[0]]
        if min(pairs)[0] <= HOUR // 10:
            want[x[1]] = (min(pairs)[2], min(pairs)[0])
    assert not joins(near) and {r.i: (r.r_id, r.gap_ms) for r in near.collect()} == want
    free = iv.without_overlap(left, right.where("r_label = 'a'"), ["k"])
    assert sorted(r.i for r in free.collect()) == [x[1] for x in a if not any(x[0] == y[0] and y[2] == "a" and over(x, y) for y in b)]


@pytest.mark.parametrize("rows", [1, 1 << 16])
def test_timelines_and_sums(spark, monkeypatch, rows):
    monkeypatch.setattr(sweeps, "ROWS", rows)
    monkeypatch.setattr(sweeps, "CELLS", 16 if rows == 1 else 1 << 20)
    a, b = spans(7, 120), spans(8, 100, "bcd")
    left, right = spark.createDataFrame(a, SPAN), spark.createDataFrame(b, SPAN)
    step = HOUR // 20
    at = lambda rows, k, t: [x for x in rows if x[0] == k and x[3] <= t < x[4]]
    shown = iv.last_writer_timeline(left, ["k"], "i")
    runs = []
    for k in (0, 1):
        for t in range(0, 12 * HOUR, step):
            now = max(at(a, k, t), key=lambda x: x[1], default=None)
            if now and runs and runs[-1][0] == k and runs[-1][3] == t and runs[-1][1] == now[2]:
                runs[-1][3] = t + step
            elif now:
                runs.append([k, now[2], t, t + step])
    assert "r_start" not in shown._jdf.queryExecution().toString()
    assert sorted(list(r) for r in shown.select("k", "label", "start_ms", "end_ms").collect()) == sorted(runs)
    sums, shared = {}, {}
    for k in (0, 1):
        for t in range(0, 12 * HOUR, step):
            x, y = at(a, k, t), at(b, k, t)
            r, h = {z[2] for z in x}, {z[2] for z in y}
            s = sums.setdefault(k, [0, 0, 0, 0])
            for j, v in enumerate((len(r), max(0, len(r) - len(h)), max(0, len(h) - len(r)), min(len(r), len(h)) - len(r & h))):
                s[j] += v * step
            for p in x:
                for q in y:
                    shared[k, p[2], q[2]] = shared.get((k, p[2], q[2]), 0) + step
    errors = m.error_components(left, right, ["k"])
    assert not joins(errors) and {r.k: [r.total, r.miss, r.false_alarm, r.confusion] for r in errors.collect()} == sums
    found = sweeps.shared_time(m._sides(left, right, ["k"]), ["k"]).groupBy("k", "label", "h_label").sum("w")
    assert {tuple(r)[:3]: r[3] for r in found.collect()} == shared
    assert not joins(m.label_mapping(left, right, ["k"]))


def test_sequences_look_at_telling_turns_alone(spark):
    turns = [x for x in spans(9, 80, "ab") for _ in range(4)]
    blocks = spans(10, 60)
    t = spark.createDataFrame(turns, SPAN).withColumnRenamed("k", "key")
    got = live.label_sequence(spark.createDataFrame(blocks, SPAN).withColumnRenamed("k", "key").drop("label"), t, ["key", "i"])
    want = {}
    for x in blocks:
        names = [y[2] for y in sorted((y for y in turns if y[0] == x[0] and over(x, y)), key=lambda y: (y[3], y[4], y[2]))]
        if names:
            want[x[1]] = [n for j, n in enumerate(names) if j == 0 or n != names[j - 1]]
    assert {r.i: r.labels for r in got.collect()} == want
    assert live._telling(t.select("key", "start_ms", "end_ms", "label")).count() <= 80
