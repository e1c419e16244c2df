"""Assignments, sequences, cuts, clusters and whole files against hand-made cases and brute force."""

from __future__ import annotations

import itertools
import random
import tempfile

import numpy as np
import pytest
from pyspark.errors import PySparkException

from colloquy.operators import sequences as sq
from colloquy.sources import files
from colloquy.streaming import live


def test_best_apart_equals_all_mappings():
    rng = random.Random(3)
    for _ in range(200):
        lefts, rights = "abcde"[: rng.randrange(1, 6)], "xyz"[: rng.randrange(1, 4)]
        weight = {(a, b): rng.randrange(0, 6) for a in lefts for b in rights if rng.random() < 0.8}
        apart = {(a, b) for a, b in itertools.combinations(lefts, 2) if rng.random() < 0.5}
        known = sorted({a for a, _ in weight})
        best = (-1, None)
        for pick in itertools.product([*rights, None], repeat=len(known)):
            got = dict(zip(known, pick))
            if any(b is not None and weight.get((a, b), 0) <= 0 for a, b in got.items()) or any(got.get(a) is not None and got.get(a) == got.get(b) for a, b in apart):
                continue
            total = sum(weight[a, b] for a, b in got.items() if b is not None)
            if total > best[0]:
                best = (total, {a: b for a, b in got.items() if b is not None})
        assert sq.best_apart(weight, apart) == (best[1] or {})


def test_names_for_what_found_none(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", None), (1, "c", None), (2, "b", None)], "k long, l string, r string")
    assert sorted(tuple(r) for r in sq.with_fresh(df, ["k"], "l", "r").collect()) == [(1, "a", "x"), (1, "b", "new-1"), (1, "c", "new-2"), (2, "b", "new-1")]


def test_a_changed_sequence_goes_out(spark):
    turn = "key long, start_ms long, end_ms long, label string"
    blocks = spark.createDataFrame([(1, 1, 0, 100, 1, True, False), (1, 2, 200, 300, 1, True, False), (1, 3, 400, 500, 1, True, True), (1, 4, 600, 700, 0, False, False), (1, 5, 900, 950, 1, True, False)], "key long, block_id long, start_ms long, end_ms long, revision int, decided boolean, by_user boolean")
    live_turns = spark.createDataFrame([(1, 0, 70, "A"), (1, 70, 120, "B"), (1, 190, 250, "A"), (1, 250, 310, "B"), (1, 390, 510, "A"), (1, 590, 710, "A"), (1, 890, 960, "A")], turn)
    refined = spark.createDataFrame([(1, 0, 70, "A"), (1, 70, 120, "C"), (1, 190, 240, "A"), (1, 240, 240, "B"), (1, 241, 260, "B"), (1, 260, 310, "B"), (1, 390, 510, "B"), (1, 590, 710, "A"), (1, 890, 960, "D")], turn)
    protected = spark.createDataFrame([(1, 940, 945)], "key long, start_ms long, end_ms long")
    shown = blocks.join(live.label_sequence(blocks, live_turns, ["key", "block_id"]), ["key", "block_id"], "left")
    got = sorted(tuple(r) for r in live.finalize_sequences(shown, refined, protected).collect())
    # 1: A-B became A-C; 2: only the boundary moved; 3: a user's; 4: undecided; 5: protected.
    assert got == [(1, 1, 2, ["A", "C"]), (1, 4, 1, ["A"])]
    assert [r[1] for r in sorted(tuple(r) for r in live.finalize_sequences(shown, refined, protected, True).collect())] == [1, 2, 4]


def test_short_turns_wait_longer():
    gap = live.policy("gap:500,short:2000<300")
    assert gap == (500, (2000, 300)) and live.policy("gap: 800") == (800, None)
    # A short segment reaches over 1.5 s to its successor, a long one does not.
    assert live.flush(None, [(0, 200), (1700, 1800), (2400, 2500)], gap, 10_000) == ((2400, 2500, 1), [(0, 1800, 2, "gap")])
    assert live.flush(None, [(0, 200), (2200, 2300)], gap, 10_000)[1] == [(0, 200, 1, "gap")]
    for bad in ("gap:", "fixed:3", "gap:5,short:3"):
        with pytest.raises(ValueError):
            live.policy(bad)


def test_cuts_near_a_target_equal_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(100):
        x = rng.integers(-9, 10, rng.integers(0, 400)).astype(float)
        most, radius, window, step, least, quiet, overlap = 60, 12, 5, int(rng.integers(1, 4)), 20, float(rng.choice([0, 4, 9])), 7
        want, at = [], 0
        while at < len(x):
            if len(x) - at <= most:
                want.append((at, len(x)))
                break
            low, high = max(at + most - radius, at + least), min(at + most + radius, len(x) - window)
            found = [(float((x[i : i + window] ** 2).sum()), i) for i in range(low, high - window + 1, step)] if low + window <= high else []
            energy, i = min(found, default=(float("inf"), None))
            cut = at + most if i is None else i + window // 2
            end = min(cut + overlap, len(x)) if energy > quiet**2 * window else cut
            want.append((at, end))
            at = end
        assert sq.near_cuts(x, most, radius, window, step, least, quiet, overlap) == want


def test_small_clusters_dissolve():
    x = np.array([[1, 0], [1, 0.1], [0, 1], [0.1, 1], [0.7, 0.6], [0, 0]], dtype=float)
    assert sq.dissolve(x, np.array([0, 0, 1, 1, 2, 3]), 2).tolist() == [0, 0, 1, 1, 0, 0]
    assert sq.dissolve(x, np.array([3, 3, 1, 1, 0, 2]), 2).tolist()[:4] == [0, 0, 1, 1]
    assert sq.dissolve(x, np.arange(6), 2).tolist() == [0, 1, 2, 3, 4, 5]


def test_clusters_in_blocks(spark):
    rng = np.random.default_rng(5)
    centres = np.eye(6)
    rows = [(g, g * 1000 + i, (centres[i % 4 + g] + rng.normal(0, 0.05, 6)).tolist()) for g in range(2) for i in range(90)]
    df = spark.createDataFrame(rows, "g long, id long, v array<double>")
    whole = {r.id: r.cluster for r in sq.cluster_vectors(df, ["g"], "id", "v", 0.6).collect()}
    for block in (1000, 20):
        assert {r.id: r.cluster for r in sq.cluster_in_blocks(df, ["g"], "id", "v", 0.6, block).collect()} == whole
    assert set(whole.values()) == {0, 1, 2, 3}


def test_whole_files(spark):
    good = "SPEAKER m 1 0.0 1.5 <NA> <NA> a <NA> <NA>\n"
    cases = {"good": good * 2, "blank": "\n  \n" + good, "empty": "", "cut": good + good[:-1], "fields": good + "SPEAKER m 1 0.0\n", "word": good.replace("1.5", "x"), "channel": good.replace(" 1 0.0", " 1.5 0.0"), "other": good.replace("SPEAKER", "LEXEME")}
    folder = tempfile.mkdtemp(prefix="spark-")
    for name, text in cases.items():
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
    got = {r.path.rsplit("/", 1)[1]: (r.n_turns, r.valid) for r in files.check_rttm(files.whole_files(spark, folder)).collect()}
    assert got == {"good": (2, True), "blank": (1, True), "empty": (0, True), "cut": (2, False), "fields": (2, False), "word": (1, False), "channel": (1, False), "other": (1, False)}

    head, one = '{"record":"header","version":1}\n', '{"record":"emission","index":1,"start":0.5,"end":1.0,"speaker":"a","stable":true}\n'
    sidecars = [("ok", head + "\n" + one), ("late", one + head), ("none", one), ("kind", head + '{"record":"x"}\n'), ("plain", head + '{"index":1}'), ("half", head + one[:20]), ("list", head + "[1]"), ("nothing", "")]
    frame = spark.createDataFrame(sidecars, "path string, value string")
    problems = {r.path: r.problem for r in files.check_sidecars(frame).collect()}
    assert problems == {"ok": None, "late": None, "none": "no header", "kind": "unknown record in line 2", "plain": "unknown record in line 2", "half": "malformed line 2", "list": "malformed line 2", "nothing": "no header"}
    assert sorted((r.path, r["index"]) for r in files.read_sidecars(frame, strict=False).collect()) == [("late", 1), ("ok", 1)]
    with pytest.raises(PySparkException, match="no header"):
        files.read_sidecars(frame.where("path = 'none'")).collect()

    task = '{"data":{"audio":"x/%s.wav"},"annotations":[{"result":[]},{"result":[{"from_name":"labels","value":{"start":1,"end":2,"labels":["Big Man"]}},{"from_name":"labels","value":{"start":1,"end":2,"labels":[]}},{"from_name":"text","value":{}}]}]}'
    exports = [("a", f"[{task % 'a'}]"), ("b", '{"tasks":[' + task % "b" + "]}"), ("c", '[{"data":{}}, {"data":{"audio":"c"},"annotations":[]}]'), ("d", "[]"), ("e", "{}")]
    got = sorted(tuple(r) for r in files.check_label_exports(spark.createDataFrame(exports, "path string, value string")).collect())
    assert got == [("a", 1.0, 2.0, "big_man"), ("b", 1.0, 2.0, "big_man")]
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        files.check_label_exports(spark.createDataFrame([("x", "[{]")], "path string, value string")).collect()
