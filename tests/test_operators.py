"""Hand-computed cases of the interval, vector, text, metric, change and streaming operators."""

from __future__ import annotations

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colloquy.functions import alignment as al
from colloquy.functions import text as x
from colloquy.operators import changes, intervals, metrics, relational, sequences, vectors
from colloquy.sources import files
from colloquy.streaming import live, runner, stateful

SPAN = "k long, i long, label string, start_ms long, end_ms long"


def spans(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], SPAN)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# -- intervals ---------------------------------------------------------------------------------------------------------


def test_gap_of_the_limit_stays_apart(spark):
    df = spans(spark, [("a", 0, 1000), ("a", 1500, 2000), ("a", 2499, 3000)])
    assert rows(intervals.merge_gaps(df, ["k"], 500, ["start_ms"]), "start_ms", "end_ms") == [(0, 1000), (1500, 3000)]


def test_contained_span_ends_at_the_inner_end(spark):
    df = spans(spark, [("a", 0, 10_000), ("a", 1000, 2000)])
    assert rows(intervals.merge_gaps(df, ["k"], 500, ["start_ms"]), "end_ms") == [(2000,)]
    assert rows(intervals.merge_gaps(df, ["k"], 500, ["start_ms"], "max"), "end_ms") == [(10_000,)]


def test_bridge_merges_at_the_limit_and_only_one_label(spark):
    df = spans(spark, [("a", 0, 1000), ("a", 1300, 2000), ("b", 2100, 2200), ("a", 2250, 3000), ("a", 3301, 4000), ("a", 3500, 3600)])
    assert rows(intervals.bridge_same_label(df, ["k"], 300, ["start_ms"]), "label", "start_ms", "end_ms") == [("a", 0, 2000), ("a", 2250, 3000), ("a", 3301, 4000), ("b", 2100, 2200)]
    assert intervals.bridge_same_label(df, ["k"], 0, ["start_ms"]).count() == 5


@pytest.mark.parametrize("bucket", [7, 100, 1_000_000])
def test_overlap_join_gives_each_pair_once(spark, bucket):
    rng = random.Random(bucket)
    a = [("a", s, s + rng.randint(1, 90)) for s in (rng.randint(0, 500) for _ in range(30))]
    b = [("b", s, s + rng.randint(1, 90)) for s in (rng.randint(0, 500) for _ in range(30))]
    right = spans(spark, b).select("k", F.col("i").alias("j"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    got = rows(intervals.overlap_join(spans(spark, a), right, ["k"], bucket), "i", "j", "overlap_ms")
    assert got == sorted((i, j, min(p[2], q[2]) - max(p[1], q[1])) for i, p in enumerate(a) for j, q in enumerate(b) if p[1] < q[2] and q[1] < p[2])


def test_attribution_by_overlap_then_nearest(spark):
    left = spans(spark, [("", 0, 10), ("", 100, 110), ("", 50_000, 50_010)])
    right = spans(spark, [("x", 5, 8), ("y", 2, 5), ("y", 30_110, 30_200)]).select("k", F.col("i").alias("j"), "label", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end")).withColumnRenamed("label", "r_label")
    got = intervals.attribute(left, right, ["k"], ["i"], ["j"], "r_label", 30_000)
    assert [(r.assigned, r.how) for r in got.orderBy("i").collect()] == [("x", "overlap"), ("x", "nearest"), ("y", "nearest")]
    assert [r.how for r in intervals.attribute(left, right.where("r_label = 'x'"), ["k"], ["i"], ["j"], "r_label", 10).orderBy("i").collect()] == ["overlap", "only", "only"]


def test_last_writer_wins(spark):
    df = spark.createDataFrame([(1, 1, "a", 0, 10), (1, 2, "b", 5, 8), (1, 3, "a", 10, 12), (1, 4, "c", 3, 3)], SPAN)
    assert rows(intervals.last_writer_timeline(df, ["k"], "i"), "start_ms", "end_ms", "label") == [(0, 5, "a"), (5, 8, "b"), (8, 12, "a")]


def test_subtract_gives_up_to_three_pieces(spark):
    left = spans(spark, [("a", 0, 100), ("b", 200, 210), ("c", 300, 310)])
    cut = spark.createDataFrame([(1, 10, 20), (1, 15, 30), (1, 90, 120), (1, 200, 210)], "k long, r_start long, r_end long")
    assert rows(intervals.subtract(left, cut, ["k"], ["i"]), "i", "p_start", "p_end") == [(0, 0, 10), (0, 30, 90), (2, 300, 310)]


def test_windows_anchors_and_runs(spark):
    w = intervals.dense_windows(spans(spark, [("a", 0, 25), ("a", 0, 10)]), 10, 5)
    assert rows(w, "i", "w_start", "w_end") == [(0, 0, 10), (0, 5, 15), (0, 10, 20), (0, 15, 25), (1, 0, 10)]
    points = spark.createDataFrame([(1, 5), (1, 10), (1, 11)], "k long, t long")
    anchors = spark.createDataFrame([(1, 10, 100)], "k long, t long, v long")
    assert [r.v for r in intervals.as_of(points, anchors, ["k"], "t", "v").orderBy("t").collect()] == [None, 100, 100]
    runs = intervals.label_runs(spans(spark, [("a", 0, 1), ("a", 2, 3), (None, 4, 5), (None, 5, 6), ("a", 6, 7)]), ["k"], ["start_ms"])
    assert [(r.label, r.n_rows) for r in runs.orderBy("run").collect()] == [("a", 2), (None, 2), ("a", 1)]


# -- vectors -----------------------------------------------------------------------------------------------------------


def test_cosine_of_edge_cases(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([3.0, 4.0, 9.0], [3.0, 4.0])], "a array<float>, b array<float>")
    assert [r.c for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == pytest.approx([1, 0, 0, 1])


def test_best_match_prefers_the_channel_and_is_strict(spark):
    p = spark.createDataFrame([("s1", "mic", [1.0, 0.0]), ("s1", "system", [0.0, 1.0]), ("s2", "system", [0.6, 0.8])], "speaker_id string, channel string, embedding array<float>")
    q = spark.createDataFrame([(1, "mic", [0.0, 1.0]), (2, "system", [0.0, 1.0]), (3, None, [0.0, 1.0])], "q_id long, q_channel string, q_vec array<float>")
    got = {r.q_id: (r.speaker_id, round(r.score, 6)) for r in vectors.best_match(q, p, 0.5).collect()}
    assert got == {1: ("s2", 0.8), 2: ("s1", 1.0), 3: ("s1", 1.0)}
    assert vectors.best_match(q, p, 1.0).count() == 0


def test_coherent_pick_drops_the_outlier(spark):
    rows_ = [("s", i, [float(np.cos(0.05 * i)), float(np.sin(0.05 * i)), 0.0], 20.0 - i) for i in range(7)] + [("s", 7, [0.0, 0.0, 1.0], 19.5), ("t", 8, [1.0, 0.0, 0.0], 1.0), ("t", 9, [0.0, 1.0, 0.0], 1.0)]
    df = spark.createDataFrame(rows_, "owner string, id long, v array<float>, d double")
    got = vectors.coherent_pick(df, "owner", "id", "v", "d", k=4)
    assert [r.id for r in got.where("owner = 's'").orderBy("pick").collect()] == [0, 1, 2, 3] and got.where("owner = 't'").count() == 2


def test_clusters_by_average_linkage():
    x_ = np.array([[1, 0], [0.99, 0.1], [0, 1], [0.05, 1], [-1, 0]], dtype=float)
    assert sequences.agglomerate(x_, 0.6).tolist() == [0, 0, 1, 1, 2]
    assert len(set(sequences.agglomerate(x_, 2.0, most=2).tolist())) == 2


# -- texts -------------------------------------------------------------------------------------------------------------


def test_text_functions(spark):
    df = spark.createDataFrame([("go go home home now",), ("so we go so we go on on",), ("aaaaaaaaaaaa",), ("",)], "t string")
    assert [r[0] for r in df.select(x.collapse_repeated_words(F.col("t"))).collect()] == ["go home now", "so we go so we go on", "aaaaaaaaaaaa", ""]
    assert [r[0] for r in df.select(x.collapse_repeated_phrases(F.col("t"))).collect()][1] == "so we go on on"
    assert [r[0] for r in df.select(x.is_meaningless(F.col("t"))).collect()] == [False, False, True, False]
    assert [round(r[0], 3) for r in df.select(x.repetition_ratio(F.col("t"))).collect()] == [0.4, 0.5, 0.0, 0.0]
    assert df.limit(1).select(x.fnv1a_64(F.lit("a"))).first()[0] == 0xAF63DC4C8601EC8C - (1 << 64)
    s = spark.createDataFrame([("Well said J. R. Smith. «Продолжение следует...» Ставьте лайк всем! Go!",)], "t string").select(x.drop_invented("t").alias("r")).select("r.*").first()
    assert s.kept == "Well said J. R. Smith. Go!" and s.n_removed == 2


def test_chunks_cover_and_advance():
    text = "One. Two is here. " + "x" * 50 + " tail end"
    for size, overlap in ((20, 5), (10, 10), (1000, 10)):
        found = x.chunk_spans(text, size, overlap)
        assert found[0][0] == 0 and found[-1][1] == len(text)
        assert all(b[0] <= a[1] and b[0] > a[0] for a, b in zip(found, found[1:]))


def test_edit_counts_and_votes():
    assert al.edit_counts("a b c d".split(), "a x c".split()) == (1, 1, 0)
    assert al.edit_counts("a b".split(), "z z a b z".split(), free_end=False) == (0, 0, 3)
    assert al.edit_counts(["*"], ["w"], wild="*") == (0, 0, 0)
    assert x.confusion_vote("a b c".split(), ["a x c".split(), "a x".split()]) == ["a", "x", "c"]


def test_token_blocks():
    t = lambda s: [(w, i, i + 1, None if w == "-" else w) for i, w in enumerate(s)]
    assert [b["speaker"] for b in sequences.token_blocks(t("aabbaa"))] == ["a", "b", "a"]
    assert [b["speaker"] for b in sequences.token_blocks(t("aabaa"))] == ["a"]
    assert [b["speaker"] for b in sequences.token_blocks(t("--aa-bb"))] == ["a", "b"]
    blocks = sequences.token_blocks(t("aabbcc"))
    assert [b["speaker"] for b in blocks] == ["a", "b", "c"] and all(p["end"] == n["start"] for p, n in zip(blocks, blocks[1:])) and sequences.token_blocks(t("--")) == []


def test_packing_cuts_and_alignment():
    assert sequences.pack_pieces([10, 10, 10, 40, 5], 25, 3) == [0, 0, 1, 2, 3]
    quiet = np.ones(100)
    quiet[40:50] = 0
    assert 40 <= sequences.quiet_cuts(quiet, 60, 4, 1)[0] <= 50 and sequences.quiet_cuts(quiet, 100, 4, 1) == []
    p = np.log(np.full((6, 3), 0.05))
    for f, s in enumerate([0, 1, 1, 0, 2, 0]):
        p[f, s] = np.log(0.9)
    assert sequences.viterbi_align(p, [1, 2]) == [(1, 2), (4, 4)]


# -- metrics -----------------------------------------------------------------------------------------------------------


def test_error_rate_of_one_label(spark):
    ref = spark.createDataFrame([("a", "S0", 0, 5), ("a", "S1", 5, 10), ("b", "S0", 0, 4), ("b", "S1", 4, 9)], "k string, label string, start_ms long, end_ms long")
    same = metrics.error_components(ref, ref, ["k"]).agg(F.sum(F.col("miss") + F.col("false_alarm") + F.col("confusion"))).first()[0]
    one = ref.groupBy("k").agg(F.lit("X").alias("label"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    got = metrics.error_components(ref, one, ["k"], metrics.label_mapping(ref, one, ["k"])).agg(*[F.sum(c) for c in ("total", "miss", "false_alarm", "confusion")]).first()
    assert same == 0 and tuple(got) == (19, 0, 0, 9)


def test_assignment_is_optimal():
    rng = np.random.default_rng(5)
    from itertools import permutations

    for n, m in ((3, 3), (2, 4), (4, 2)):
        w = rng.integers(0, 50, (n, m))
        best = max(sum(w[i, p[i]] for i in range(n)) for p in permutations(range(m), n)) if n <= m else max(sum(w[p[j], j] for j in range(m)) for p in permutations(range(n), m))
        assert sum(w[i, j] for i, j in metrics.assign(w)) == best


def test_lag_cases(spark):
    ref = spark.createDataFrame([(1, i, "s", a, b) for i, (a, b) in enumerate([(1000, 3000), (5000, 7000), (11_000, 13_000)])], SPAN)
    e = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate([(500, 2000), (4000, 6000), (4500, 8000)])], "k long, idx long, start_ms long, end_ms long")
    assert [r.lag_ms for r in metrics.emission_lag(ref, e, ["k"], "i").orderBy("i").collect()] == [1000, 1000, None]


def test_missing_samples_fail_gates(spark):
    m = spark.createDataFrame([(1, "a", None), (1, "b", 1.0), (1, "c", 3.0)], "k long, metric string, value double")
    b = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 2.0)], "metric string, bound double")
    assert rows(metrics.gate_failures(m, b, ["k"]), "metric", "reason") == [("a", "no sample"), ("c", "above bound")]


# -- tables ------------------------------------------------------------------------------------------------------------


def test_changes(spark):
    old = spark.createDataFrame([(1, "a", "user"), (2, "b", "auto")], "id long, v string, by string")
    new = spark.createDataFrame([(1, "x", "auto"), (2, "y", "auto"), (3, "z", "auto")], "id long, v string, by string")
    assert rows(changes.upsert(old, new, ["id"]), "id", "v") == [(1, "x"), (2, "y"), (3, "z")]
    assert rows(changes.guarded_upsert(old, new, ["id"], F.col("by") == "user"), "id", "v") == [(1, "a"), (2, "y"), (3, "z")]
    assert rows(changes.insert_ignore(old, new, ["id"]), "id", "v") == [(1, "a"), (2, "b"), (3, "z")]
    asked = spark.createDataFrame([(1, "user"), (2, "user")], "id long, by string")
    assert rows(changes.compare_and_set(old, asked, "id", "by", "v", F.lit("!")), "id", "v") == [(1, "!"), (2, "b")]
    left = changes.cascade_delete({"t": old}, spark.createDataFrame([(1,), (2,)], "id long"), "id", {"t": F.col("by") == "user"})["t"]
    assert [tuple(r) for r in left.collect()] == [(None, "a", "user")]


def test_names_pages_and_votes(spark):
    df = spark.createDataFrame([("o", False, "a", "c", "l"), (None, False, "a", "c", "l"), (None, True, "a", "c", "l"), (None, None, None, None, "l")], "o string, u boolean, a string, c string, l string")
    name, source = relational.display_name(*(F.col(c) for c in "ouacl"))
    assert [tuple(r) for r in df.select(name, source).collect()] == [("o", "override"), ("a", "row"), ("c", "user"), ("l", "legacy")]
    p = relational.page(spark.range(10), ["id"], 8, 5)
    assert [(r.id, r.total, r.has_more) for r in p.collect()] == [(8, 10, False), (9, 10, False)]
    v = spark.createDataFrame([(1, "en", 2), (1, "de", 2), (2, "en", 1)], "k long, lang string, n long")
    assert rows(relational.weighted_vote(v, "k", "lang", F.col("n")), "k", "winner", "reason") == [(1, None, "tie"), (2, "en", "majority")]
    d = spark.createDataFrame([(1, 5, None), (1, 3, "c"), (None, 1, "n")], "k long, q long, clip string")
    assert {(r.k, r.q, r.clip) for r in relational.dedupe_with_donor(d, ["k"], [F.desc("q")], "clip").collect()} == {(1, 5, "c"), (None, 1, "n")}


# -- files -------------------------------------------------------------------------------------------------------------


def test_files(spark, tmp_path):
    (tmp_path / "a.rttm").write_text("SPEAKER u 1 0.500 1.250 <NA> <NA> S0 <NA> <NA>\n")
    assert [tuple(r) for r in files.read_rttm(spark, str(tmp_path / "a.rttm")).collect()] == [("u", 500, 1750, "S0")]
    (tmp_path / "bad.rttm").write_text("SPEAKER u 1 x 1.250 <NA> <NA> S0 <NA> <NA>\n")
    with pytest.raises(Exception, match="invalid RTTM"):
        files.read_rttm(spark, str(tmp_path / "bad.rttm")).collect()
    (tmp_path / "empty.rttm").write_text("")
    assert files.read_rttm(spark, str(tmp_path / "empty.rttm")).count() == 0
    (tmp_path / "s.jsonl").write_text('{"version": 1}\n{"index": 0, "start": 0.5, "end": 1, "speaker": "a", "stable": true}\n')
    assert files.read_sidecar(spark, str(tmp_path / "s.jsonl")).count() == 1
    (tmp_path / "headless.jsonl").write_text('{"index": 0}\n')
    with pytest.raises(ValueError):
        files.read_sidecar(spark, str(tmp_path / "headless.jsonl"))
    (tmp_path / "l.json").write_text('[{"id": 1, "data": {"audio": "/x/rec1.wav"}, "annotations": [{"result": []}, {"result": [{"from_name": "labels", "value": {"start": 1, "end": 2, "labels": ["Speaker A"]}}, {"from_name": "other", "value": {"start": 1, "end": 2, "labels": ["n"]}}]}]}]')
    assert [tuple(r) for r in files.read_label_export(spark, str(tmp_path / "l.json")).collect()] == [("rec1", 1.0, 2.0, "speaker_a")]
    (tmp_path / "c.csv").write_text("who,text\na,hi\nb,  \n")
    assert files.read_script(spark, str(tmp_path / "c.csv")).count() == 1
    (tmp_path / "n.csv").write_text("who\na\n")
    with pytest.raises(ValueError):
        files.read_script(spark, str(tmp_path / "n.csv"))


# -- streams -----------------------------------------------------------------------------------------------------------


def test_flush_rules():
    assert live.flush(None, [(0, 100), (599, 700), (1200, 1300)], 500, 10_000) == ((1200, 1300, 1), [(0, 700, 2, "gap")])
    assert live.flush(None, [(0, 100), (600, 700)], 500, 10_000)[1] == [(0, 100, 1, "gap")]
    assert live.flush((0, 9000, 3), [(9100, 10_500)], 500, 10_000) == (None, [(0, 10_500, 4, "length")])
    assert live.flush((0, 1, 1), [], 500, 10_000, True) == (None, [(0, 1, 1, "stop")])


def test_reconcile_revisions():
    s, out = live.reconcile(None, [("turn", 0, 0, 50, "a"), ("block", 1, 0, 100, ""), ("turn", 2, 40, 99, "b"), ("turn", 3, 100, 120, "c"), ("block", 4, 500, 600, ""), ("turn", 5, 90, 95, "a"), ("stop", 0, 0, 0, "")])
    assert [r[:4] for r in out] == [(1, 1, "a", False), (1, 2, "b", False), (1, 2, "b", True)] and s["odd"] and not s["held"]
    assert s["settled"] == [[1, 2, "b", True], [4, 0, None, True]] and not out[0][4]


def test_held_and_settled_blocks_overflow(monkeypatch):
    monkeypatch.setattr(live, "HELD", 2)
    monkeypatch.setattr(live, "SETTLED", 3)
    s, out = live.reconcile(None, [("turn", 0, 0, 50, "a")] + [("block", i, 10 * i, 10 * i + 10, "") for i in range(1, 7)])
    assert [r[0] for r in out] == [1, 2, 3, 4] and [b["id"] for b in s["held"]] == [5, 6]
    assert s["settled"] == [[2, 1, "a", False], [3, 1, "a", False], [4, 1, "a", False]]


def test_silence_closes_what_other_channels_leave_behind(spark, tmp_path):
    parts = [[(1, 0, 100), (2, 0, 150)], [(2, 400, 1000)], [(2, 5000, 5100)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "k long, start_ms long, end_ms long").coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
        time.sleep(1.1)  # files come in the order of their times
    stream = spark.readStream.schema("k long, start_ms long, end_ms long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = runner.run_now(live.pending_segments(stream, "k", 500, 10_000, late="0 seconds"))
    assert rows(got, *got.columns) == [(1, 0, 100, 1, "silence"), (2, 0, 1000, 2, "gap")] or rows(got, *got.columns) == [(1, 0, 100, 1, "silence"), (2, 0, 1000, 2, "silence")]
    assert rows(runner.run_now(live.pending_segments(stream, "k", 500, 10_000, 500, late="0 seconds")), "k") == [(2,)]


def test_finalize_and_rebind(spark):
    S = "key long, block_id long, start_ms long, end_ms long, label string, revision int, decided boolean, by_user boolean"
    shown = spark.createDataFrame([(1, 1, 0, 10, "a", 1, True, False), (1, 2, 10, 20, "a", 1, True, False), (1, 3, 20, 30, "b", 2, False, False), (1, 4, 30, 40, "a", 1, True, True), (1, 5, 40, 50, "a", 1, True, False), (1, 6, 90, 95, None, 0, False, False), (1, 7, 60, 70, None, 0, False, False)], S)
    turns = spark.createDataFrame([(1, 0, 10, "a"), (1, 10, 60, "b"), (1, 60, 70, "c")], "key long, start_ms long, end_ms long, label string")
    windows = spark.createDataFrame([(1, 45, 46)], "key long, start_ms long, end_ms long")
    got = live.finalize(shown, turns, windows)
    assert rows(got, "block_id", "revision", "label") == [(2, 2, "b"), (3, 3, "b"), (7, 1, "c")]
    assert [r[0] for r in rows(live.finalize(shown, turns, windows, True), "block_id")] == [1, 2, 3, 7]
    names = spark.createDataFrame([(1, "a", "Ann")], "key long, label string, display_name string")
    assert rows(live.rebind(shown, names), "block_id", "revision", "display_name", "matched_by", "match_score") == [(i, 2, "Ann", "user", None) for i in (1, 2, 4, 5)]


def test_split_rows_equal_the_scan(spark):
    rng = random.Random(12)
    data, want = [], []
    for r in range(60):
        tokens = [(f"w{k}", 10 * k, 10 * k + rng.randint(1, 25), rng.choice(["a", "a", "b", None]) if rng.random() < 0.8 else "c") for k in range(rng.randint(1, 25))]
        data += [(r, k, *t) for k, t in enumerate(tokens)]
        want += [(r, n, b["speaker"], b["start"], b["end"], b["text"]) for n, b in enumerate(sequences.token_blocks(tokens))]
    df = spark.createDataFrame(data, "row long, pos long, text string, start_ms long, end_ms long, speaker string")
    assert rows(sequences.split_rows(df, ["row"]), "row", "block", "speaker", "start_ms", "end_ms", "text") == sorted(want)


def test_one_copy_of_a_phrase_goes(spark):
    cases = {"a b a b a b c": "a b a b c", "x a b a b y": "x a b y", "a b c d e a b c d e": "a b c d e", "one two one two": "one two", "go on go": "go on go", "ab abab ab": "ab abab ab", "a bc a b c": "a bc a b c", "": ""}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", x.collapse_repeated_phrases(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in got} == cases


def test_error_rate_words(spark):
    cases = {"Ё-моё, 31 535 руб.": "е мое тридцать одна тысяча пятьсот тридцать пять руб", "1.234.567 эм 21": "один миллион двести тридцать четыре тысячи пятьсот шестьдесят семь двадцать один", "[неразб] 0 и 100": "<unk> ноль и сто", "5 12000": "пять двенадцать тысяч", "v2": "v два", "2000000 1002": "два миллиона одна тысяча два"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", x.normalize_words(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in got} == cases


def test_palette_keys(spark):
    got = spark.createDataFrame([("",), ("a",), (" Foobar ",)], "t string").select("t", x.fnv1a_32(F.lower(F.trim("t"))).alias("h")).collect()
    assert {r.t: r.h for r in got} == {"": 0x811C9DC5, "a": 0xE40C292C, " Foobar ": 0xBF9CF968}


def test_rows_with_nulls_are_demoted_too(spark):
    left = spark.createDataFrame([(1, None, 0, 10), (1, "x", 0, 10), (1, None, 50, 60)], "k long, v string, start_ms long, end_ms long")
    right = spark.createDataFrame([(1, 5, 6)], "k long, r_start long, r_end long")
    assert [tuple(r) for r in intervals.without_overlap(left, right, ["k"]).collect()] == [(1, None, 50, 60)]


def test_stream_equals_its_batch_twin(spark, tmp_path):
    rng = random.Random(6)
    data = pd.DataFrame({"key": [i % 3 for i in range(300)], "arrival": range(300), "kind": [rng.choice(["turn", "block"]) for _ in range(300)], "id": range(300)})
    data["start_ms"] = [10 * i + rng.randint(-40, 40) for i in range(300)]
    data["end_ms"] = data["start_ms"] + [rng.randint(1, 90) for _ in range(300)]
    data["label"] = [rng.choice("abc") for _ in range(300)]
    for k in range(3):
        spark.createDataFrame(data[data.arrival // 100 == k]).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    batch = spark.read.parquet(str(tmp_path / "in")).drop("part")
    parts = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(*[str(tmp_path / "in/*")])
    got = runner.run_now(stateful.live_labels(parts))
    assert rows(got, *got.columns) == rows(live.live_labels_batch(batch), *got.columns) and got.count() > 20
