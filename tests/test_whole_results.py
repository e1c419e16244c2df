"""Results without limits: what the findings on odd inputs and larger tables asked for."""

from __future__ import annotations

import random

import duckdb
from pyspark.sql import functions as F

from colloquy.functions import text as x
from colloquy.operators import sequences
from colloquy.plans import registry
from colloquy.streaming import live, runner, stateful

from test_stateful import ROWS, streamed


def revisions(rows):
    """What blocks show, by looking at all turns again for every row."""
    out, turns, blocks = [], [], []
    odd, last = False, None
    for kind, ident, start, end, label in rows:
        if kind == "turn":
            odd |= last is not None and (start < last[0] or end < last[1])
            last = (start, end)
            turns.append((start, end, label))
        else:
            blocks.append([ident, start, end, None, 0, False])
        high = max((t[0] for t in turns), default=-1)
        for b in blocks if kind == "turn" else blocks[-1:]:
            if b[5]:
                continue
            over = [(min(t[1], b[2]) - max(t[0], b[1]), t[2]) for t in turns if t[0] < b[2] and b[1] < t[1]]
            best = max(over, key=lambda x: x[0])[1] if over else None
            final = high >= b[2]
            if best is not None and best != b[3]:
                b[3], b[4] = best, b[4] + 1
                out.append((b[0], b[4], best, final, odd))
            elif final and b[3] is not None:
                out.append((b[0], b[4], b[3], True, odd))
            b[5] = final
    return out


def live_rows(n):
    """Turns and blocks in two passes over the same hours, many undecided at once, some without length."""
    rng, rows = random.Random(5), []
    for k in range(n):
        start = k % (n // 2) * 20_000
        length = rng.choice([0, 1000, 90_000, 4_000_000, 30_000_000])
        rows.append(("turn" if rng.random() < 0.4 else "block", k, start, start + length, rng.choice("abc")))
    return rows


def test_labels_of_spans_without_length_of_many_undecided_and_of_late_blocks(monkeypatch):
    monkeypatch.setattr(live, "HELD", 32)
    assert live.reconcile(None, [("turn", 0, 0, 50, "a"), ("block", 1, 20, 20, "")], whole=True)[1] == [(1, 1, "a", False, False)]
    assert live.reconcile(None, [("block", 1, 0, 50, ""), ("turn", 2, 20, 20, "a")])[1] == [(1, 1, "a", False, False)]
    rows = live_rows(900)
    state, out = live.reconcile(None, rows, whole=True)
    assert out == revisions(rows) and len(state["held"]) > live.HELD
    assert len(state["turns"]) < sum(r[0] == "turn" for r in rows)


def test_a_stream_of_whole_labels_equals_its_rows(spark):
    rows = [(1, k, *r) for k, r in enumerate(live_rows(900))]
    got = runner.run_now(stateful.live_labels(streamed(spark, rows, ROWS, [rows[:400], rows[400:]]), whole=True))
    want = sorted((1, *r) for r in revisions([r[2:] for r in rows]))
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sorted(tuple(r) for r in live.live_labels_batch(spark.createDataFrame(rows, ROWS), whole=True).collect()) == want


def test_a_capital_is_one_letter(spark):
    words = ["ßa", "ﬁn", "ŉa", "ᾳx", "ǆx", "ƛx", "ıx", "éa", "uh", ""]
    df = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k long, text string")
    got = [r[0] for r in df.select("k", x.tidy(F.col("text")).alias("t")).orderBy("k").select("t").collect()]
    assert got == ["ẞa", "ﬁn", "ŉa", "ᾼx", "Ǆx", "ƛx", "Ix", "Éa", "", ""]


def test_votes_of_texts_that_differ_in_many_places():
    rng = random.Random(3)
    for _ in range(200):
        pivot = [rng.choice(["the", "de", "d", "a", "that", "dat"]) for _ in range(rng.randrange(12))]
        other = [w.replace("th", "d") for w in pivot]
        assert x.confusion_vote(pivot, [other, other]) == other


def test_words_of_voted_texts_end_at_ascii_space(spark):
    df = spark.createDataFrame([(1, s, "a\u00a0b\x0bc th") for s in "abc"], "k long, s string, t string")
    assert sequences.weave_sources(df, "k", "s", "t", "a").first().voted == "a\u00a0b\x0bc th"


def test_texts_without_words_have_no_digest(spark, tmp_path):
    texts = [None, "", " \n", "a", "a a", "a b b a"]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in registry.QUERIES["word_dedupe"](spark, str(tmp_path)).select("doc_id", "clean_sha256").collect())
    found = duckdb.sql(registry.ORACLES["word_dedupe"].replace("from documents", f"from '{tmp_path}/documents.parquet/*.parquet'"))
    assert got == sorted(found.fetchall()) and [r[1] is None for r in got] == [True] * 3 + [False] * 3
