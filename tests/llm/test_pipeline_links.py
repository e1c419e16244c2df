"""The pipeline's near-duplicate stage links from 0.8."""

from __future__ import annotations

import random

import corpus_pipeline
from colloquy.llm import minhash


def test_pairs_between_80_and_85_percent_are_linked(spark):
    rng = random.Random(80)
    rows = []
    for n in (46, 49, 50, 52, 55, 58, 60, 63, 64, 70):  # one word changed: (n - 9) / (n + 1) of the shingles are shared
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        changed = [*words[: n // 2], "other", *words[n // 2 + 1 :]]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(changed))]
    top = minhash.brute_force(rows, 80)
    want = [r for r in rows if top[r[0]] == r[0]]
    assert len(want) == 11 and all(r in want for r in rows[:2])
    got = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(tuple(r) for r in got.collect()) == want
