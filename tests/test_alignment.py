"""Alignments against a full cost table, and words in another script against a plain subsequence table."""

from __future__ import annotations

import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from colloquy.functions import alignment as al


def full_table(ref, hyp, free_ends, wild):
    """Pairs by a table of all costs and steps: a pair before a deletion before an insertion."""
    m, n = len(ref), len(hyp)
    cost = {(0, j): 0 if free_ends else j for j in range(n + 1)}
    step = {(0, j): "I" for j in range(n + 1)}
    for i in range(1, m + 1):
        free = ref[i - 1] == wild
        cost[i, 0], step[i, 0] = cost[i - 1, 0] + (not free), "D"
        for j in range(1, n + 1):
            options = [(cost[i - 1, j - 1] + (not free and ref[i - 1] != hyp[j - 1]), "S"), (cost[i - 1, j] + (not free), "D"), (cost[i, j - 1] + 1, "I")]
            cost[i, j], step[i, j] = min(options, key=lambda o: o[0])
    i, j = m, min(range(n + 1), key=lambda k: cost[m, k]) if free_ends else n
    out = []
    while i > 0 or (j > 0 and not free_ends):
        s = step[i, j]
        out.append((s, ref[i - 1] if s != "I" else "", hyp[j - 1] if s != "D" else ""))
        i, j = i - (s != "I"), j - (s != "D")
    return out[::-1]


@pytest.mark.parametrize("cells", [1 << 22, 8])
def test_paths_equal_a_full_table(monkeypatch, cells):
    monkeypatch.setattr(al, "CELLS", cells)
    rng = random.Random(cells)
    for _ in range(300):
        ref, hyp = ([rng.choice(["a", "b", "c", "*"]) for _ in range(rng.randrange(14))] for _ in range(2))
        hyp = [w for w in hyp if w != "*"]
        for free in (False, True):
            want = full_table(ref, hyp, free, "*")
            got = [("SDI"[k], ref[i] if k != al.INSERT else "", hyp[j] if k != al.DELETE else "") for k, i, j in al.path(ref, hyp, free, "*")]
            assert got == want


def test_unheard_words_cost_nothing():
    assert al.align(["<unk>", "a"], ["a"]) == (0, 0, 0, [("<unk>", ""), ("a", None)])
    assert al.align(["<unk>", "a"], ["b", "a"]) == (0, 0, 0, [("<unk>", None), ("a", None)])
    assert al.align([], ["a"]) == (0, 0, 0, []) and al.align(["a"], []) == (0, 1, 0, [("a", "")])
    assert al.align([], ["a"], free_ends=False)[2] == 1


def test_long_texts_in_little_memory():
    rng = random.Random(2)
    ref = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    hyp = [w if rng.random() < 0.9 else "x" for w in ref]
    tracemalloc.start()
    sub, dele, ins, pairs = al.align(ref, hyp[:15_000], free_ends=True)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50 << 20 and dele - ins == 5000 and len(pairs) == 20_000 + ins


def test_words_in_another_script(spark):
    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(9)
    for _ in range(300):
        a, b = ("".join(rng.choice("абв") for _ in range(rng.randrange(9))) for _ in range(2))
        assert al.common_length(a, b) == table(a, b)
    rows = [("hotfix", "хотфикс"), ("shift", "шифт"), ("cat", "кот"), ("cat", "собака"), ("cat", "dog"), ("Cat", "кат"), ("кат", "cat"), ("cat", ""), ("cat", None), (None, "кот"), ("night", "найт")]
    got = [r.hit for r in spark.createDataFrame(rows, "r string, h string").coalesce(1).select(al.other_script(F.col("r"), F.col("h")).alias("hit")).collect()]
    assert got == [True, True, True, False, False, False, False, False, False, False, True]
