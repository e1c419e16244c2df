"""Windows that agree with no other segment of their gram stay out of the suffix arrays; those that repeat all go in."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from colloquy.llm import suffix


def _contested(texts: list[bytes], length: int, gram: int) -> dict[int, list[bytes]]:
    """The distinct segments of each gram."""
    row, key, _, lo, hi = suffix.anchors_of(texts, length, gram)
    by: dict[int, dict[bytes, None]] = {}
    for r, k, a, b in zip(row.tolist(), key.tolist(), lo.tolist(), hi.tolist(), strict=True):
        by.setdefault(k, {})[texts[r][a : b + length]] = None
    return {k: list(some) for k, some in by.items() if len(some) > 1}


@pytest.mark.parametrize(("length", "gram"), [(60, 24), (40, 24), (100, 32)])
def test_only_windows_that_may_repeat_are_sorted(monkeypatch, length, gram):
    rng = random.Random(31)
    line = lambda n: bytes(rng.choices(b"abcde \0", k=n))
    gram_alone, passage = line(gram), line(length + 30)
    texts = [line(150) + gram_alone + line(150) for _ in range(60)] + [line(rng.randint(0, 90)) + passage[rng.randint(0, 9) :] + line(90) for _ in range(12)]
    texts += [b"ab" * 200 + line(9), b"ab" * 150, b"", line(length - 1), b"\0" * 300, b"x" + b"\0" * 200]
    by, given = _contested(texts, length, gram), []
    segments, grams = [s for some in by.values() for s in some], [k for k, some in by.items() for _ in some]
    seen = Counter(s[k : k + length] for s in segments for k in range(len(s) - length + 1))
    want = [[seen[s[k : k + length]] > 1 for k in range(len(s) - length + 1)] for s in segments]
    assert [w.tolist() for w in suffix.repeated_windows(segments, length)] == want  # also where zeros end the last segment
    whole = suffix.suffix_array
    monkeypatch.setattr(suffix, "suffix_array", lambda raw, depth: given.append(len(raw)) or whole(raw, depth))
    got = suffix.repeated_possible(segments, grams, length, gram)
    assert [g.tolist() for g in got] == want and any(map(any, want))
    assert sum(given) < sum(map(len, segments))


def test_segments_that_share_no_window_need_no_array(monkeypatch):
    rng = random.Random(32)
    line = lambda n: bytes(rng.choices(b"abcdefghij ", k=n))
    gram = line(32)
    segments = [line(368) + gram + line(368) for _ in range(40)]
    key = suffix.gram_hashes(np.frombuffer(gram, np.uint8), 32).view(np.int64)[0]
    monkeypatch.setattr(suffix, "suffix_array", None)
    assert not any(h.any() for h in suffix.repeated_possible(segments, [int(key)] * 40))


def test_segments_of_many_texts_are_those_of_each(monkeypatch):
    rng = random.Random(33)
    monkeypatch.setattr(suffix, "_BLOCK", 700)
    monkeypatch.setattr(suffix, "_PIECE", 900)
    texts = [bytes(rng.choices(b"ab ", k=rng.choice([0, 5, 99, 100, 101, 400, 3000]))) for _ in range(80)]
    columns = suffix.anchors_of(texts, 100, 24)
    assert columns[0].tolist() == sorted(columns[0].tolist())
    for k, raw in enumerate(texts):
        mine = columns[0] == k
        assert list(zip(*(c[mine].tolist() for c in columns[1:]), strict=True)) == suffix.anchors(raw, 100, 24)
        covered = [w for lo, hi in zip(columns[3][mine].tolist(), columns[4][mine].tolist(), strict=True) for w in range(lo, hi + 1)]
        assert covered == list(range(max(0, len(raw) - 99)))
