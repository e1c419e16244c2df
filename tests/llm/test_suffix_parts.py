"""A gram of many classes is dealt over shards and merged: the same bytes go, for null ids and copies too."""

from __future__ import annotations

import random

import pytest

from colloquy.llm import suffix


@pytest.mark.parametrize("shard", [1, 2, 3, 512])
def test_parts_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(suffix, "SHARD", shard)
    rng = random.Random(17)
    prose = lambda n: " ".join("".join(rng.choice("aeioustrnl") for _ in range(rng.randint(1, 7))) for _ in range(n))
    passage, other = prose(60), prose(40)
    rows = [((1 << 60) + i if i % 5 else None, prose(20) + passage + prose(20) + (other if i % 3 == 0 else "")) for i in range(20)]
    rows += [(100, passage), (101, passage[40:]), (102, None), (103, rows[0][1]), (103, rows[1][1]), (104, passage + passage)]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 100, 24).collect()
    want = suffix.brute_force([t for _, t in rows], 100)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, r._n_bytes, r._n_removed, r._n_spans, bytes(r._kept)) for r in got), key=key) == sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=key)
