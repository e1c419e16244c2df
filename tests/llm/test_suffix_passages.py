"""Two lengths at once: passages shorter than the contract's 400 bytes go from the text, its own columns stay as they are."""

from __future__ import annotations

import hashlib
import random

import pytest

from colloquy.llm import queries, suffix


def _prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("aeioustrnlé") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.mark.parametrize(("shard", "passage"), [(1, 60), (3, 40), (512, 60), (2, 100)])
def test_both_lengths_equal_brute_force(spark, monkeypatch, shard, passage):
    monkeypatch.setattr(suffix, "SHARD", shard)
    rng = random.Random(23)
    long, short, tail = _prose(rng, 60), _prose(rng, 18), _prose(rng, 40)
    rows = [((1 << 60) + i if i % 5 else None, _prose(rng, 20) + long[rng.randint(0, 60) :] + _prose(rng, 20) + short + _prose(rng, 9) + (tail if i % 3 == 0 else "")) for i in range(20)]
    rows += [(100, long), (101, long[40:]), (102, None), (103, rows[0][1]), (103, rows[1][1]), (103, rows[1][1]), (104, long + long), (105, short), (106, "ab" * 90), (107, "")]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 100, 24, passage=passage).collect()
    texts = [t for _, t in rows]
    want = [(n, gone, runs, kept, n - len(left), wide, left.decode("utf-8", "ignore")) for (n, gone, runs, kept), (_, _, wide, left) in zip(suffix.brute_force(texts, 100), suffix.brute_force(texts, passage), strict=True)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, r._n_bytes, r._n_removed, r._n_spans, bytes(r._kept), r._n_passage_bytes, r._n_passages, r._passage_text) for r in got), key=key) == sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=key)


def test_passage_longer_than_the_length_is_an_error(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    for passage in (0, 23, 101):
        with pytest.raises(ValueError, match="passage"):
            suffix.remove_repeats(docs, 100, 24, passage=passage)


def test_query_drops_passages_of_over_50_words(spark, tmp_path):
    """Passages of 55 words, shorter than 400 bytes, that two documents share; and longer ones, which both lengths find."""
    rng = random.Random(24)
    prose = lambda n: " ".join("".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 7))) for _ in range(n))
    passages, longer = [prose(55) for _ in range(12)], prose(100)
    texts = {i: prose(120) + "\n" + passages[i % 12] + "\n" + prose(120) for i in range(24)} | {100 + i: prose(200) for i in range(10)} | {200 + i: prose(90) + "\n" + longer for i in range(2)} | {300: None}
    assert max(len(p) for p in passages) < 390 and len(longer) > 400
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op3_suffix_array_dedup(spark, str(tmp_path)).collect()}
    for (i, text), (n, gone, runs, kept) in zip(texts.items(), suffix.brute_force(list(texts.values())), strict=True):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, runs, hashlib.sha256(kept).hexdigest())
        assert r.text == (text or "") if i in (300, *range(100, 110)) else (passages[i % 12] if i < 100 else longer) not in r.text
        assert r.n_passage_bytes == n - len(r.text.encode())
        if i < 24:
            before, after = text.split("\n" + passages[i % 12] + "\n")
            assert r.n_removed == 0 and r.n_passages == 1 and r.text.startswith(before[:-12]) and r.text.endswith(after[12:])
