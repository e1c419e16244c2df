"""The pipeline against brute force, stage by stage, on a small folder with copies, junk, shared passages and nulls."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers

import corpus_pipeline
from colloquy.llm import bpe, minhash, mixing, quality, suffix

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(21)
    prose = lambda n: " ".join("".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 7))) for _ in range(n))
    passage, base = prose(90) + " ünd schön", prose(150)
    texts = [base, base, base.replace(base.split()[3], "other", 1), None, "", "too short", "same words again " * 60]
    texts += [prose(60) + "\n" + passage + "\n" + prose(40) for _ in range(4)] + [prose(rng.randint(60, 200)) for _ in range(25)]
    rows = [(i, t, "xx", [None, "a", "b"][i % 3], len(t or "")) for i, t in enumerate(texts)] + [(0, base, "xx", None, len(base))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    sf_dir = str(tmp_path)

    good = [r for r in rows if quality.verdict(quality.measure(r[1]))[1]]
    component = minhash.brute_force([(r[0], r[1]) for r in good], 80)
    single = sorted({r[0]: r for r in good if component[r[0]] == r[0]}.values())
    left = []
    for r, (_, removed, _, kept) in zip(single, suffix.brute_force([r[1] for r in single], corpus_pipeline.REPEATED), strict=True):
        text = kept.decode("utf-8", "ignore") if removed else r[1]
        if text or not removed:
            left.append((r[0], text, r[2], r[3], len(text) if removed else r[4]))
    assert len(single) < len(good) < len(rows) and sum(len(x[1]) for x in left) < sum(len(x[1]) for x in single)

    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen[name] = docs
        if name != "tokens":
            assert docs.columns == COLUMNS
    key = lambda r: tuple("" if v is None else v for v in r)
    for name, want in (("quality", good), ("near_dedup", single), ("substring_dedup", left)):
        assert sorted((tuple(r) for r in seen[name].collect()), key=key) == sorted(want, key=key), name

    size = {r[0]: len(quality._WORD.findall(r[1])) for r in left}
    names = sorted({r[3] for r in left}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[r[0]] for r in left if r[3] == s) for s in names}
    copies = Counter(r.doc_id for r in seen["mixing"].collect())
    for s, target in zip(names, mixing.targets([total[s] for s in names]), strict=True):
        taken = sum(size[r[0]] * copies[r[0]] for r in left if r[3] == s)
        assert abs(taken - target) <= max(size.values()) and max(copies.values()) <= 3

    v = bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    text = {r[0]: r[1] for r in left}
    final = seen["tokens"].collect()
    assert Counter(r.doc_id for r in final) == copies
    for r in final:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(text[r.doc_id]) and r.n_tokens == len(r.ids) // 4
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()

    again = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in again) == Counter((r.doc_id, r.decoded_sha256) for r in final)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_passages_of_55_words_go_and_their_surroundings_stay(spark):
    rng = random.Random(55)
    prose = lambda n: " ".join("".join(rng.choice("aeioustrnl") for _ in range(rng.randint(1, 8))) for _ in range(n))
    passages = [prose(55) for _ in range(12)]
    rows = [(i, prose(120) + "\n" + passages[i % 12] + "\n" + prose(120), "en", "s", 0) for i in range(48)] + [(100 + i, prose(200), "en", "s", 0) for i in range(20)]
    assert min(len(p) for p in passages) < 400
    got = {r.doc_id: r.text for r in corpus_pipeline.substring_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()}
    for i, text, *_ in rows:
        if i < 100:
            before, after = text.split("\n" + passages[i % 12] + "\n")
            assert passages[i % 12] not in got[i] and got[i].startswith(before[:-12]) and got[i].endswith(after[12:])  # a repeat may reach over equal neighbours
        else:
            assert got[i] == text
