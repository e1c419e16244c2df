"""What the pipeline's Python workers hold: short batches of rows, few remembered encodings, the same ids."""

from __future__ import annotations

import random

import public_tokenizers

import corpus_pipeline
from colloquy.llm import bpe
from colloquy.llm.common import small_batches

SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_stages_send_short_batches(spark):
    docs = spark.createDataFrame([(i, "some words of a text " + str(i), "en", "s", 9) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.unset(SETTING)
            stage(spark, docs, "")
            if name != "mixing":  # it has no Python
                assert int(spark.conf.get(SETTING)) <= 1024, name
        spark.conf.set(SETTING, "100")
        small_batches(spark)
        assert spark.conf.get(SETTING) == "100"
    finally:
        spark.conf.unset(SETTING)


def test_few_remembered_and_small_slices_change_no_ids(spark):
    rng = random.Random(41)
    rows = [(i, " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(60))) for i in range(300)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    want = {r.doc_id: (r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect()}
    got = {r.doc_id: (r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in bpe.round_trip(docs, path, public_tokenizers.PATTERN, remembered=500, nbytes=2000).collect()}
    assert got == want and {i: d.decode() for i, (_, _, d) in got.items()} == {i: t or "" for i, t in rows}


def test_a_worker_remembers_no_more_than_it_was_told():
    v = bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    import pyarrow as pa

    rng = random.Random(42)
    texts = [" ".join("".join(rng.choices("abcde", k=7)) for _ in range(50)) for _ in range(200)]
    for _ in bpe._mapper(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, [], "both", 300, 4000)([pa.record_batch({"text": texts})]):
        assert len(v.memory.keys) <= 300
    v.memory.most = bpe.REMEMBERED
