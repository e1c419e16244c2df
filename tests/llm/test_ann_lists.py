"""Neighbours come out of the probed lists alone."""

from __future__ import annotations

import numpy as np
import pytest

from colloquy.llm import ann


@pytest.mark.parametrize("sigma", [0.2, 1.0])
def test_recall_above_the_sample_with_skewed_norms(spark, sigma):
    rng = np.random.default_rng(31)
    n = 60_000
    x = (rng.standard_normal((n, 16)) * rng.lognormal(0, sigma, (n, 1))).astype(np.float32).astype(float)
    asked = np.arange(0, n, 600)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 600 = 0")).toPandas()
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    hits = 0
    for q, s in zip(asked, score, strict=True):
        part = got[got.query_id == q]
        assert len(part) == 20
        hits += len(set(np.lexsort((np.arange(n), -s))[:20]) & set(part.vec_id))
    print(f"sigma {sigma}: recall {hits / 20 / len(asked):.4f}")
    assert hits / 20 / len(asked) > 0.95


def _recall(x, got, asked):
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    hits = 0
    for q, s in zip(asked, score, strict=True):
        part = got[got.query_id == q]
        assert len(part) == 20 and q not in set(part.vec_id)
        hits += len(set(np.lexsort((np.arange(len(x)), -s))[:20]) & set(part.vec_id))
    return hits / 20 / len(asked)


@pytest.mark.parametrize("spread", [0.1, 3.0])
def test_a_small_sample_supplies_no_rows(spark, monkeypatch, spread):
    """With 300 sampled rows of 8000 nearly all neighbours lie outside the sample; units and lists are many."""
    monkeypatch.setattr(ann, "SAMPLE", 300)
    monkeypatch.setattr(ann, "BLOCK", 500)
    monkeypatch.setattr(ann, "QUERIES", 40)
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((40, 24))[rng.integers(0, 40, 8000)] * 4 + rng.standard_normal((8000, 24)) * spread).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 80 = 0")).toPandas()
    assert _recall(x, got, np.arange(0, 8000, 80)) > 0.95
    exact = ann.nearest(df, df.where("vec_id % 800 = 0"), epsilon=None).toPandas()
    assert _recall(x, exact, np.arange(0, 8000, 800)) == 1.0


def test_no_query_comes_back_short_and_copies_count_once(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, epsilon=-3.0).toPandas()  # tests that reject nearly everything
    assert (got.groupby("query_id").size() == 20).all() and got.groupby("query_id").vec_id.nunique().eq(20).all() and got.query_id.nunique() == 20


def test_units_hold_every_list():
    units = ann._units({0: 10, 1: ann.BLOCK - 5, 2: 3 * ann.BLOCK + 1, 4: 1, 5: 2})
    assert units == {0: [0], 1: [1], 2: [2, 3, 4, 5], 4: [6], 5: [6]}
