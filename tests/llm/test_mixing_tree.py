"""The mix against plain reckoning: water-filled targets, exact tree quotas, disjoint draws, and what depends on the tree."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from colloquy.llm import mixing


def plain_targets(sizes: dict) -> dict:
    """Each source's target by bisection on the level of a common multiplier."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1.0 + k % 3 for k, s in enumerate(names)}
    low, high = 0.0, 1e12
    for _ in range(300):
        middle = (low + high) / 2
        if sum(min(3 * sizes[s], middle * weight[s]) for s in names) < sum(sizes.values()):
            low = middle
        else:
            high = middle
    return {s: min(3 * sizes[s], high * weight[s]) for s in names}


def _documents(spark, n=1500):
    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 60))) if i % 40 else None, rng.choice(["a", "a", "a", "b", "ü", "c", None])) for i in range(n)]
    rows += [(n, "", "empty"), (n + 1, None, "empty"), (0, rows[0][1], rows[0][2])]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_quotas_and_draws(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 500)
    seen = {}
    split = mixing.split

    def watched(quota, shards, rng):
        out = split(quota, shards, rng)
        seen["table"] = out
        return out

    monkeypatch.setattr(mixing, "split", watched)
    got = mixing.draw(_documents(spark)).toPandas()
    sizes = {s: int(g["_size"].sum()) for s, g in got.groupby(got.source.fillna("~null"))}
    want = plain_targets({None if s == "~null" else s: n for s, n in sizes.items()})
    for s, g in got.groupby(got.source.fillna("~null")):
        target = want[None if s == "~null" else s]
        assert abs(g["_target"].iloc[0] - target) < 1e-6 * max(1, target) and (g["_source_size"] == sizes[s]).all()
        taken = (g["_size"] * g["_shards"].map(len)).sum()
        assert abs(taken - target) <= 60 and g["_shards"].map(len).max() <= 3
    assert (got[got.source == "empty"]["_shards"].map(len) == 1).all()
    # Every copy's shard is one of the tree's, and shards are about equally full.
    full = Counter(s for x in got["_shards"] for s in x)
    assert set(full) <= set(range(mixing.LEAST_SHARDS)) and len(full) == mixing.LEAST_SHARDS
    assert np.ptp(seen["table"].sum(0)) <= 5


def test_what_is_taken_comes_out_of_the_shards_quotas(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 500)
    split = mixing.split
    docs = _documents(spark)
    whole = mixing.draw(docs).agg(F.sum(F.size("_shards"))).first()[0]

    def without_one(quota, shards, rng):
        out = split(quota, shards, rng)
        if shards == mixing.LEAST_SHARDS:
            out[:, -1] = 0  # the last shard draws nothing
        return out

    monkeypatch.setattr(mixing, "split", without_one)
    fewer = mixing.draw(docs).toPandas()
    assert (fewer["_shards"].map(len)).sum() < whole and mixing.LEAST_SHARDS - 1 not in {s for x in fewer["_shards"] for s in x}


def test_shards_and_parts_grow_with_the_mix():
    assert mixing._shards(0) == (16, 1) and mixing._shards(1e9) == (63, 1)
    shards, parts = mixing._shards(1.6e13)
    assert shards == 4096 and shards * parts * mixing.SHARD_WORDS >= 1.6e13


def test_the_mix_has_a_row_for_each_copy(spark):
    docs = _documents(spark, 300).withColumn("_s", F.lit(1)).withColumn("_size", F.lit("own"))
    drawn = mixing.draw(docs)
    copies = Counter()
    for r in drawn.collect():
        copies[r.doc_id] += len(r._shards)
    mixed = mixing.mix(docs)
    assert mixed.columns == ["doc_id", "text", "source", "_s"] and Counter(r.doc_id for r in mixed.collect()) == +copies
