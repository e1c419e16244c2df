"""Clusters of whole meetings against plain average linkage."""

from __future__ import annotations

import numpy as np
import pytest

from colloquy.operators import sequences
from colloquy.plans import registry


def plain(x, threshold, most=128):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    pair, groups = unit @ unit.T, [[i] for i in range(len(x))]
    sim = pair.copy()
    np.fill_diagonal(sim, -np.inf)
    while len(groups) > 1:
        i, j = sorted(divmod(int(sim.argmax()), len(groups)))
        if sim[i, j] < threshold and len(groups) <= most:
            break
        groups[i] = groups[i] + groups.pop(j)
        sim = np.delete(np.delete(sim, j, 0), j, 1)
        for k in range(len(groups)):
            sim[i, k] = sim[k, i] = pair[np.ix_(groups[i], groups[k])].mean() if k != i else -np.inf
    label = np.zeros(len(x), int)
    for k, g in enumerate(sorted(groups, key=min)):
        label[g] = k
    return label.tolist()


@pytest.mark.parametrize(("threshold", "most"), [(0.25, 128), (0.9, 128), (2.0, 20), (-2.0, 5)])
def test_chains_equal_plain_linkage(threshold, most):
    x = np.random.default_rng(5).standard_normal((200, 6))
    x[50:60] = x[50]
    assert sequences.agglomerate(x, threshold, most).tolist() == plain(x, threshold, most)


def test_whole_meetings_are_clustered(spark, tmp_path):
    x = np.random.default_rng(6).standard_normal((800, 8))
    spark.createDataFrame([(i, i % 7, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = registry.QUERIES["cluster_vectors"](spark, str(tmp_path)).toPandas()
    assert len(got) == 800
    for (m, _), part in got.groupby(["meeting_id", "channel"]):
        part = part.sort_values("id")
        assert part.id.tolist() == list(range(m, 800, 20)) and part.cluster.tolist() == plain(x[part.id], 0.25)
