"""Connected components of a link table: union-find inside partitions, then smallest-label propagation across them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, shuffled


def union_find(pairs) -> dict[int, int]:
    """The smallest reachable id of every id in ``pairs``."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def _forest(batches):
    """Replace the links of each batch by a star on the smallest id of each local component."""
    for pdf in batches:
        found = union_find(zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True))
        rows = [(x, r) for x, r in found.items() if x != r]
        yield pd.DataFrame(rows, columns=["a", "b"], dtype="int64")


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a long, b long) to (id long, component long): the smallest id reachable, for every linked id.

    Each round joins every node to the smallest label among its neighbours and then to that label's own label
    (pointer jumping), so that chains shorten by more than half and stars end at once. All of a hub's rows meet only
    in pre-aggregated minima and in joins that Spark can split. Null ends are ignored; an empty input has no rows.
    """
    links = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    star = cut(links.mapInPandas(_forest, "a long, b long").distinct())
    both = star.select("a", "b").union(star.select(F.col("b"), F.col("a")))
    both = cut(both)
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(shuffled(labels.select(F.col("id").alias("b"), "component")), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(shuffled(near), "id").select("id", "component", F.least("component", "near").alias("next"))
        hop = labels.select(F.col("id").alias("next"), F.col("component").alias("jump"))
        after = cut(step.join(shuffled(hop), "next", "left").select("id", F.least("next", F.coalesce("jump", "next")).alias("new"), F.col("component").alias("old")))
        moved = after.where("new <> old").limit(1).count()
        drop_cut(labels)
        labels = after.select("id", F.col("new").alias("component"))
        if not moved:
            return labels
