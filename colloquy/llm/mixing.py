"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's target is its weight's part of all words, at most ``cap`` times what the source has; the excess goes to
the others by weight. A target is so many whole passes over the source and one partial pass. The documents of a source
are dealt by a hash into blocks, whose places in a pass are a random permutation. A source's quota is a number of
block places: those of the whole passes, then the first places of the partial pass while they fit, and the place at
which the target is reached. Of that last block documents go in hash order while they fit, and the one that best fits
into what is left.

The quotas are dealt to output shards: at each node of a binary tree over the shards, the number of places of every
source that go left is drawn from the multivariate hypergeometric distribution of what the node holds, so quotas are
exact at every level. Each shard takes its quota of a source's places in a row: disjoint draws of permuted blocks. A
document is taken as often as a place of its block lies in some shard's draw. Documents are shuffled inside a shard by
a hash.

The driver sees one row a source and at most ``BLOCKS`` block places a pass, whatever the input; documents stay in Spark.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut

WEIGHTS = (1.0, 2.0, 3.0)
CAP = 3.0
BLOCK_WORDS, BLOCKS = 500_000, 1 << 17
SHARD_WORDS, LEAST_SHARDS, MOST_SHARDS = 16_000_000, 16, 4096
SEED = 20240229
ADDED = ["_size", "_source_size", "_target", "_shards"]


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and 0x09-0x0D (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> list[float]:
    """Each source's target, in the sources' order; weights repeat."""
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    fixed: set[int] = set()
    while True:
        left = sum(sizes) - sum(cap * sizes[k] for k in fixed)
        share = sum(w[k] for k in range(len(sizes)) if k not in fixed)
        out = [cap * s if k in fixed else left * w[k] / share for k, s in enumerate(sizes)]
        over = {k for k in range(len(sizes)) if k not in fixed and out[k] > cap * sizes[k]}
        if not over:
            return out
        fixed |= over


def split(quota: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(sources x shards): copies of each source's blocks by shard, exact in every sum."""
    if shards == 1:
        return quota[:, None]
    left = shards // 2
    total = int(quota.sum())
    take = rng.multivariate_hypergeometric(quota, round(total * left / shards), method="marginals") if total else quota * 0
    return np.concatenate([split(take, left, rng), split(quota - take, shards - left, rng)], axis=1)


def _stride(n: int, rng: np.random.Generator) -> int:
    while math.gcd(step := int(rng.integers(1, max(2, n))), n) != 1:
        pass
    return step


def _by(df: DataFrame, other: DataFrame) -> DataFrame:
    """Left join by source, where null equals null."""
    return df.join(other.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def _shards(words: float) -> tuple[int, int]:
    """Number of shards, and of parts that a shard is written in."""
    shards = min(max(LEAST_SHARDS, math.ceil(words / SHARD_WORDS)), MOST_SHARDS)
    return shards, max(1, math.ceil(words / shards / SHARD_WORDS))


def _drawn(documents: DataFrame, weights: tuple[float, ...], cap: float, seed: int) -> tuple[DataFrame, int, int]:
    """row (all columns of documents), id, size, source_size, target and shards of each document; shards and their parts."""
    spark = documents.sparkSession
    kept = [c for c in documents.columns if c.lower() not in ADDED]
    plain = documents.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("doc_id").alias("id"), "source", word_count(F.col("text")).alias("size"))
    sized = cut(plain.select("id", "source", "size"))
    found = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    found = sorted(found, key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
    totals = [int(r.n) for r in found]
    per_block = max(BLOCK_WORDS, sum(totals) / BLOCKS)
    rng = np.random.default_rng(seed)
    plan = []
    for r, total, target in zip(found, totals, targets(totals, weights, cap), strict=True):
        passes = min(int(target // total), int(cap)) if total else 1
        blocks = max(1, math.ceil(total / per_block))
        plan.append((r.source, total, float(target), passes, max(0.0, target - passes * total), blocks, _stride(blocks, rng), int(rng.integers(0, blocks))))
    sources = cut(spark.createDataFrame(plan, "source string, source_size long, target double, passes int, rest double, blocks long, stride long, shift long").coalesce(1))

    block = F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks"))
    place = F.pmod(block * F.col("stride") + F.col("shift"), F.col("blocks"))
    order = F.xxhash64("id", F.lit(seed + 1))
    partial = _by(sized, sources).where("rest > 0").select("id", "source", "size", "rest", place.alias("place"))
    words = cut(partial.groupBy("source", "place", "rest").agg(F.sum("size").alias("words")))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    upto = words.select("source", "place", "rest", "words", before.alias("before"))
    edge = cut(upto.where("before < rest and before + words > rest").select("source", F.col("place").alias("edge"), (F.col("rest") - F.col("before")).alias("room")))
    whole = upto.where("before + words <= rest").groupBy("source").agg(F.max("place").alias("last")).collect()
    edges = edge.collect()
    inner = _by(partial, edge).where("place = edge").select("id", "source", "size", "room", order.alias("o"))
    ran = inner.withColumn("sum", F.sum("size").over(Window.partitionBy("source").orderBy("o")))
    # Documents in hash order while they fit, then the one that fits best into what is left, if any comes nearer.
    fit = cut(ran.where("sum <= room").groupBy("source").agg(F.max("o").alias("upto"), F.max("sum").alias("full")))
    rest = _by(ran, fit).where("upto is null or o > upto").withColumn("off", F.abs(F.col("room") - F.coalesce("full", F.lit(0)) - F.col("size")))
    extra = rest.where("off < room - coalesce(full, 0)").groupBy("source").agg(F.min(F.struct("off", "o")).alias("best"))
    limits = cut(_by(_by(edge.select("source"), fit), extra).select("source", "upto", F.col("best.o").alias("extra")))
    drop_cut(words)
    drop_cut(sized)

    # Quotas, the tree, and which shard draws each block place.
    last, at_edge = {r.source: r["last"] for r in whole}, {r.source: r.edge for r in edges}
    quota = np.array([p[3] * p[5] + at_edge.get(p[0], last.get(p[0], -1)) + 1 for p in plan], dtype=np.int64)
    shards, parts = _shards(sum(p[2] for p in plan))
    drawn = split(quota, shards, rng)
    rows = []
    for (source, _, _, passes, _, blocks, stride, shift), ends in zip(plan, np.cumsum(drawn, axis=1), strict=True):
        places = (np.arange(blocks) * stride + shift) % blocks
        shard = np.searchsorted(ends, places[:, None] + blocks * np.arange(passes + 1)[None, :], side="right")
        rows += [(source, b, [s for s in some if s < shards], place == at_edge.get(source, -1)) for b, (some, place) in enumerate(zip(shard.tolist(), places.tolist(), strict=True))]
    dealt = cut(spark.createDataFrame(rows, "source string, block long, shards array<int>, on_edge boolean").coalesce(1))

    named = _by(_by(plain, sources.drop("rest", "passes", "stride", "shift")), limits).withColumn("block", block)
    same = named["source"].eqNullSafe(dealt["source"]) & (named["block"] == dealt["block"])
    out = named.join(F.broadcast(dealt.select("source", "block", "shards", "on_edge")), same)  # at most BLOCKS and one a source
    fits = F.coalesce(order <= F.col("upto"), F.lit(False)) | F.coalesce(order == F.col("extra"), F.lit(False))
    # The last place of a quota is the edge's: there only the documents that fit are taken.
    taken = F.when(F.col("on_edge") & ~fits, F.slice("shards", F.lit(1), F.size("shards") - 1)).otherwise(F.col("shards"))
    return out.select("row", "id", "size", "source_size", "target", taken.alias("shards")), shards, parts


def draw(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """All columns of documents with _size, _source_size, _target and _shards (the shard of each copy that the mix takes).

    Sources stand in order of code points, null last, and a null source is a source. A null text has no words; its
    documents follow their block, and a source without words is taken once. Reruns agree: nothing depends on partitions.
    Rows that repeat a doc_id are taken or left together. An empty table stays empty. A column of documents that bears
    one of the four names is replaced; all others pass through, whatever their names.
    """
    out, _, _ = _drawn(documents, weights, cap, seed)
    return out.select("row.*", *(F.col(n[1:]).alias(n) for n in ADDED))


def mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself: documents' columns, a row for each copy, dealt by shard and shuffled inside each shard."""
    out, shards, parts = _drawn(documents, weights, cap, seed)
    copies = out.select("row", "id", F.posexplode("shards").alias("copy", "shard")).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    return copies.repartition(shards * parts, "shard", "part").sortWithinPartitions("shard", F.xxhash64("id", "copy")).select("row.*")
