"""Vector operators over voiceprints, in double precision with built-in higher-order functions.

Group sums of vectors are element-wise sums by position with partial aggregation, so a group of any size is fine.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length; 0 where a norm is zero."""
    n = F.least(F.size(a), F.size(b))
    p, q = F.slice(a, 1, n), F.slice(b, 1, n)
    norm = F.sqrt(dot(p, p)) * F.sqrt(dot(q, q))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def normalize(v: Column) -> Column:
    """The unit vector; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def vector_sums(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Element-wise sums and the number of rows of each key: n, total (array of double)."""
    parts = df.select(*keys, F.posexplode(vector).alias("_pos", "_x"))
    sums = parts.groupBy(*keys, "_pos").agg(F.sum(F.col("_x").cast("double")).alias("_s"), F.count("*").alias("n"))
    total = F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_s"))), lambda x: x["_s"])
    return sums.groupBy(*keys).agg(F.max("n").alias("n"), total.alias("total"))


def centroids(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean vector of each key, scaled to length one."""
    s = vector_sums(df, keys, vector)
    return s.select(*keys, "n", normalize(F.transform("total", lambda x: x / F.col("n"))).alias("centroid"))


def leave_one_out(df: DataFrame, keys: list[str], vector: str, least: int = 3) -> DataFrame:
    """Each row's cosine with the sum of the other normalized rows of its key; null where the key has fewer than ``least``."""
    unit = df.withColumn("_u", normalize(F.col(vector)))
    s = vector_sums(unit, keys, "_u")
    rest = F.zip_with("total", "_u", lambda t, u: t - u)
    return unit.join(s, keys).withColumn("own", F.when(F.col("n") >= least, cosine(F.col("_u"), rest))).drop("_u", "total", "n")


def _cosines(q: list, c: list) -> np.ndarray:
    """Cosines of two lists of vectors, each pair over its shorter length; 0 where a norm is zero."""
    lengths = sorted({len(v) for v in (*q, *c)})
    out = np.zeros((len(q), len(c)))
    at = {n: ([i for i, v in enumerate(q) if len(v) == n], [j for j, v in enumerate(c) if len(v) == n]) for n in lengths}
    for m in lengths:
        for n in lengths:
            i, j, k = at[m][0], at[n][1], min(m, n)
            if i and j and k:
                a, b = (np.stack([x[y][:k] for y in at_]).astype(float) for x, at_ in ((q, i), (c, j)))
                norm = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
                out[np.ix_(i, j)] = np.divide(a @ b.T, norm, out=np.zeros_like(norm), where=norm > 0)
    return out


def best_pairs(queries: DataFrame, candidates: DataFrame, block: int = BLOCK) -> DataFrame:
    """q_id, c_id, score: for each query (q_id, q_own, q_channel, q_vec) the candidate of largest cosine, ties to the smallest c_id.

    A candidate (c_id, c_key, c_channel, c_channels, c_vec) is out of question where its c_key is the query's q_own, or
    where its channel is another than the query's although c_channels has that. Both sides are dealt by hash into
    blocks of about ``block`` rows, by their counts; each pair of blocks is one matrix product, and one row a query
    leaves it.
    """
    parts = [max(1, math.ceil(side.count() / block)) for side in (queries, candidates)]
    some = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("qb", some("q_id", parts[0])).withColumn("cb", every(parts[1]))
    c = candidates.withColumn("cb", some("c_vec", parts[1])).withColumn("qb", every(parts[0]))
    types = dict(queries.dtypes) | dict(candidates.dtypes)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q_id": left["q_id"][:0], "c_id": right["c_id"][:0], "score": np.zeros(0)})
        right = right.sort_values("c_id", kind="stable")
        score = _cosines(list(left["q_vec"]), list(right["c_vec"]))
        score[left["q_own"].to_numpy()[:, None] == right["c_key"].to_numpy()[None, :]] = -np.inf
        for channel in left["q_channel"].unique():
            other = np.array([x != channel and channel in known for x, known in zip(right["c_channel"], right["c_channels"], strict=True)])
            score[np.ix_((left["q_channel"] == channel).to_numpy(), other)] = -np.inf
        best = score.argmax(axis=1)
        out = pd.DataFrame({"q_id": left["q_id"].to_numpy(), "c_id": right["c_id"].to_numpy()[best], "score": score.max(axis=1)})
        return out[np.isfinite(out["score"])]

    found = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(run, f"q_id {types['q_id']}, c_id {types['c_id']}, score double")
    best = found.groupBy("q_id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("c_id").alias("i"))).alias("b"))
    return best.select("q_id", F.col("b.i").alias("c_id"), (-F.col("b.s")).alias("score"))


def suspects(df: DataFrame, owner: str, row: str, vector: str, floor: float = 0.5, least: int = 3) -> DataFrame:
    """Rows whose own leave-one-out cosine is below ``floor`` or below that with the nearest other owner's sum."""
    scored = leave_one_out(df, [owner], vector, least).where("own is not null")
    sums = vector_sums(df.withColumn("_u", normalize(F.col(vector))), [owner], "_u").where(F.col("n") >= least)
    one = F.lit("")
    q = scored.select(F.col(row).alias("q_id"), F.col(owner).alias("q_own"), one.alias("q_channel"), F.col(vector).alias("q_vec"))
    c = sums.select(F.col(owner).alias("c_id"), F.col(owner).alias("c_key"), one.alias("c_channel"), F.array(one).alias("c_channels"), F.col("total").alias("c_vec"))
    best = best_pairs(q, c).select(F.col("q_id").alias(row), F.col("score").alias("nearest_other"))
    joined = scored.join(best, row, "left")
    return joined.withColumn("suspect", (F.col("own") < floor) | (F.coalesce("nearest_other", F.lit(-1.0)) > F.col("own")))


def best_match(queries: DataFrame, prototypes: DataFrame, threshold: float) -> DataFrame:
    """For each query (q_id, q_channel, q_vec) the best speaker among prototypes (speaker_id, channel, embedding).

    A speaker's pool is its prototypes of the query's channel if it has any, else all; its score is the largest cosine;
    ties go to the smallest speaker; the best is accepted only above ``threshold`` (strictly). Where
    prototypes have an id, one is no match for the query of the same id.
    """
    channels = prototypes.groupBy("speaker_id").agg(F.collect_set("channel").alias("c_channels"))
    key = F.col("id") if "id" in prototypes.columns else F.lit(None).cast("long")
    c = prototypes.join(channels, "speaker_id").select(F.col("speaker_id").alias("c_id"), key.alias("c_key"), F.col("channel").alias("c_channel"), "c_channels", F.col("embedding").alias("c_vec"))
    q = queries.select("q_id", F.col("q_id").alias("q_own"), "q_channel", "q_vec")
    return best_pairs(q, c).select("q_id", F.col("c_id").alias("speaker_id"), "score").where(F.col("score") > threshold)


def coherent_pick(df: DataFrame, owner: str, row: str, vector: str, duration: str, pool: int = 16, k: int = 8, floor: float = 0.5) -> DataFrame:
    """The longest ``pool`` rows of each owner, of those the coherent ones, of these the first ``k``; with fewer than three
    rows in the pool all count as coherent."""
    w = Window.partitionBy(owner).orderBy(F.desc(duration), row)
    pooled = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= pool)
    kept = leave_one_out(pooled, [owner], vector).where("own is null or own >= " + repr(floor))
    return kept.withColumn("pick", F.row_number().over(Window.partitionBy(owner).orderBy("_rn")).cast("long")).where(F.col("pick") <= k).drop("_rn")
