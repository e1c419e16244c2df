"""Evaluation metrics over reference and hypothesis spans. Missing samples give null, never zero."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as iv
from . import sweeps

#: Spans are cut to buckets of this length where only sums over time count.
WIDE_MS = 21_600_000


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean by weight over rows that have a value; null without any."""
    return F.sum(value * weight) / F.nullif(F.sum(F.when(value.isNotNull(), weight)), F.lit(0))


def assign(weights: np.ndarray) -> list[tuple[int, int]]:
    """Rows and columns of a one-to-one assignment of largest total weight (Hungarian, by potentials)."""
    flip = weights.shape[0] > weights.shape[1]
    a = -(weights.T if flip else weights).astype(float)
    n, m = a.shape
    u, v, p, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            free = np.nonzero(~used)[0]
            cur = a[p[j0] - 1, free - 1] - u[p[j0]] - v[free]
            better = cur < low[free]
            low[free[better]], way[free[better]] = cur[better], j0
            j1 = free[low[free].argmin()]
            delta = low[j1]
            u[p[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0], j0 = p[way[j0]], way[j0]
    pairs = [(int(p[j]) - 1, j - 1) for j in range(1, m + 1) if p[j]]
    return [(j, i) if flip else (i, j) for i, j in pairs]


def _sides(ref: DataFrame, hyp: DataFrame, keys: list[str]) -> DataFrame:
    """The spans of both sides (0: reference, 1: hypothesis) in one frame, cut to buckets."""
    side = lambda df, n: df.select(*keys, "label", "start_ms", "end_ms", F.lit(n).alias("side"))
    return iv.in_buckets(side(ref, 0).unionByName(side(hyp, 1)).dropna(subset=keys), WIDE_MS)


def label_mapping(ref: DataFrame, hyp: DataFrame, keys: list[str]) -> DataFrame:
    """keys, h_label, r_label: the one-to-one mapping of labels with the largest shared time in each key.

    Shared times are counted by buckets of time (``sweeps.shared_time``) and summed; a key's table of labels (labels x
    labels) goes to one small task.
    """
    shared = sweeps.shared_time(_sides(ref, hyp, keys), keys).groupBy(*keys, "label", "h_label").agg(F.sum("w").alias("w"))
    types = dict(ref.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", h_label string, r_label string"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = sorted(pdf["label"].unique()), sorted(pdf["h_label"].unique())
        w = pdf.pivot_table(index="label", columns="h_label", values="w", aggfunc="sum", fill_value=0).reindex(index=rows, columns=cols, fill_value=0).to_numpy()
        found = [(cols[j], rows[i]) for i, j in assign(w) if w[i, j] > 0]
        out = pd.DataFrame(found, columns=["h_label", "r_label"])
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return shared.groupBy(*keys).applyInPandas(one, schema)


def error_components(ref: DataFrame, hyp: DataFrame, keys: list[str], mapping: DataFrame | None = None) -> DataFrame:
    """total, miss, false_alarm and confusion (ms) of each key, by elementary pieces of its buckets of time, overlaps counted,
    no collar.

    ``mapping`` (keys, h_label, r_label) renames hypothesis labels; unmapped ones match nothing.
    """
    h = hyp.select(*keys, "label", "start_ms", "end_ms")
    if mapping is not None:
        h = h.join(mapping.withColumnRenamed("h_label", "label"), [*keys, "label"], "left").withColumn("label", F.coalesce("r_label", F.concat(F.lit("hyp "), "label"))).drop("r_label")
    sums = sweeps.error_sums(_sides(ref, h, keys), keys)
    return sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("total", "miss", "false_alarm", "confusion")])


def _named(spans: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Spans with their label's reference name; a label without one keeps its own, apart from all reference names."""
    j = spans.join(mapping.withColumnRenamed("h_label", "label"), [*keys, "label"], "left")
    return j.withColumn("label", F.when(F.col("r_label").isNotNull(), F.struct(F.lit(0).alias("raw"), F.col("r_label").alias("name"))).otherwise(F.struct(F.lit(1).alias("raw"), F.col("label").alias("name")))).drop("r_label")


def live_final_agreement(live: DataFrame, final: DataFrame, ref: DataFrame, keys: list[str]) -> DataFrame:
    """flip_ms, judged_ms, uncovered_ms and the ratios flip and uncovered of each key.

    Each side's labels go to reference names by their own optimal mapping, so that new numbers at the end are no flips.
    Time of the final spans is judged where live spans cover it, and uncovered elsewhere. Spans of a side do not overlap.
    """
    sides = [_named(s, label_mapping(ref, s, keys), keys) for s in (live, final)]
    shown = sides[0].select(*keys, F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), F.col("label").alias("shown"))
    shared = iv.overlap_join(sides[1].select(*keys, "label", "start_ms", "end_ms"), shown, keys)
    judged = shared.groupBy(*keys).agg(F.sum("overlap_ms").alias("judged_ms"), F.coalesce(F.sum(F.when(F.col("shown") != F.col("label"), F.col("overlap_ms"))), F.lit(0)).alias("flip_ms"))
    total = final.groupBy(*keys).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"))
    out = total.join(judged, keys, "left").select(*keys, F.coalesce("flip_ms", F.lit(0)).alias("flip_ms"), F.coalesce("judged_ms", F.lit(0)).alias("judged_ms"), (F.col("total_ms") - F.coalesce("judged_ms", F.lit(0))).alias("uncovered_ms"))
    ratio = lambda a, b: F.col(a) / F.nullif(b, F.lit(0))
    return out.withColumn("flip", ratio("flip_ms", F.col("judged_ms"))).withColumn("uncovered", ratio("uncovered_ms", F.col("judged_ms") + F.col("uncovered_ms")))


def emission_lag(ref: DataFrame, emissions: DataFrame, keys: list[str], turn: str) -> DataFrame:
    """For each reference turn the first emission (smallest idx) that covers its start, and max(0, its end - the start)."""
    points = ref.select(*keys, turn, F.col("start_ms"), (F.col("start_ms") + 1).alias("end_ms"))
    e = emissions.select(*keys, "idx", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    first = iv.overlap_join(points, e, keys).groupBy(*keys, turn).agg(F.min_by("r_end", "idx").alias("e_end"))
    joined = ref.select(*keys, turn, "start_ms").join(first, [*keys, turn], "left")
    return joined.withColumn("lag_ms", F.when(F.col("e_end").isNotNull(), F.greatest(F.lit(0), F.col("e_end") - F.col("start_ms")))).drop("e_end")


def flip_rate(emissions: DataFrame, keys: list[str]) -> DataFrame:
    """Share of overlapping consecutive stable emissions whose labels differ; null where none overlap."""
    w = Window.partitionBy(*keys).orderBy("idx")
    e = emissions.where("stable").withColumn("n_label", F.lead("label").over(w)).withColumn("n_start", F.lead("start_ms").over(w)).withColumn("n_end", F.lead("end_ms").over(w))
    e = e.where("n_label is not null and start_ms < n_end and n_start < end_ms")
    return e.groupBy(*keys).agg(F.count("*").alias("n_pairs"), F.count_if(F.col("label") != F.col("n_label")).alias("n_flips")).withColumn("flip_rate", F.col("n_flips") / F.col("n_pairs"))


def gate_failures(metrics: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of metrics (keys, metric, value) that exceed their bound or have no sample; bounds (metric, bound)."""
    return metrics.join(bounds, "metric").where("value is null or value > bound").withColumn("reason", F.when(F.col("value").isNull(), "no sample").otherwise("above bound")).select(*keys, "metric", "value", "bound", "reason")


def with_baseline(rows: DataFrame, baseline: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with the baseline's value and the difference; n/a where either is missing."""
    j = rows.join(baseline.select(*keys, F.col(value).alias("base")), keys, "left")
    return j.withColumn("delta", F.when(F.col(value).isNull() | F.col("base").isNull(), F.lit("n/a")).otherwise(F.format_string("%+.2f", F.col(value) - F.col("base"))))
