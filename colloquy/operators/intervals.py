"""Interval algebra over labelled spans: frames with key columns, start_ms, end_ms (half-open) and usually a label.

Overlap joins carry the keys and a time bucket as equi keys: a span goes to every bucket that it touches, and a pair is
reported only in the first bucket that both touch, so no pair comes twice and a long key is many join groups. Where only
the best of a row's pairs counts, or a sum over them, ``sweeps`` finds it without the pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sweeps

BUCKET_MS = 3_600_000


def _bucketed(df: DataFrame, start: str, end: str, bucket_ms: int, name: str) -> DataFrame:
    first = F.floor(F.col(start) / bucket_ms)
    last = F.greatest(first, F.floor((F.col(end) - 1) / bucket_ms))
    return df.withColumn(name, first).withColumn("_bucket", F.explode(F.sequence(first, last)))


def in_buckets(df: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Spans cut to the buckets they lie in (``_bucket``); empty ones are dropped."""
    cut = _bucketed(df.where("end_ms > start_ms"), "start_ms", "end_ms", bucket_ms, "_first").drop("_first")
    return cut.withColumn("start_ms", F.greatest("start_ms", F.col("_bucket") * bucket_ms)).withColumn("end_ms", F.least("end_ms", (F.col("_bucket") + 1) * bucket_ms))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """All pairs of one key whose spans overlap by more than nothing, with overlap_ms.

    The left side has start_ms and end_ms, the right side r_start and r_end; other columns must not clash.
    """
    a, b = _bucketed(left, "start_ms", "end_ms", bucket_ms, "_lb"), _bucketed(right, "r_start", "r_end", bucket_ms, "_rb")
    pairs = a.join(b, [*keys, "_bucket"]).where("start_ms < r_end and r_start < end_ms and _bucket = greatest(_lb, _rb)")
    return pairs.withColumn("overlap_ms", F.least("end_ms", "r_end") - F.greatest("start_ms", "r_start")).drop("_lb", "_rb", "_bucket")


def max_overlap(left: DataFrame, right: DataFrame, keys: list[str], row: list[str], right_order: list) -> DataFrame:
    """For each left row the right row of largest overlap (ties: first in ``right_order``); rows without one are absent.

    Where that order begins with r_start, no pairs are made (``sweeps.best_right``)."""
    if right_order[0] == "r_start":
        a, b = _bucketed(left, "start_ms", "end_ms", BUCKET_MS, "_first").drop("_first"), _bucketed(right, "r_start", "r_end", BUCKET_MS, "_first").drop("_first")
        return sweeps.best_right(a, b, keys, row, right_order, None)
    w = Window.partitionBy(*keys, *row).orderBy(F.desc("overlap_ms"), *right_order)
    return overlap_join(left, right, keys).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], row: list[str], right_order: list, most_ms: int) -> DataFrame:
    """For each left row the right row of smallest gap, at most ``most_ms`` (ties: first in ``right_order``).

    The left spans are widened by the limit for their buckets; overlapping rows have gap 0. Where the order begins with
    r_start, no pairs are made.
    """
    wide = left.withColumn("_s", F.col("start_ms")).withColumn("_e", F.col("end_ms")).withColumn("start_ms", F.col("start_ms") - most_ms - 1).withColumn("end_ms", F.col("end_ms") + most_ms + 1)
    if right_order[0] == "r_start":
        a = _bucketed(wide, "start_ms", "end_ms", BUCKET_MS, "_first").withColumn("start_ms", F.col("_s")).withColumn("end_ms", F.col("_e")).drop("_s", "_e", "_first")
        return sweeps.best_right(a, _bucketed(right, "r_start", "r_end", BUCKET_MS, "_first").drop("_first"), keys, row, right_order, most_ms)
    near = overlap_join(wide, right, keys).withColumn("start_ms", F.col("_s")).withColumn("end_ms", F.col("_e")).drop("_s", "_e", "overlap_ms")
    near = near.withColumn("gap_ms", F.greatest(F.col("start_ms") - F.col("r_end"), F.col("r_start") - F.col("end_ms"), F.lit(0))).where(F.col("gap_ms") <= most_ms)
    w = Window.partitionBy(*keys, *row).orderBy("gap_ms", *right_order)
    return near.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def attribute(left: DataFrame, right: DataFrame, keys: list[str], row: list[str], right_order: list, label: str, most_ms: int = 30_000) -> DataFrame:
    """Left rows with the label of the span they overlap most; without one, the only label of their key if it has just
    one, else that of the nearest span within ``most_ms``; ``how`` says which, and stays null if none applies."""
    hit = max_overlap(left, right, keys, row, right_order).select(*keys, *row, F.col(label).alias("_hit"))
    only = right.groupBy(*keys).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"))
    only = only.select(*keys, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("_only"))
    rest = left.join(hit.select(*keys, *row), [*keys, *row], "left_anti")
    near = nearest_within(rest, right, keys, row, right_order, most_ms).select(*keys, *row, F.col(label).alias("_near"))
    out = left.join(hit, [*keys, *row], "left").join(only, keys, "left").join(near, [*keys, *row], "left")
    how = F.when(F.col("_hit").isNotNull(), "overlap").when(F.col("_only").isNotNull(), "only").when(F.col("_near").isNotNull(), "nearest")
    return out.withColumn("assigned", F.coalesce("_hit", "_only", "_near")).withColumn("how", how).drop("_hit", "_only", "_near")


def overlap_vote(left: DataFrame, right: DataFrame, keys: list[str], row: list[str], label: str) -> DataFrame:
    """For each left row the label of largest summed overlap (ties: smallest label)."""
    sums = overlap_join(left, right, keys).groupBy(*keys, *row, label).agg(F.sum("overlap_ms").alias("overlap_ms"))
    best = F.min(F.struct((-F.col("overlap_ms")).alias("o"), F.col(label).alias("l"))).alias("b")
    return sums.groupBy(*keys, *row).agg(best).select(*keys, *row, F.col("b.l").alias(label), (-F.col("b.o")).alias("overlap_ms"))


def without_overlap(left: DataFrame, right: DataFrame, keys: list[str], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Left rows that no right span (r_start, r_end) of their key overlaps: an anti join on key and bucket.

    A left row is tried once for each bucket it touches, and rows equal to a hit one, nulls included, are taken out.
    """
    a, b = _bucketed(left, "start_ms", "end_ms", bucket_ms, "_first").drop("_first"), _bucketed(right.select(*keys, "r_start", "r_end"), "r_start", "r_end", bucket_ms, "_first").drop("_first")
    hit = sweeps.best_right(a, b, keys, [c for c in left.columns if c not in keys], ["r_start", "r_end"], None).select(*[F.col(c).alias(f"_hit_{c}") for c in left.columns])
    return left.join(hit, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_hit_{c}")) for c in left.columns]), "left_anti")


def merge_gaps(df: DataFrame, keys: list[str], gap_ms: int | Column, order: list[str], end: str = "last", lowest: tuple[str, ...] = ()) -> DataFrame:
    """Spans merged while the next starts less than ``gap_ms`` after the previous one's end (strictly).

    ``end``: "last" gives the end of the last span, "max" the largest end, and compares with it. Of the columns in
    ``lowest`` (a confidence) a merged span has the smallest value.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    reach = F.lag("end_ms").over(w) if end == "last" else F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start_ms") - reach >= gap_ms), 1).otherwise(0)
    islands = df.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max_by("end_ms", F.struct(*order)) if end == "last" else F.max("end_ms")
    return islands.groupBy(*keys, "_island").agg(F.min("start_ms").alias("start_ms"), last.alias("end_ms"), F.count("*").alias("n_merged"), *(F.min(c).alias(c) for c in lowest)).drop("_island")


def bridge_same_label(df: DataFrame, keys: list[str], window_ms: int, order: list[str]) -> DataFrame:
    """Consecutive spans of one label merged where the gap is at most ``window_ms`` (0: nothing merges across a gap
    unless they overlap); another label between them breaks the run. The larger end stays."""
    w = Window.partitionBy(*keys).orderBy(*order)
    run = df.withColumn("_turn", F.when(F.lag("label").over(w).eqNullSafe(F.col("label")), 0).otherwise(1)).withColumn("_run", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(*keys, "_run").orderBy(*order)
    reach = F.max("end_ms").over(inner.rowsBetween(Window.unboundedPreceding, -1))
    run = run.withColumn("_new", F.when(reach.isNull() | (F.col("start_ms") - reach > window_ms), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*keys, "label", "_run", "_island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_merged")).drop("_run", "_island")


def label_runs(df: DataFrame, keys: list[str], order: list[str], hole: Column | None = None) -> DataFrame:
    """Runs of equal consecutive labels: first start, last end, number of rows; ``hole`` also breaks a run."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fresh = ~F.lag("label").over(w).eqNullSafe(F.col("label")) | F.row_number().over(w).eqNullSafe(F.lit(1))
    if hole is not None:
        fresh = fresh | hole
    runs = df.withColumn("_new", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "label", "_run").agg(F.min("start_ms").alias("start_ms"), F.max_by("end_ms", F.struct(*order)).alias("end_ms"), F.count("*").alias("n_rows")).withColumnRenamed("_run", "run")


def elementary(df: DataFrame, keys: list[str]) -> DataFrame:
    """The pieces between all neighbouring boundaries of a key: p_start, p_end."""
    edges = df.select(*keys, F.explode(F.array("start_ms", "end_ms")).alias("p_start")).distinct()
    nxt = F.lead("p_start").over(Window.partitionBy(*keys).orderBy("p_start"))
    return edges.withColumn("p_end", nxt).where("p_end is not null")


def last_writer_timeline(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """The timeline in which a later index overwrites: adjacent pieces of one label are joined. Empty spans count nothing."""
    top = sweeps.top_labels(in_buckets(df), keys, index)
    hole = F.lag("end_ms").over(Window.partitionBy(*keys).orderBy("start_ms")) != F.col("start_ms")
    return label_runs(top, keys, ["start_ms"], hole).drop("run", "n_rows")


def union_spans(df: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal covered spans (touching spans join)."""
    return merge_gaps(df.where("end_ms > start_ms"), keys, 1, ["start_ms", "end_ms"], "max").drop("n_merged")


def crop(df: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """The parts of spans inside the regions (keys, start_ms, end_ms) of their key, one row for each region met."""
    r = union_spans(regions, keys).select(*keys, F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    inside = overlap_join(df, r, keys).withColumn("start_ms", F.greatest("start_ms", "r_start")).withColumn("end_ms", F.least("end_ms", "r_end"))
    return inside.select(*df.columns)


def subtract(left: DataFrame, cutters: DataFrame, keys: list[str], row: list[str]) -> DataFrame:
    """What is left of each left span once the cutters (r_start, r_end) of its key are taken out; no empty pieces."""
    cuts = union_spans(cutters.select(*keys, F.col("r_start").alias("start_ms"), F.col("r_end").alias("end_ms")), keys)
    cuts = cuts.select(*keys, F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    hit = overlap_join(left.select(*keys, *row, "start_ms", "end_ms"), cuts, keys).groupBy(*keys, *row).agg(F.array_sort(F.collect_list(F.struct("r_start", "r_end"))).alias("c"))
    full = left.join(hit, [*keys, *row], "left").withColumn("c", F.coalesce("c", F.array().cast("array<struct<r_start:bigint,r_end:bigint>>")))
    starts = F.concat(F.array("start_ms"), F.transform("c", lambda x: x["r_end"]))
    ends = F.concat(F.transform("c", lambda x: x["r_start"]), F.array("end_ms"))
    piece = F.inline(F.arrays_zip(starts.alias("p_start"), ends.alias("p_end")))
    return full.select(*keys, *row, piece).toDF(*keys, *row, "p_start", "p_end").where("p_end > p_start")


def dense_windows(df: DataFrame, width_ms: int, hop_ms: int) -> DataFrame:
    """Windows of a fixed width over each span, the last one clipped; shorter spans are one window."""
    n = F.when(F.col("end_ms") - F.col("start_ms") > width_ms, F.ceil((F.col("end_ms") - F.col("start_ms") - width_ms) / hop_ms)).otherwise(0)
    k = F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long"))).alias("w_index")
    w_start = F.col("start_ms") + F.col("w_index") * hop_ms
    return df.select("*", k).withColumn("w_start", w_start).withColumn("w_end", F.least(w_start + width_ms, F.col("end_ms")))


def as_of(points: DataFrame, anchors: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Each point with the value of the latest anchor at or before it (an anchor at the same time counts)."""
    a = anchors.select(*keys, F.col(time), F.col(value).alias("_v"), F.lit(0).alias("_side"), *[F.lit(None).cast(t).alias(c) for c, t in points.dtypes if c not in (*keys, time)])
    p = points.withColumn("_v", F.lit(None).cast(dict(anchors.dtypes)[value])).withColumn("_side", F.lit(1))
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(p).withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_v", "_side")
