"""What a reader sees of labelled blocks: names by precedence, overrides on windows, neighbours of one visible name merged.

Blocks have key columns, ``n`` (their order in a key), start_ms, end_ms, label, name (null: none), by_user, score and
parts (array of label, start_ms, end_ms).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as iv


def as_blocks(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Blocks of labelled spans with a score; nobody has named them yet."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    part = F.array(F.struct(F.col("label"), F.col("start_ms"), F.col("end_ms")))
    return df.select(*keys, n.alias("n"), "start_ms", "end_ms", "label", F.lit(None).cast("string").alias("name"), F.lit(False).alias("by_user"), "score", part.alias("parts"))


def name_clusters(blocks: DataFrame, pins: DataFrame, bindings: DataFrame, keys: list[str]) -> DataFrame:
    """A pin (keys, label, pin) names every block of its label, else a binding (keys, label, bound) does."""
    j = blocks.join(pins, [*keys, "label"], "left").join(bindings, [*keys, "label"], "left")
    given = F.coalesce("pin", "bound")
    return j.withColumn("name", F.coalesce(given, "name")).withColumn("by_user", F.col("by_user") | given.isNotNull()).select(*blocks.columns)


def override_windows(blocks: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Each window (keys, w, r_start, r_end, given; w orders them) names the one block it overlaps most, the first of
    equals; of several on a block the last one stays."""
    pairs = iv.overlap_join(blocks.select(*keys, "n", "start_ms", "end_ms"), windows, keys)
    landed = pairs.groupBy(*keys, "w", "given").agg(F.min(F.struct((-F.col("overlap_ms")).alias("o"), "n")).alias("b"))
    last = landed.groupBy(*keys, F.col("b.n").alias("n")).agg(F.max_by("given", "w").alias("given"))
    j = blocks.join(last, [*keys, "n"], "left")
    return j.withColumn("name", F.coalesce("given", "name")).withColumn("by_user", F.col("by_user") | F.col("given").isNotNull()).select(*blocks.columns)


def merge_visible(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbours with the same visible name and ownership become one block: from the first start to the last end, with
    the label of the longest part (the first of equals), the smallest score and all parts."""
    w = Window.partitionBy(*keys).orderBy("n")
    seen = F.struct(F.coalesce("name", "label").alias("v"), "by_user")
    fresh = (~F.lag(seen).over(w).eqNullSafe(seen)).cast("int")
    runs = blocks.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(w))
    parts = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "parts"))), lambda x: x["parts"]))
    merged = runs.groupBy(*keys, "_run").agg(F.min("n").alias("n"), F.min_by("start_ms", "n").alias("start_ms"), F.max_by("end_ms", "n").alias("end_ms"), F.min_by("name", "n").alias("name"), F.min_by("by_user", "n").alias("by_user"), F.min("score").alias("score"), parts.alias("parts"))
    longest = F.array_max(F.transform("parts", lambda x, i: F.struct((x["end_ms"] - x["start_ms"]).alias("d"), (-i).alias("i"), x["label"].alias("l"))))
    n = F.row_number().over(w)
    return merged.withColumn("label", longest["l"]).withColumn("n", n).select(*blocks.columns)
