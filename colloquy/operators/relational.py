"""Relational reads over the meeting store: names, tags, pages, statistics, de-duplication, bounded top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def display_name(override: Column, user_bound: Column, auto: Column, cluster: Column, legacy: Column) -> tuple[Column, Column]:
    """The shown name and where it comes from: an override, else (unless the cluster is bound by a user) the row's own
    match, else the cluster's name, else the legacy label."""
    row_match = F.when(~F.coalesce(user_bound, F.lit(False)), auto)
    name = F.coalesce(override, row_match, cluster, legacy)
    source = F.when(override.isNotNull(), "override").when(row_match.isNotNull(), "row").when(cluster.isNotNull() & F.coalesce(user_bound, F.lit(False)), "user").when(cluster.isNotNull(), "cluster").when(legacy.isNotNull(), "legacy")
    return name, source


def display_score(overridden: Column, user_bound: Column, row_matched: Column, row_score: Column, cluster_score: Column) -> Column:
    """The score of the level that gives the shown name: the row's own where its match shows, else the cluster's."""
    own = ~overridden & ~F.coalesce(user_bound, F.lit(False)) & row_matched
    return F.when(own, row_score).otherwise(cluster_score)


def page(df: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    """One page with the total and whether more follows; the total rides along as a one-row join."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset(offset).limit(size)
    return rows.crossJoin(F.broadcast(total)).withColumn("has_more", F.lit(offset + size) < F.col("total"))


def usage(left: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` with the number of links, zero included; links are counted before the join."""
    n = links.groupBy(key).agg(F.count("*").alias("n_links"))
    return left.join(n, key, "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))


def sorted_list(df: DataFrame, key: str, order: str, value: str, alias: str) -> DataFrame:
    """The values of a key as one string, in the order of another column."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(key).agg(F.array_join(F.transform(items, lambda x: x["v"].cast("string")), ",").alias(alias))


def dedupe_with_donor(df: DataFrame, keys: list[str], order: list, payload: str) -> DataFrame:
    """The first row of each key group; where its payload is null, that of the first later row which has one.

    Null keys group together.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    first = df.withColumn("_rn", F.row_number().over(w))
    donor = F.first(payload, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return first.withColumn(payload, F.coalesce(payload, donor)).where("_rn = 1").drop("_rn")


def keep_best(df: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """At most so many rows of each key, in the given order; Spark prunes groups before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= most).drop("_rn")


def weighted_vote(df: DataFrame, key: str, label: str, weight: Column) -> DataFrame:
    """The label of largest weight; on a tie null with the reason."""
    sums = df.groupBy(key, label).agg(F.sum(weight).alias("w"))
    best = sums.groupBy(key).agg(F.max("w").alias("w_max"), F.max(F.struct("w", F.col(label).alias("l"))).alias("top"), F.min(F.struct(-F.col("w"), F.col(label).alias("l"))).alias("low"))
    tied = F.col("top.l") != F.col("low.l")
    return best.select(key, F.when(~tied, F.col("top.l")).alias("winner"), F.col("w_max").alias("weight"), F.when(tied, "tie").otherwise("majority").alias("reason"))


def first_seen(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key, the first in order."""
    return keep_best(df, keys, order, 1)


def match_or_name(meetings: DataFrame, hits: DataFrame, tag_names: DataFrame, term: str) -> DataFrame:
    """Meetings found by a transcript hit, their title or one of their tags (tag_names: meeting_id, names array)."""
    found = meetings.join(hits.select("meeting_id").distinct().withColumn("hit", F.lit(True)), "meeting_id", "left").join(tag_names, "meeting_id", "left")
    by_tag = F.coalesce(F.exists("names", lambda x: F.contains(F.lower(x), F.lit(term))), F.lit(False))
    return found.where(F.coalesce("hit", F.lit(False)) | F.contains(F.lower("title"), F.lit(term)) | by_tag)


def optional_filters(df: DataFrame, channel: str | None = None, window: tuple[int, int] | None = None) -> DataFrame:
    """Rows of a channel and of a time window, where these are asked for; rows without times lie in no window."""
    if channel is not None:
        df = df.where(F.col("channel") == channel)
    if window is not None:
        df = df.where((F.col("start_ms") < window[1]) & (F.col("end_ms") > window[0]))
    return df


def in_order(ids: DataFrame, keys: list[str], array: str, table: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` for each id of an array, in the array's order (column pos); unknown ids are dropped."""
    return ids.select(*keys, F.posexplode(array).alias("pos", key)).join(table, key)
