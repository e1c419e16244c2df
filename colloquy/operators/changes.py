"""Changes of tables as functions from frames to frames: each returns the next state, to be written as a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of the same key; the others stay. Columns of ``old``."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def guarded_upsert(old: DataFrame, new: DataFrame, keys: list[str], guard: Column) -> DataFrame:
    """As ``upsert``, but an old row for which ``guard`` holds wins over a new one."""
    held = old.where(guard)
    return upsert(old, new.join(held.select(*keys), keys, "left_anti"), keys)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows of new keys come in."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def numbered(df: DataFrame, key: str) -> DataFrame:
    """Rows with their number in the order of a string key, from 1; keys are distinct.

    Numbers are counted inside prefixes of two characters, and prefixes are then put one behind the other.
    """
    rows = df.withColumn("_prefix", F.substring(key, 1, 2))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("_prefix").agg(F.count("*").alias("_n")).select("_prefix", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_prefix").orderBy(key))
    return rows.join(starts, "_prefix").withColumn("number", inside + F.col("_before")).drop("_prefix", "_before")


def compare_and_set(state: DataFrame, asked: DataFrame, key: str, expected: str, column: str, value: Column) -> DataFrame:
    """``column`` becomes ``value`` where ``asked`` (key, expected) names the row's current expected value."""
    hit = asked.select(F.col(key).alias("_key"), F.col(expected).alias("_want"), F.lit(True).alias("_hit"))
    joined = state.join(hit, (F.col(key) == F.col("_key")) & F.col(expected).eqNullSafe(F.col("_want")), "left")
    return joined.withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column))).drop("_key", "_want", "_hit")


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, key: str, keep: dict[str, Column] | None = None) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted keys; rows that ``keep`` names stay with their key set to null."""
    out = {}
    for name, df in tables.items():
        left = df.join(gone.select(key).distinct(), key, "left_anti")
        if keep and name in keep:
            saved = df.where(keep[name]).join(gone.select(key).distinct(), key, "left_semi").withColumn(key, F.lit(None).cast(dict(df.dtypes)[key]))
            left = left.unionByName(saved.select(*left.columns))
        out[name] = left
    return out


def patch(df: DataFrame, changes: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``column`` from ``changes`` (keys and column) where there is a change that is not null."""
    new = changes.select(*keys, F.col(column).alias("_new"))
    return df.join(new, keys, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*df.columns)
