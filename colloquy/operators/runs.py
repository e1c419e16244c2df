"""Runs of a job as a table from one state to the next: started with a backup of the last result, ended by comparing and setting.

Columns: key, status, start_time, result, backup, error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_REST = ("status", "start_time", "result", "backup", "error")


def start(runs: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Every asked run (key, start_time) is pending; what it had as its result is its backup as well, and its error goes."""
    a = asked.select(key, F.col("start_time").alias("_start"), F.lit(True).alias("_asked"))
    j = runs.join(a, key, "full")
    now = F.coalesce("_asked", F.lit(False))
    pick = lambda new, c: F.when(now, new).otherwise(F.col(c)).alias(c)
    null = F.lit(None).cast("string")
    return j.select(key, pick(F.lit("pending"), "status"), pick(F.col("_start"), "start_time"), "result", pick(F.col("result"), "backup"), pick(null, "error"))


def finish(runs: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """The runs after ends (key, start_time, outcome, result, error): one counts only for the pending run of its start.

    ``completed`` sets the result and drops backup and error; ``failed`` and ``cancelled`` bring the backup back (or keep
    the result where there is none), drop it and set the error. An end of another start changes nothing.
    """
    e = ends.select(key, F.col("start_time").alias("_start"), "outcome", F.col("result").alias("_result"), F.col("error").alias("_error"))
    hit = (F.lower("status") == "pending") & (F.col("start_time") == F.col("_start"))
    j = runs.join(e, [key], "left").withColumn("_hit", F.coalesce(hit, F.lit(False)))
    done = F.col("outcome") == "completed"
    values = {"status": F.col("outcome"), "start_time": F.col("start_time"), "result": F.when(done, F.col("_result")).otherwise(F.coalesce("backup", "result")), "backup": F.lit(None), "error": F.when(~done, F.col("_error"))}
    return j.select(key, *[F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) for c in _REST])


def fail_interrupted(runs: DataFrame, key: str, reason: str) -> DataFrame:
    """Pending runs of a session that is over fail, with their backup as the result."""
    pending = F.lower("status") == "pending"
    ends = runs.where(pending).select(key, "start_time", F.lit("failed").alias("outcome"), F.lit(None).cast("string").alias("result"), F.lit(reason).alias("error"))
    return finish(runs, ends, key)
