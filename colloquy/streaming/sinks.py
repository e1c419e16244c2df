"""Upserts from a stream: every micro-batch is a delta under its own number, so that a repeated one changes nothing.

A table is a folder of deltas (``delta/batch=N``) and snapshots (``snapshot/batch=N``: the latest row of every key up to
batch N). A batch writes its own delta alone, whatever the table's size; every ``every`` batches a snapshot is made of
the last one and the deltas behind it. Readers take the newest complete snapshot and the deltas behind it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runner import shared_folder


def _complete(spark: SparkSession, folder: str) -> list[int]:
    """The batch numbers whose files are complete, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [x.getPath() for x in fs.listStatus(path)]
    done = [x.getName() for x in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    return sorted(int(x.split("=")[1]) for x in done if x.startswith("batch="))


class UpsertTable:
    """The latest row of every key, by ``order`` columns, under one folder of the shared file system."""

    def __init__(self, path: str, schema, keys: list[str], order: list[str], every: int = 16):
        self.path, self.schema, self.keys, self.order, self.every = path, schema, keys, order, every

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        best = F.max_by(F.struct(*rest), F.struct(*self.order)).alias("_row")
        return rows.groupBy(*self.keys).agg(best).select(*self.keys, *[f"_row.{c}" for c in rest]).select(*rows.columns)

    def _read(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        deltas = [n for n in _complete(spark, f"{self.path}/delta") if upto is None or n <= upto]
        base = [n for n in _complete(spark, f"{self.path}/snapshot") if upto is None or n <= upto][-1:]
        paths = [f"{self.path}/snapshot/batch={n}" for n in base] + [f"{self.path}/delta/batch={n}" for n in deltas if not base or n > base[0]]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, batch: int) -> None:
        """For ``foreachBatch``: the delta of a batch, replaced if the batch is repeated, and a snapshot now and then."""
        spark = rows.sparkSession
        self._latest(rows).write.mode("overwrite").parquet(f"{self.path}/delta/batch={batch}")
        if batch and batch % self.every == 0 and batch not in _complete(spark, f"{self.path}/snapshot"):
            self._latest(self._read(spark, batch)).write.mode("overwrite").parquet(f"{self.path}/snapshot/batch={batch}")

    def read(self, spark: SparkSession) -> DataFrame:
        return self._latest(self._read(spark))

    def start(self, stream: DataFrame, checkpoint: str):
        """Upserts all that the stream's source holds now."""
        return stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replayed(rows: DataFrame, spread: str, keys: list[str], order: list[str], batches: int, again: int) -> DataFrame:
    """``rows`` streamed in so many batches into an upsert table, of which one comes a second time; then its latest rows."""
    spark = rows.sparkSession
    at = f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}"
    rows.repartition(batches, spread).write.parquet(f"{at}/in")
    table = UpsertTable(f"{at}/table", rows.schema, keys, order, every=2)

    class Repeating(UpsertTable):
        def write(self, some: DataFrame, batch: int) -> None:
            super().write(some, batch)
            if batch == again:
                super().write(some, batch)

    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    Repeating(table.path, rows.schema, keys, order, every=2).start(stream, f"{at}/state").awaitTermination()
    return table.read(spark)
