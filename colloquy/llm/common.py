"""What the operators of this subpackage share: code shipping, cut lineage, words and integer mixing."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship  # noqa: F401  every operator's first step


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a new local folder; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors then cost no more than a file read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/colloquy-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def below(key: Column, most: int, n: int) -> Column:
    """Whether a row's hash lies in the lowest part that holds about twice ``most`` of ``n`` rows.

    A sample of the ``most`` lowest hashes is then taken from these alone, not from ``most`` rows of every partition.
    """
    share = 2 * most / max(n, 1) + 1e-3
    return F.lit(True) if share >= 1 else key <= F.lit(int(-(2**63) + share * 2**64))


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a frame that ``cut`` returned, once nothing reads them any more."""
    spark = df.sparkSession
    for name in {os.path.dirname(x) for x in df.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        if "/colloquy-" in name:
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shuffled(df: DataFrame) -> DataFrame:
    """The side of a join that is never broadcast: what grows with the corpus does not pass the driver, however small its
    files are."""
    return df.hint("merge")


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Let Spark send Python workers at most so many rows at once: whole texts are long, and both sides hold a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def give_back() -> None:
    """Return freed memory of this worker to the system, so that idle workers of earlier stages take little room."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
        if trim is not None:
            trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch, rows: int = 1024, nbytes: int = 8 << 20, column: str = "text"):
    """Parts of an Arrow batch of at most so many rows and about so many bytes of text (one row at least)."""
    col = batch.column(column)
    size = np.zeros(batch.num_rows, dtype=np.int64)
    if batch.num_rows:
        import pyarrow.compute as pc

        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i in range(batch.num_rows):
        if i > start and (i - start >= rows or total + size[i] > nbytes):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size[i]
    if batch.num_rows > start:
        yield batch.slice(start, batch.num_rows - start)
