"""Running a stream over what its source holds now, into a table in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a new local folder of a local session, and an error on a cluster."""
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


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a file stream, be it one file in the folder or a folder of its own."""
    root = sf_dir.rstrip("/")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.parquet")
    one = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    reader = spark.readStream.schema(spark.read.parquet(f"{root}/{name}.parquet").schema)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(root) if one else reader.parquet(f"{root}/{name}.parquet")


def run_now(stream: DataFrame) -> DataFrame:
    """All rows that an append stream gives for its present input; state and output survive lost executors."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
