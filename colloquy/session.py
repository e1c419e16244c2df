"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "6g", **extra: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("colloquy")
    settings = SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory} | extra
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def packed(folder: str) -> str:
    """The package's sources as a zip file in ``folder``."""
    root, path = root_on_path(), os.path.join(folder, "colloquy.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(os.path.join(root, "colloquy")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.relpath(full, root))
    return path


_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, also when the driver was started elsewhere.

    Workers of a local master see the driver's folders; to those of a cluster Spark sends the package, once an application.
    """
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        if sc.applicationId not in _SENT:
            sc.addPyFile(packed(tempfile.mkdtemp(prefix="spark-")))
            _SENT.add(sc.applicationId)
        return
    env, root = sc.environment, root_on_path()
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str):
    """One table of a data folder, by a path that any Hadoop file system can serve."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def root_on_path() -> str:
    """The repository folder, for tests that import the entry module."""
    return os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
