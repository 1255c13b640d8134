"""Session settings the plans rely on, and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings for a session that this package makes itself (tests, bench); a cluster brings its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A local session with the package's defaults."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("ledgerloom")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory} | extra
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the tables kept as ``<folder>/<name>.parquet``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset (local runs), a temporary one is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = Path(tempfile.mkdtemp(prefix="ledgerloom-")).as_uri()
    spark.sparkContext.setCheckpointDir(own)
    return own


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system and path object of a path, on whatever storage it lies."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def delete_at_end(spark: SparkSession, folder: str) -> None:
    """Removes a folder, also one that isn't there yet, when the driver's JVM ends."""
    fs, place = file_system(spark, folder)
    fs.mkdirs(place)
    fs.deleteOnExit(place)


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and returns it read back: computed once, and kept when executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
