"""Tables between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .session import ship

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one, in local mode only."""
    ship(spark)
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="marlstone-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    if not _written:
        atexit.register(_remove_written)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def file_system(spark: SparkSession, path: str):
    """The Hadoop path object and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    where, fs = file_system(spark, path)
    fs.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = file_system(spark, path)
    return fs.exists(where)


def _remove_written() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone; the folder is scratch space either way
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder as Parquet and read it again.

    A lost executor then costs a reread, not the work before it.
    """
    return Latest(name).put(df)


class Latest:
    """A table that each round of an iteration replaces: the round before is removed once the new one is written."""

    def __init__(self, name: str):
        self.name, self.path = name, None

    def put(self, df: DataFrame) -> DataFrame:
        spark, old = df.sparkSession, self.path
        self.path = scratch_path(spark, self.name)
        df.write.parquet(self.path)
        if old:
            self.drop(spark, old)
        return spark.read.schema(df.schema).parquet(self.path)

    @staticmethod
    def drop(spark: SparkSession, path: str) -> None:
        remove(spark, path)
        _written.remove((spark, path))
