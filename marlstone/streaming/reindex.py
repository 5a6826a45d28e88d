"""Scheduled reindexing: one run at a time by a lease, batches that may run twice, a status record."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..scratch import exists, file_system, remove

#: Seconds after which a lease that nobody renewed is taken for that of a driver that died.
LEASE_SECONDS = 3600.0


def _create(spark: SparkSession, path: str, text: str, overwrite: bool) -> bool:
    """Writes a small file; False if it is there and must not be replaced. The file system makes one of several creators succeed.

    Hadoop's own view of local disks looks first and creates then, so there the operating system is asked.
    """
    where, fs = file_system(spark, path)
    if fs.getScheme() == "file" and not overwrite:
        local = where.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            with open(local, "x") as f:
                f.write(text)
        except FileExistsError:
            return False
        return True
    try:
        out = fs.create(where, overwrite)
    except Exception as e:
        if not overwrite and fs.exists(where):
            return False
        raise e
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def _read(spark: SparkSession, path: str) -> dict | None:
    where, fs = file_system(spark, path)
    if not fs.exists(where):
        return None
    source = fs.open(where)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()
    try:
        return json.loads(text)
    except ValueError:  # a creator is at it, or died
        return {}


class Lease:
    """The right to run, a file under ``folder``: as a context it tells whether this owner holds it."""

    def __init__(self, spark: SparkSession, folder: str, seconds: float = LEASE_SECONDS):
        self.spark, self.path, self.seconds, self.owner = spark, f"{folder}/lease", seconds, uuid.uuid4().hex

    def __enter__(self) -> bool:
        for _ in range(2):
            if _create(self.spark, self.path, json.dumps({"owner": self.owner, "until": time.time() + self.seconds}), False):
                return True
            held = _read(self.spark, self.path)
            if held is None:
                continue
            where, fs = file_system(self.spark, self.path)
            until = held.get("until") or fs.getFileStatus(where).getModificationTime() / 1000 + self.seconds
            if until > time.time():
                return False
            # of several that find it stale, the one whose rename succeeds removes it
            aside = f"{self.path}.{self.owner}"
            if fs.rename(where, file_system(self.spark, aside)[0]):
                remove(self.spark, aside)
        return False

    def __exit__(self, *_) -> None:
        held = _read(self.spark, self.path)
        if held and held.get("owner") == self.owner:
            remove(self.spark, self.path)


def status(spark: SparkSession, folder: str) -> dict:
    """The record of the last run: state (never, running, ok, failed), started, ended, result, next."""
    return _read(spark, f"{folder}/status") or {"state": "never"}


def due(spark: SparkSession, folder: str, now: float | None = None) -> bool:
    """Whether the next run's time has come."""
    return (status(spark, folder).get("next") or 0) <= (time.time() if now is None else now)


def run_exclusively(spark: SparkSession, folder: str, work: Callable[[], object], hours: float = 24.0, seconds: float = LEASE_SECONDS) -> bool:
    """Runs ``work`` unless another run holds the lease under ``folder``; False if one does.

    The status record tells the run's state; a failure is recorded, frees the lease and is raised. The next run is
    due ``hours`` after the start.
    """
    with Lease(spark, folder, seconds) as mine:
        if not mine:
            return False
        told = {"state": "running", "started": time.time(), "next": time.time() + 3600 * hours}
        tell = lambda **more: _create(spark, f"{folder}/status", json.dumps(told | more), True)
        tell()
        try:
            result = work()
        except Exception as e:
            tell(state="failed", ended=time.time(), result=str(e)[:300])
            raise
        tell(state="ok", ended=time.time(), result=result if isinstance(result, int | float | str | None) else str(result))
        return True


def write_once(batch: DataFrame, batch_id: int, out: str) -> None:
    """Writes a batch to a place of its own: when it is repeated after a failure, its rows replace what was there."""
    batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def reindex(source: DataFrame, make: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> int:
    """Indexes what is new in a stream of sources: ``make`` turns a batch into rows, written once for each batch. Returns the batches done in all."""
    query = source.writeStream.foreachBatch(lambda batch, i: write_once(make(batch), i, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = source.sparkSession
    where, fs = file_system(spark, out)
    return len(fs.listStatus(where)) if exists(spark, out) else 0
