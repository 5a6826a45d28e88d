"""Structured Streaming jobs over folders of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .state import live_metrics


def read_events(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet", files: int = 100) -> DataFrame:
    """A stream of the files that match ``glob``, at most ``files`` a batch; ``ts`` as an instant, as watermarks need."""
    source = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files)
    return source.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def write_metrics(events: DataFrame, out: str, checkpoint: str, late: str = "1 hour", every: str = "1 day"):
    """Starts the job that appends closed windows to ``out`` and ends when all files there are read."""
    rows = live_metrics(events, "ts", late, every).select(F.col("w.start").alias("start"), "event_type", "n", "total")
    return rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_counts(events: DataFrame, store, checkpoint: str):
    """Starts the job that keeps counts by kind; ``store(frame, batch_id)`` gets all of them after each batch."""
    counts = events.groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accepted(events: DataFrame, key: str, ts: str, limit: int, window_seconds: float, late: str = "1 hour") -> DataFrame:
    """A stream of ``key, ts, accepted``: the rate limiter's recurrence over keyed state.

    State is the times of a key's accepted events in the window, at most ``limit``; it is
    dropped when the watermark, ``late`` behind the latest event, is past the window of the
    last of them. Events of a batch are taken in order of time.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = events.schema[key].dataType.simpleString()

    def step(k, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("s")
        out = []
        for s in rows["s"]:
            held = [x for x in held if s - x < window_seconds]
            ok = len(held) < limit
            if ok:
                held.append(float(s))
            out.append(ok)
        state.update((held,))
        ends = int((max(held, default=0.0) + window_seconds) * 1000)
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(out), "s": rows["s"].to_numpy(), "accepted": out})

    rows = events.withWatermark(ts, late).select(key, ts, (F.unix_micros(ts) / 1e6).alias("s"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, s double, accepted boolean", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def first_seen(events: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """A stream without repeats of ``key`` that come within ``late`` of each other; state is dropped with the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def latest_unanswered(events: DataFrame, store, checkpoint: str, path: str, keep: int = 500):
    """Starts the job that appends error events to ``path``; ``store(frame, batch_id)`` gets the ``keep`` latest after each batch.

    The latest of each batch are kept apart, so a batch reads its own rows and ``keep`` others.
    """
    spark = events.sparkSession
    latest = f"{path.rstrip('/')}-latest"

    def newest(rows: DataFrame) -> DataFrame:
        return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(keep)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")  # a batch that runs again replaces its rows
        rows = spark.read.schema(batch.schema).parquet(f"{path}/batch={batch_id}")
        if batch_id:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{latest}/batch={batch_id - 1}"))
        newest(rows).write.mode("overwrite").parquet(f"{latest}/batch={batch_id}")
        store(newest(spark.read.schema(batch.schema).parquet(f"{latest}/batch={batch_id}")), batch_id)

    errors = events.where("event_type = 'error'").select("event_id", "ts", F.substring("props", 1, 300).alias("said"))
    return errors.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
