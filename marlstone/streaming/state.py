"""Recurrences over keyed streams: acceptance, slots, caches. Each has a batch form and, where noted, a streaming form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rate_limit(events: DataFrame, key: str, seconds: str, order: str, limit: int | str, window: float) -> DataFrame:
    """``events`` with ``accepted``: fewer than ``limit`` accepted events of the key in the ``window`` seconds before; with ``left``, how many more there may be, if ``limit`` is a column.

    Events whose limit is null are accepted and not recorded.

    Rejected events are not recorded, so this is a recurrence and no RANGE count. Rows stream
    through a task in order of key and time; it holds the times of one key's accepted events
    in the window, at most ``limit``. A key's rows meet in one task, as the recurrence needs.
    """
    by_row = isinstance(limit, str)
    cols = [key, seconds, order, *([limit] if by_row else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, accepted = object(), []
        for b in batches:
            out, left = np.zeros(b.num_rows, bool), []
            for i, (k, t, most) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist() if by_row else [limit] * b.num_rows)):
                if k != at:
                    at, accepted = k, []
                if most is None:
                    out[i] = True
                    left.append(None)
                    continue
                accepted = [x for x in accepted if t - x < window]
                if len(accepted) < most:
                    accepted.append(t)
                    out[i] = True
                left.append(max(0, most - len(accepted)))
            more = [pa.array(left, pa.int32())] if by_row else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out), *more], [*cols, "accepted", *(["left"] if by_row else [])])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.select(*cols).schema)
    return events.select(*cols).repartition(key).sortWithinPartitions(key, seconds, order).mapInArrow(run, f"{schema}, accepted boolean{', left int' if by_row else ''}")


def range_count_bound(events: DataFrame, key: str, seconds: str, window: int) -> DataFrame:
    """``events`` with ``seen``: events of the key in the window, an upper bound of what a limiter would hold."""
    w = Window.partitionBy(key).orderBy(F.col(seconds)).rangeBetween(-window + 1, 0)
    return events.withColumn("seen", F.count("*").over(w))


def fill_slots(events: DataFrame, key: str, order: str, slot: str, value: str, slots: list[str]) -> DataFrame:
    """``key``, ``order``, the slots filled so far and the first one missing: a forward-fill over each key's events."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = events
    for s in slots:
        out = out.withColumn(s, F.last(F.when(F.col(slot) == s, F.col(value)), ignorenulls=True).over(w))
    missing = F.coalesce(*[F.when(F.col(s).isNull(), F.lit(s)) for s in slots], F.lit("complete"))
    return out.select(key, order, *slots, missing.alias("missing"))


def slot_machine(events: DataFrame, key: str, order: str, slot: str, value: str, slots: list[str]) -> DataFrame:
    """Like ``fill_slots``, but a complete form is emitted and cleared: a state machine, rows of a key in order through one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, form = object(), {}
        for b in batches:
            missing, forms = [], []
            for k, name, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if k != at:
                    at, form = k, {}
                if name in slots:
                    form[name] = v
                gap = next((s for s in slots if s not in form), None)
                missing.append(gap)
                forms.append("|".join(str(form[s]) for s in slots) if gap is None else None)
                if gap is None:
                    form = {}
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(missing, pa.string()), pa.array(forms, pa.string())], [key, order, "missing", "form"])

    e = events.select(key, order, F.col(slot).alias("slot"), F.col(value).cast("string").alias("value"))
    kinds = {f.name: f.dataType.simpleString() for f in e.schema}
    return e.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, f"{key} {kinds[key]}, {order} {kinds[order]}, missing string, form string")


def session_counts(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Sessions of each key that end after ``gap`` without an event. For a stream, give it a watermark first."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))


def live_metrics(events: DataFrame, ts: str, late: str, every: str) -> DataFrame:
    """Counts and sums by tumbling window and kind, for batch or stream; rows later than ``late`` are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
