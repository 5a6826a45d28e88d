"""Streams with timers and state by key: quiet periods, pending questions, caches. The batch forms share their rules."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.history import gap_sessions
from ..session import ship


def debounced(events: DataFrame, key: str, ts: str, mode: Column, event_id: str, quiet: str, late: str) -> DataFrame:
    """A stream of ``key, fires, mode, calls``: one run for the calls of a key that come less than ``quiet`` apart, when it has been quiet so long.

    mode is the greatest asked for. Events are taken by their own time, in any order, up to ``late`` behind the
    latest; one that comes again, with the same id, counts once.
    """
    calls = events.select(key, F.col(ts).alias("_ts"), mode.alias("mode"), event_id).withWatermark("_ts", late).dropDuplicatesWithinWatermark([event_id])
    runs = calls.groupBy(key, F.session_window("_ts", quiet).alias("w")).agg(F.max("mode").alias("mode"), F.count("*").alias("calls"))
    return runs.select(key, F.col("w.end").alias("fires"), "mode", "calls")


#: What a turn is to a pending question: it names a scope, asks for a place, may be short for an answer, or is about something else.
SCOPE, ASKS, SHORT, OTHER = "scope", "asks", "short", "other"


def turn_kind(scope: Column, asks: Column, text: Column, most: int = 30) -> Column:
    return F.when(scope.isNotNull(), SCOPE).when(F.coalesce(asks, F.lit(False)), ASKS).when(F.length(F.trim(F.coalesce(text, F.lit("")))) <= most, SHORT).otherwise(OTHER)


def reaction(kind: Column, pending: Column) -> Column:
    return F.when(kind == SCOPE, "answer").when(pending & kind.isin(ASKS, SHORT), "ask_again").when(pending, "drop").when(kind == ASKS, "ask").otherwise("none")


def dialog(turns: DataFrame, key: str, us: str, order: str, kind: str, ttl: int) -> DataFrame:
    """``turns`` with ``action``: answer, ask, ask_again, drop or none, by whether a question of the session is pending.

    A question is pending from the turn that asks for a place until one names a scope or is about something
    else; ``ttl`` microseconds without a turn end it, too. So it is pending if the last turn of the same stretch that was not short asked.
    """
    w = Window.partitionBy(key, "session").orderBy(us, order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(kind) != SHORT, F.col(kind)), ignorenulls=True).over(w)
    rows = gap_sessions(turns, key, us, ttl).withColumn("_pending", F.coalesce(last == ASKS, F.lit(False)))
    return rows.withColumn("action", reaction(F.col(kind), F.col("_pending"))).drop("_pending", "session")


def dialog_stream(turns: DataFrame, key: str, ts: str, order: str, kind: str, ttl: int, late: str) -> DataFrame:
    """The same for a stream, as ``key, order, action``: state is whether a question is pending and when the session spoke last; a timer drops it after ``ttl``."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = {f.name: f.dataType.simpleString() for f in turns.schema}

    def step(k, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        pending, last = state.get if state.exists else (False, None)
        rows = pd.concat(list(frames)).sort_values(["us", order])
        out = []
        for us, what in zip(rows["us"], rows["kind"]):
            pending = pending and us - last < ttl
            out.append("answer" if what == SCOPE else "ask_again" if pending and what in (ASKS, SHORT) else "drop" if pending else "ask" if what == ASKS else "none")
            pending, last = out[-1] in ("ask", "ask_again"), int(us)
        state.update((bool(pending), last))
        state.setTimeoutTimestamp(max((last + ttl) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(out), order: rows[order].to_numpy(), "action": out})

    rows = turns.withWatermark(ts, late).select(key, ts, order, F.unix_micros(ts).alias("us"), F.col(kind).alias("kind"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, action string", "pending boolean, last long", "append", GroupStateTimeout.EventTimeTimeout)


class Lru:
    """A cache of bounded size whose entries expire; the least recently used goes first. Times never go back."""

    def __init__(self, capacity: int, ttl: float, entries=()):
        self.capacity, self.ttl, self.entries = capacity, ttl, OrderedDict(entries)  # key -> when it was stored, in order of use

    def use(self, key, now: float) -> tuple[str, object]:
        """hit, miss or expired, and the key that had to go to make room for a new entry."""
        stored = self.entries.get(key)
        outcome = "miss" if stored is None else "hit" if now - stored < self.ttl else "expired"
        if outcome != "hit":
            self.entries[key] = now
        self.entries.move_to_end(key)
        gone = self.entries.popitem(last=False)[0] if len(self.entries) > self.capacity else None
        return outcome, gone


def cache_shard(key: Column, shards: int | Column) -> Column:
    """The shard of a key: by its hash, for a number of shards, or as a column says."""
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int") if isinstance(shards, int) else shards.cast("int")


def cached(requests: DataFrame, key: str, us: str, order: str, capacity: int, ttl: int, shards: int | Column = 16) -> DataFrame:
    """``key, order, outcome, evicted`` of requests that read a cache and fill it on a miss; each of ``shards`` holds ``capacity`` keys.

    Requests of a shard are a recurrence, in order of time through one task, which holds the cache alone; keys are dealt over
    ``shards`` by hash, as the nodes of a cache are. Requests without a key or time are left out.
    """
    ship(requests.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lru = None, None
        for b in batches:
            out = []
            for shard, k, now in zip(*(b.column(i).to_pylist() for i in range(3))):
                if shard != at:
                    at, lru = shard, Lru(capacity, ttl)
                out.append(lru.use(k, now))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(3), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], b.schema.field(1).type)], [key, order, "outcome", "evicted"])

    rows = requests.where(F.col(key).isNotNull() & F.col(us).isNotNull()).select(cache_shard(F.col(key), shards).alias("_shard"), key, us, order)
    return rows.repartition("_shard").sortWithinPartitions("_shard", us, order).mapInArrow(run, f"{key} {kinds[key]}, {order} {kinds[order]}, outcome string, evicted {kinds[key]}")


def cached_stream(requests: DataFrame, key: str, ts: str, order: str, capacity: int, ttl: int, late: str, shards: int | Column = 16) -> DataFrame:
    """The same for a stream: state is the keys of a shard in order of use and when they were stored; a timer drops a shard all of whose entries have expired."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    ship(requests.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}

    def step(k, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        keys, stored = state.get if state.exists else ([], [])
        lru = Lru(capacity, ttl, zip(keys, stored))
        rows = pd.concat(list(frames)).sort_values(["us", order])
        out = [lru.use(x, int(now)) for x, now in zip(rows[key].tolist(), rows["us"])]
        state.update((list(lru.entries), list(lru.entries.values())))
        state.setTimeoutTimestamp(max((max(lru.entries.values()) + ttl) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        evicted = pd.Series([x[1] for x in out], dtype="object" if kinds[key] == "string" else "Int64")
        yield pd.DataFrame({key: rows[key].to_numpy(), order: rows[order].to_numpy(), "outcome": [x[0] for x in out], "evicted": evicted})

    rows = requests.where(F.col(key).isNotNull()).withWatermark(ts, late).select(key, ts, order, F.unix_micros(ts).alias("us"), cache_shard(F.col(key), shards).alias("_shard"))
    return rows.groupBy("_shard").applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, outcome string, evicted {kinds[key]}", f"keys array<{kinds[key]}>, stored array<long>", "append", GroupStateTimeout.EventTimeTimeout)
