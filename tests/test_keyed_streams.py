"""Streams with timers and state against the batch forms and plain loops: late and repeated events, restarts."""

import datetime

import pytest
from marlstone.plans import QUERIES
from marlstone.plans.stream_queries import location_turns
from marlstone.streaming import jobs
from marlstone.streaming import keyed as K
from pyspark.sql import functions as F

DAY = 86_400_000_000


@pytest.fixture(scope="module")
def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


def write_files(rows, schema, spark, folder, names):
    """One file for each list of rows, read in the order of their names."""
    import os
    import time

    for name, some in zip(names, rows):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{folder}/{name}.tmp")
        part = next(x for x in os.listdir(f"{folder}/{name}.tmp") if x.endswith(".parquet"))
        os.rename(f"{folder}/{name}.tmp/{part}", f"{folder}/{name}.parquet")
        now = time.time()
        os.utime(f"{folder}/{name}.parquet", (now, now))
        time.sleep(0.05)


def drained(stream, checkpoint, into):
    """Runs a stream to the end of what is there."""
    add = lambda df, i: into.extend(df.collect())
    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_debounced_stream_equals_batch(spark, sf, events, tmp_path):
    """Events of later files come again in earlier ones, and each file holds some that belong to the one before."""
    rows = [tuple(r) for r in events.orderBy("ts").collect()]
    cuts = [rows[i : i + 250] for i in range(0, 1000, 250)]
    swapped = [cuts[0][:-9], cuts[0][-9:] + cuts[1] + cuts[0][-20:], cuts[2][9:], cuts[2][:30] + cuts[3]]
    last = (10**9, datetime.datetime(2031, 1, 1), 0, "flush", 0.0, "{}")
    write_files([*swapped, [last]], events.schema, spark, str(tmp_path), "abcde")
    stream = jobs.read_events(spark, str(tmp_path), events.schema, files=1)
    got: list = []
    mode = F.when(F.col("user_id") % 2 == 0, "full").otherwise("delta")
    drained(K.debounced(stream, "event_type", "ts", mode, "event_id", "30 minutes", "20 days"), str(tmp_path / "c"), got)
    want = [(r.event_type, r.fires, r["mode"], r.calls) for r in QUERIES["debounce"](spark, sf).collect()]
    assert sorted((r.event_type, r.fires.replace(tzinfo=None), r["mode"], r.calls) for r in got if r.event_type != "flush") == sorted(want)


def in_two_starts(spark, events, tmp_path, make):
    """All rows of a stream that is stopped after two files and started again from its checkpoint."""
    rows, folder, got = [tuple(r) for r in events.orderBy("ts").collect()], str(tmp_path / "in"), []
    parts = [rows[i : i + 250] for i in range(0, 1000, 250)]
    (tmp_path / "in").mkdir()
    write_files(parts[:2], events.schema, spark, folder, "ab")
    drained(make(jobs.read_events(spark, folder, events.schema, files=1)), str(tmp_path / "c"), got)
    before = len(got)
    write_files(parts[2:], events.schema, spark, folder, "cd")
    drained(make(jobs.read_events(spark, folder, events.schema, files=1)), str(tmp_path / "c"), got)
    assert 0 < before < len(got)
    return got


def plain_dialog(rows, ttl):
    out, held = [], {}
    for r in rows:
        pending, last = held.get(r.user_id, (False, 0))
        pending = pending and r.us - last < ttl
        if r.kind == "scope":
            action = "answer"
        elif pending:
            action = "ask_again" if r.kind in ("asks", "short") else "drop"
        else:
            action = "ask" if r.kind == "asks" else "none"
        held[r.user_id] = (action in ("ask", "ask_again"), r.us)
        out.append((r.user_id, r.event_id, action))
    return sorted(out)


def test_dialog(spark, sf, events, tmp_path):
    turns = location_turns(events).orderBy("us", "event_id").collect()
    want = plain_dialog(turns, DAY)
    assert {x[2] for x in want} == {"answer", "ask", "ask_again", "drop", "none"}
    assert sorted(map(tuple, QUERIES["location_dialog"](spark, sf).collect())) == want
    got = in_two_starts(spark, events, tmp_path, lambda s: K.dialog_stream(location_turns(s), "user_id", "ts", "event_id", "kind", DAY, "1 hour"))
    assert sorted(map(tuple, got)) == want


def plain_cache(rows, capacity, ttl):
    out, shards = [], {}
    for r in rows:
        held = shards.setdefault(r.s, [])  # [key, stored] by use, latest last
        own = next((x for x in held if x[0] == r.user_id), None)
        fresh = own is not None and r.us - own[1] < ttl
        if own is not None:
            held.remove(own)
        held.append(own if fresh else [r.user_id, r.us])
        gone = held.pop(0)[0] if len(held) > capacity else None
        out.append((r.user_id, r.event_id, "hit" if fresh else "miss" if own is None else "expired", gone))
    return sorted(out)


def test_cache(spark, events, tmp_path):
    requests = lambda df: df.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    rows = requests(events).withColumn("us", F.unix_micros("ts")).withColumn("s", K.cache_shard(F.col("user_id"), 3)).orderBy("us", "event_id")
    want = plain_cache(rows.collect(), 3, DAY)
    assert {x[2] for x in want} == {"hit", "miss", "expired"} and any(x[3] is not None for x in want)
    assert sorted(map(tuple, K.cached(rows.drop("s"), "user_id", "us", "event_id", 3, DAY, 3).collect())) == want
    got = in_two_starts(spark, events, tmp_path, lambda s: K.cached_stream(requests(s), "user_id", "ts", "event_id", 3, DAY, "1 hour", 3))
    assert sorted(map(tuple, got)) == want
    odd = spark.createDataFrame([(None, 1, 5), ("a", 2, None), ("a", 3, 7), ("a", 4, 7)], "user_id string, event_id long, us long")
    assert sorted(map(tuple, K.cached(odd, "user_id", "us", "event_id", 1, 5).collect())) == [("a", 3, "miss", None), ("a", 4, "hit", None)]
    assert K.cached(odd.limit(0), "user_id", "us", "event_id", 1, 5).count() == 0
