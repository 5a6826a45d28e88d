"""Stores by key, of tickets and of flows: expiry, deletion, odd rows."""

import hashlib

from marlstone.sources.stores import KeyValues, append_flows, append_tickets, read_tickets
from pyspark.sql import functions as F


def test_key_values(spark, tmp_path):
    store = KeyValues(spark, str(tmp_path / "kv"))
    rows = lambda *xs: spark.createDataFrame(list(xs), "ns string, key string, value string")
    keys = rows(("a", "1", None), ("a", "2", None), ("b", "1", None), ("c", "9", None)).select("ns", "key")
    get = lambda now: {(r.ns, r.key): r.value for r in store.get(keys, now).collect()}
    none = dict.fromkeys([("a", "1"), ("a", "2"), ("b", "1"), ("c", "9")])
    assert get(0.0) == none  # no store yet: every key is missed
    store.put(rows(("a", "1", "x"), ("a", "1", "y"), ("b", "1", "z"), (None, "1", "n"), ("a", None, "n")), 1.0, 10.0)
    store.put(rows(("a", "2", "w")), 2.0, 100.0)
    assert get(3.0) == none | {("a", "1"): "y", ("b", "1"): "z", ("a", "2"): "w"}
    store.put(rows(("a", "1", "new")), 4.0, 100.0)
    store.drop(rows(("b", "1", None), ("q", "q", None)), 5.0)
    want = none | {("a", "1"): "new", ("a", "2"): "w"}
    assert get(6.0) == want and get(50.0) == want and get(103.0) == none | {("a", "1"): "new"}
    store.compact(6.0)
    assert get(50.0) == want and store.live(6.0).count() == 2 and spark.read.parquet(store.path).count() == 2


def test_tickets_and_flows(spark, tmp_path):
    path = str(tmp_path / "t")
    assert read_tickets(spark, path).count() == 0
    rows = spark.createDataFrame([("s", "help", None, None, None), (None, None, "r", "error", "high")], "session_id string, user_message string, bot_response string, reason string, priority string")
    append_tickets(rows, path, F.lit("2024-01-01"))
    append_tickets(rows.limit(0), path, F.lit("2024-01-02"))
    got = sorted(((r.id, r.session_id, r.user_message, r.bot_response, r.reason, r.status, r.priority, r.assigned_to) for r in read_tickets(spark, path).collect()), key=str)
    key = lambda *xs: hashlib.sha256("|".join(xs).encode()).hexdigest()[:8]
    assert got == sorted([(key("s", "help", "2024-01-01"), "s", "help", "", "low_confidence", "pending", "medium", None), (key("", "", "2024-01-01"), None, "", "r", "error", "pending", "high", None)], key=str)
    flows = spark.createDataFrame([("a", " done ", "x\n"), ("a", None, "x"), ("", "done", "x"), ("b", "done", " ")], "session_id string, status string, flow_text string")
    append_flows(flows, str(tmp_path / "f"))
    append_flows(flows, str(tmp_path / "f"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "f")).collect()] == [("a", "done", "x\n")] * 2
