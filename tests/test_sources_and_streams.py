"""Catalogues, text and JSON files, logs, caches, and streaming jobs run to their end."""

import json
from pathlib import Path

from marlstone.sources import files as S
from marlstone.streaming import jobs
from pyspark.sql import functions as F


def test_catalog(spark, tmp_path):
    schema, path = "id string, n int", str(tmp_path / "c.json")
    assert S.read_catalog(spark, path, schema).count() == 0
    Path(path).write_text(json.dumps([{"id": "a", "n": 1, "other": 2}, {"id": "é"}]))
    first = S.read_catalog(spark, path, schema)
    assert sorted(map(tuple, first.collect()), key=str) == [("a", 1), ("é", None)]
    S.write_catalog(first.withColumn("n", F.coalesce("n", F.lit(7))), path)
    S.write_catalog(S.read_catalog(spark, path, schema).where("id <> 'a'"), path)  # reads and replaces one path
    assert list(map(tuple, S.read_catalog(spark, path, schema).collect())) == [("é", 7)]


def test_text_and_json_files(spark, tmp_path):
    for name, body in {"a.json": '{"x": 1, "y": 2}', "b.json": "[1, 2, 3]", "c.json": "{oops", "d.json": "5"}.items():
        (tmp_path / name).write_text(body)
    (tmp_path / "t.txt").write_text("one\ntwo")
    assert [tuple(r) for r in S.read_texts(spark, str(tmp_path / "t.txt")).collect()] == [("t", "one\ntwo")]
    got = {r.file_name: (r.kind, r.entries) for r in S.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.json": ("object", 2), "b.json": ("array", 3), "c.json": ("invalid_json", 0), "d.json": ("scalar", 0)}


def test_sections_and_logs(spark, tmp_path):
    df = spark.createDataFrame([({"A": ["x", "y"], "B": []},)], "m map<string,array<string>>")
    assert [tuple(r) for r in S.section_texts(df, "m").collect()] == [("A", "## A\n- x\n- y")]
    log = spark.createDataFrame([("s", "q", "r", "ES", -3), ("", "q", "r", "es", 1), ("s", None, "r", "es", 1)], "session_id string, question string, response string, lang string, latency_ms long")
    for _ in range(2):
        S.append_log(log, str(tmp_path / "log"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [("s", "q", "r", "es", 0)] * 2
    S.write_ndjson(log.limit(1), str(tmp_path / "nd"))
    assert json.loads(spark.read.text(str(tmp_path / "nd")).first().value)["lang"] == "ES"


def test_cache(spark):
    df = spark.createDataFrame([("a", "1", 0.0, 100.0), ("a", "2", 5.0, 60.0), ("b", "3", 0.0, 10.0)], "key string, value string, created_at double, expires_at double")
    assert [tuple(r) for r in S.cache_read(df, 50.0).collect()] == [("a", "2", 45.0)]


def test_streams(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in/events.parquet").symlink_to(f"{sf}/events.parquet")
    stream = lambda: jobs.read_events(spark, str(tmp_path / "in"), schema)
    jobs.write_metrics(stream(), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    closed = spark.read.parquet(str(tmp_path / "out"))
    whole = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert closed.count() > 0 and closed.join(whole, ["start", "event_type", "n"]).count() == closed.count()
    seen = {}
    jobs.write_counts(stream(), lambda df, i: seen.update({r.event_type: r.n for r in df.collect()}), str(tmp_path / "c2")).awaitTermination()
    assert seen == {r.event_type: r["count"] for r in spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").count().collect()}


def test_stateful_streams(spark, sf, tmp_path):
    from marlstone.streaming.state import rate_limit

    events = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/events.parquet").symlink_to(f"{sf}/events.parquet")
    stream = jobs.read_events(spark, str(tmp_path / "in"), events.schema)
    rows: list = []
    limited = jobs.accepted(stream, "user_id", "ts", 3, 86400.0)
    limited.writeStream.foreachBatch(lambda df, i: rows.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    batch = rate_limit(events.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"), "event_id"), "user_id", "s", "event_id", 3, 86400.0).collect()
    assert sorted((r.user_id, r.s, r.accepted) for r in rows) == sorted((r.user_id, r.s, r.accepted) for r in batch)
    got: list = []
    jobs.latest_unanswered(stream, lambda df, i: got.append([r.event_id for r in df.collect()]), str(tmp_path / "c2"), str(tmp_path / "errors"), 20).awaitTermination()
    assert got[-1] == [r.event_id for r in events.where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).collect()]
    seen: list = []
    once = jobs.first_seen(stream.select("user_id", "ts"), "user_id", "ts", "400 days")
    once.writeStream.foreachBatch(lambda df, i: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.user_id for r in seen) == sorted(r.user_id for r in events.select("user_id").distinct().collect())
