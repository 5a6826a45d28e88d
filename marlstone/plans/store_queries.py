"""Stores written and read back, and jobs run to their end, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..scratch import scratch_path
from ..session import table
from ..sources.documents import JsonDocuments
from ..sources.stores import KeyValues, append_flows, append_tickets, read_tickets
from ..streaming import jobs
from ..streaming import reindex as X
from .registry import query


@query("""SELECT 'n' || event_id || '.json' AS name, CASE WHEN event_id % 4 = 1 THEN event_id ELSE try_cast(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events WHERE event_id % 4 <> 2""")
def documents_merge(spark, sf_dir):
    """Documents stored, then some replaced and some deleted, then read; bad names and bodies change nothing."""
    store = JsonDocuments(spark, scratch_path(spark, "json-documents"), 16)
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("n"), "event_id", F.lit(".json")).alias("name"), F.col("props").alias("body"))
    store.merge(e)
    new = F.when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"k": '), "event_id", F.lit("}")))
    odd = e.select(F.concat(F.lit("../"), "name").alias("name"), "body").unionByName(e.select("name", F.lit("3").alias("body")))
    store.merge(e.where("event_id % 4 IN (1, 2)").select("name", new.alias("body")).unionByName(odd))
    return store.read().select("name", F.try_variant_get("body", "$.k", "bigint").alias("k"))


@query("""WITH e AS (SELECT user_id, max(value) FILTER (WHERE event_id % 2 = 0) AS first, max(value) FILTER (WHERE event_id % 2 = 1) AS second FROM events GROUP BY user_id)
SELECT user_id::VARCHAR AS key, CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 3 = 0 AND second IS NOT NULL THEN second WHEN user_id % 3 = 0 THEN first END AS value FROM e""")
def kv_store(spark, sf_dir):
    """Values set, set again for some keys, deleted, expired, and read."""
    store = KeyValues(spark, scratch_path(spark, "values"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.lit("v").alias("ns"), F.col("user_id").cast("string").alias("key"))
    latest = lambda rows: rows.groupBy("ns", "key").agg(F.max("value").cast("string").alias("value"))
    store.put(latest(e.where("event_id % 2 = 0 AND user_id % 3 = 0")), 1.0, 100.0)
    store.put(latest(e.where("event_id % 2 = 1 AND user_id % 3 = 0")), 2.0, 100.0)
    store.put(latest(e.where("user_id % 3 = 1")), 3.0, 5.0)
    store.drop(e.where("user_id % 5 = 0").select("ns", "key"), 4.0)
    store.compact(5.0)
    return store.get(e.select("ns", "key").distinct(), 50.0).select("key", F.col("value").cast("double").alias("value"))


@query("""SELECT substring(sha256(user_id || '|' || props || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%S')), 1, 8) AS id, user_id::VARCHAR AS session_id, props AS user_message, CASE WHEN event_id % 2 = 0 THEN 'error' ELSE 'low_confidence' END AS reason, 'pending' AS status,
  CASE WHEN value > 50 THEN 'high' ELSE 'medium' END AS priority, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at FROM events WHERE event_type = 'error'""")
def ticket_store(spark, sf_dir):
    """Tickets for errors, appended and read back."""
    path = scratch_path(spark, "tickets")
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    rows = e.select(F.col("user_id").cast("string").alias("session_id"), F.col("props").alias("user_message"), F.lit(None).cast("string").alias("bot_response"), F.when(F.col("event_id") % 2 == 0, "error").alias("reason"), F.when(F.col("value") > 50, "high").alias("priority"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), "event_id")
    for part in (0, 1):
        append_tickets(rows.where(F.col("event_id") % 2 == part), path, F.col("at"))
    return read_tickets(spark, path).select("id", "session_id", "user_message", "reason", "status", "priority", "created_at")


@query("""SELECT conv_id::VARCHAR AS session_id, CASE WHEN max(turn) > 3 THEN 'done' ELSE 'open' END AS status, trim(string_agg(text, chr(10) ORDER BY turn), ' ' || chr(10)) AS flow_text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id HAVING flow_text <> '' AND max(turn) <> 2""")
def flow_log(spark, sf_dir):
    """Transcripts of conversations, appended to a log and read back."""
    path = scratch_path(spark, "flows")
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL").groupBy(F.col("conv_id").cast("string").alias("session_id"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    rows = c.agg(F.when(F.max("turn") > 3, "done").when(F.max("turn") != 2, " open ").alias("status"), F.btrim(text, F.lit(" \n")).alias("flow_text"))
    append_flows(rows, path)
    return spark.read.parquet(path)


@query("SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total, max(epoch_us(ts))::BIGINT AS latest FROM events WHERE value > 10 GROUP BY event_type")
def reindex_events(spark, sf_dir):
    """The event table indexed as a stream under a lease, batch by batch, and read back; a second run finds nothing new."""
    folder = scratch_path(spark, "reindex")
    schema = table(spark, sf_dir, "events").schema
    source = lambda: jobs.read_events(spark, sf_dir, schema, "events.parquet")
    for _ in range(2):
        X.run_exclusively(spark, folder, lambda: X.reindex(source(), lambda batch: batch.where("value > 10"), f"{folder}/rows", f"{folder}/checkpoint"))
    rows = spark.read.parquet(f"{folder}/rows")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max(F.unix_micros("ts")).alias("latest"))
