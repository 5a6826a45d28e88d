"""Sessions, limits, caches and state machines over the event table, and the streaming job run to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..session import table
from ..sources.files import cache_read
from ..streaming import keyed as K
from ..streaming import state as S
from .registry import query


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 180 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS started, count(*)::BIGINT AS n FROM s GROUP BY user_id, sid""")
def session_window(spark, sf_dir):
    return S.session_counts(_events(spark, sf_dir).select("user_id", "ts"), "user_id", "ts", "180 minutes").select("user_id", F.col("w.start").alias("started"), "n")


@query("""WITH g AS (SELECT event_type, user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT event_type, max(ts) + INTERVAL 30 MINUTE AS fires, max(CASE WHEN user_id % 2 = 0 THEN 'full' ELSE 'delta' END) AS mode, count(*)::BIGINT AS calls FROM s GROUP BY event_type, sid""")
def debounce(spark, sf_dir):
    """Runs that fire when a kind has been quiet for 30 minutes, in the strongest mode asked for."""
    e = _events(spark, sf_dir).select("event_type", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.when(F.col("user_id") % 2 == 0, "full").otherwise("delta").alias("mode"))
    runs = H.gap_sessions(e, "event_type", "us", 30 * 60 * 1_000_000).groupBy("event_type", "session")
    last = runs.agg((F.max("ts") + F.expr("INTERVAL 30 MINUTES")).alias("fires"), F.max("mode").alias("mode"), F.count("*").alias("calls"))
    return last.select("event_type", "fires", "mode", "calls")


_TURNS = ["donde queda", "sucursales", "ya", "una pregunta larga sobre otra cosa que no es un lugar"]


def location_turns(events):
    """Events as turns of sessions that ask for places, name a scope, are short or long."""
    from ..functions import lexicons as lex
    from ..functions import rules as R
    from ..functions import text as T

    said = F.get(T.words_array(_TURNS), (F.col("event_id") % 4).cast("int"))
    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), said.alias("text"))
    return rows.withColumn("kind", K.turn_kind(R.location_scope(F.col("text")), T.contains_any(F.lower("text"), lex.LOCATION), F.col("text")))


@query("""WITH t AS (SELECT user_id, event_id, ts, ['asks', 'scope', 'short', 'other'][event_id % 4 + 1] AS kind FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 1 DAY THEN 1 ELSE 0 END AS new FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
p AS (SELECT *, coalesce(last_value(CASE WHEN kind <> 'short' THEN kind END IGNORE NULLS) OVER (PARTITION BY user_id, sid ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'asks', false) AS pending FROM s)
SELECT user_id, event_id, CASE WHEN kind = 'scope' THEN 'answer' WHEN pending AND kind IN ('asks', 'short') THEN 'ask_again' WHEN pending THEN 'drop' WHEN kind = 'asks' THEN 'ask' ELSE 'none' END AS action FROM p""")
def location_dialog(spark, sf_dir):
    """Questions for a scope that are asked, asked again, answered, dropped, or expire after a day."""
    return K.dialog(location_turns(_events(spark, sf_dir)), "user_id", "us", "event_id", "kind", 86_400_000_000).select("user_id", "event_id", "action")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, user_id % 16 AS shard, row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT DISTINCT shard, 0::BIGINT AS rn, 0::BIGINT AS user_id, 0::BIGINT AS event_id, '' AS outcome, NULL::BIGINT AS evicted, []::STRUCT(k BIGINT, s BIGINT)[] AS held FROM e
  UNION ALL SELECT shard, rn, user_id, event_id, outcome, CASE WHEN len(now) > 5 THEN now[1].k END, CASE WHEN len(now) > 5 THEN now[2:] ELSE now END FROM (
    SELECT *, list_append(list_filter(held, lambda x: x.k <> user_id), {'k': user_id, 's': CASE WHEN outcome = 'hit' THEN stored ELSE us END}) AS now FROM (
      SELECT *, CASE WHEN stored IS NULL THEN 'miss' WHEN us - stored < 172800000000 THEN 'hit' ELSE 'expired' END AS outcome FROM (
        SELECT e.*, held, list_filter(held, lambda x: x.k = e.user_id)[1].s AS stored FROM r JOIN e ON e.shard = r.shard AND e.rn = r.rn + 1))))
SELECT user_id, event_id, outcome, evicted FROM r WHERE rn > 0""")
def cache_lru(spark, sf_dir):
    """What a cache of five users a shard answers, entries expiring after two days, a recurrence."""
    e = _events(spark, sf_dir).select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return K.cached(e, "user_id", "us", "event_id", 5, 2 * 86_400_000_000, F.col("user_id") % 16)


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS us, 0::BIGINT AS event_id, 0::BIGINT AS rn, false AS accepted, []::BIGINT[] AS held FROM events
  UNION ALL SELECT user_id, us, event_id, rn, len(h) < 3, CASE WHEN len(h) < 3 THEN list_append(h, us) ELSE h END FROM (SELECT e.*, list_filter(held, lambda x: e.us - x < 86400000000) AS h FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
SELECT user_id, us, event_id, accepted FROM r WHERE rn > 0""")
def rate_limit(spark, sf_dir):
    """Three accepted events a user in 24 hours, a recurrence."""
    e = _events(spark, sf_dir).select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")
    return S.rate_limit(e, "user_id", "us", "event_id", 3, 86_400_000_000)


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW)::BIGINT AS seen FROM (SELECT *, date_trunc('second', ts) AS t FROM events)")
def rate_bound(spark, sf_dir):
    """Events of the user in the day before, at times to the nearest second (of two the even one)."""
    nearest = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")
    e = _events(spark, sf_dir).select("event_id", "user_id", nearest.alias("s"))
    return S.range_count_bound(e, "user_id", "s", 86400).select("event_id", "seen")


@query("""WITH l AS (SELECT user_id, max(ts) AS ts, arg_max(value, ts) AS value FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
SELECT user_id AS key, value, round(epoch(now) - epoch(ts), 3) AS age FROM l, n WHERE epoch(ts) + 86400 > epoch(now)""")
def cache_hits(spark, sf_dir):
    """The last write of each key that has not expired a day later, at the time of the latest event."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("key"), "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("created_at"))
    now = e.agg(F.max("created_at")).first()[0] or 0.0
    hits = cache_read(e.withColumn("expires_at", F.col("created_at") + 86400), now)
    return hits.select("key", "value", F.round("age", 3).alias("age"))


@query("SELECT user_id, event_id, said FROM (SELECT user_id, event_id, substring(props, 1, 300) AS said, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type = 'error') WHERE rn <= 5")
def unanswered_ring(spark, sf_dir):
    """The five latest of each user."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = _events(spark, sf_dir).where("event_type = 'error'").withColumn("rn", F.row_number().over(w)).where("rn <= 5")
    return e.select("user_id", "event_id", F.substring("props", 1, 300).alias("said"))


_SLOTS = ["signup", "view", "click", "purchase"]


@query("""WITH f AS (SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER w AS signup, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS "view",
  last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS click, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS purchase FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, signup, "view", click, purchase, CASE WHEN signup IS NULL THEN 'signup' WHEN "view" IS NULL THEN 'view' WHEN click IS NULL THEN 'click' WHEN purchase IS NULL THEN 'purchase' ELSE 'complete' END AS missing FROM f""")
def first_missing(spark, sf_dir):
    return S.fill_slots(_events(spark, sf_dir), "user_id", "event_id", "event_type", "value", _SLOTS)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, value::VARCHAR AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS event_id, 0::BIGINT AS rn, [NULL, NULL, NULL, NULL]::VARCHAR[] AS f, NULL::VARCHAR[] AS g FROM events
  UNION ALL SELECT user_id, event_id, rn, CASE WHEN len(list_filter(g, lambda x: x IS NULL)) = 0 THEN [NULL, NULL, NULL, NULL]::VARCHAR[] ELSE g END, g FROM (
    SELECT e.*, [CASE WHEN event_type = 'signup' THEN v ELSE f[1] END, CASE WHEN event_type = 'view' THEN v ELSE f[2] END, CASE WHEN event_type = 'click' THEN v ELSE f[3] END, CASE WHEN event_type = 'purchase' THEN v ELSE f[4] END] AS g FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
SELECT user_id, event_id, CASE WHEN g[1] IS NULL THEN 'signup' WHEN g[2] IS NULL THEN 'view' WHEN g[3] IS NULL THEN 'click' WHEN g[4] IS NULL THEN 'purchase' END AS missing, g[1] || '|' || g[2] || '|' || g[3] || '|' || g[4] AS form FROM r WHERE rn > 0""")
def slot_fsm(spark, sf_dir):
    """Forms that are emitted and cleared when complete, a state machine."""
    return S.slot_machine(_events(spark, sf_dir), "user_id", "event_id", "event_type", "value", _SLOTS)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS started, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_metrics(spark, sf_dir):
    """The plan of the streaming job over the table as it stands; tests run it as a stream too."""
    e = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return S.live_metrics(e, "ts", "1 hour", "1 day").select(F.col("w.start").cast("timestamp_ntz").alias("started"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_id, '{\"event\":\"' || event_type || '\",\"level\":\"' || CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END || '\"}' AS line FROM events")
def log_event(spark, sf_dir):
    level = F.when(F.col("event_type") == "error", "error").otherwise("info")
    return _events(spark, sf_dir).select("event_id", F.to_json(F.struct(F.col("event_type").alias("event"), level.alias("level"))).alias("line"))


@query("SELECT event_id, try_cast(regexp_extract(t, 'k\": ?([0-9]+)', 1) AS BIGINT) AS k FROM (SELECT event_id, 'answer: ' || props || ' thanks' AS t FROM events)")
def json_extract(spark, sf_dir):
    """The first JSON object inside free text, parsed leniently."""
    said = F.concat(F.lit("answer: "), "props", F.lit(" thanks"))
    v = F.try_parse_json(F.regexp_extract(said, r"(?s)\{.*\}", 0))
    return _events(spark, sf_dir).select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"))
