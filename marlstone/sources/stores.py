"""Small stores that grow by appending: values by key with an expiry, tickets, flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import exists, materialize
from .files import cache_read

BUCKETS = 64
STATUS_PENDING = "pending"


class KeyValues:
    """Values by namespace and key under ``path``: entries are appended in buckets by key, and of a key the latest counts until it expires.

    A store that is not there yet misses every key.
    """

    SCHEMA = "ns string, key string, value string, created_at double, expires_at double, bucket int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def _bucket() -> Column:
        return F.pmod(F.xxhash64("ns", "key"), F.lit(BUCKETS)).cast("int").alias("bucket")

    def _append(self, rows: DataFrame, now: float, until: Column) -> None:
        rows = rows.where("ns IS NOT NULL AND key IS NOT NULL").select("ns", "key", "value", F.lit(float(now)).alias("created_at"), until.cast("double").alias("expires_at"), self._bucket())
        rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.path)

    def put(self, rows: DataFrame, now: float, ttl: float) -> None:
        """Sets ``ns, key, value``; of a key that comes twice the greatest value counts. ``now`` must grow from call to call."""
        self._append(rows.groupBy("ns", "key").agg(F.max("value").alias("value")), now, F.lit(now + ttl))

    def drop(self, keys: DataFrame, now: float) -> None:
        """Deletes ``ns, key``."""
        self._append(keys.select("ns", "key", F.lit(None).cast("string").alias("value")).distinct(), now, F.lit(0.0))

    def _entries(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], self.SCHEMA)

    def live(self, now: float) -> DataFrame:
        """``ns, key, value`` of all keys that have not expired."""
        last = cache_read(self._entries().withColumn("key", F.struct("ns", "key")), now)
        return last.select("key.ns", "key.key", "value")

    def get(self, keys: DataFrame, now: float) -> DataFrame:
        """``keys`` (``ns, key``) with ``value``, null on a miss."""
        return keys.join(self.live(now), ["ns", "key"], "left")

    def compact(self, now: float) -> None:
        """Rewrites the store with one entry for each live key."""
        last = self._entries().groupBy("ns", "key").agg(F.max_by(F.struct("value", "created_at", "expires_at"), "created_at").alias("e")).select("ns", "key", "e.*")
        kept = materialize(last.where(F.col("expires_at") > now).select("*", self._bucket()), "live-values")
        kept.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self.path)


def append_tickets(rows: DataFrame, path: str, at: Column) -> None:
    """Appends tickets for ``session_id, user_message, bot_response, reason, priority`` as JSON lines, pending, with an id of eight hex digits made from session, message and time."""
    blank = lambda c, default="": F.coalesce(F.col(c), F.lit(default)).alias(c)
    told = at.cast("string")
    key = F.substring(F.sha2(F.concat_ws("|", blank("session_id"), blank("user_message"), told), 256), 1, 8)
    rows.select(
        key.alias("id"), "session_id", blank("user_message"), blank("bot_response"), blank("reason", "low_confidence"), F.lit(STATUS_PENDING).alias("status"), blank("priority", "medium"),
        told.alias("created_at"), told.alias("updated_at"), F.lit("").alias("agent_notes"), F.lit("").alias("resolution"),
    ).write.mode("append").json(path)


TICKET = "id string, session_id string, user_message string, bot_response string, reason string, status string, priority string, created_at string, updated_at string, assigned_to string, agent_notes string, resolution string"


def read_tickets(spark: SparkSession, path: str) -> DataFrame:
    """All tickets; none where there is no store. Lines that are no ticket are left out."""
    return spark.read.schema(TICKET).option("mode", "DROPMALFORMED").json(path) if exists(spark, path) else spark.createDataFrame([], TICKET)


def append_flows(rows: DataFrame, path: str) -> None:
    """Appends flows that have a ``session_id``, a ``status`` and a ``flow_text``, trimmed; others are left out."""
    ok = rows.select(*[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("session_id", "status", "flow_text")])
    ok.where("session_id <> '' AND status <> '' AND flow_text <> ''").write.mode("append").parquet(path)
