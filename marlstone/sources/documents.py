"""JSON documents by name, in buckets of which a change rewrites only those it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import exists, materialize, remove

BUCKETS = 64


def safe_name(name: Column) -> Column:
    """Whether a name is that of a JSON file and of no path: no separators, no leading dot, ``.json`` at the end."""
    return F.coalesce(name.rlike(r"^[^/\\\x00.][^/\\\x00]*\.json$") & ~F.contains(name, F.lit("..")), F.lit(False))


def whole_body(body: Column) -> Column:
    """Whether a text is a JSON object or array."""
    kind = F.schema_of_variant(F.try_parse_json(body))
    return F.coalesce(F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY")), F.lit(False))


class JsonDocuments:
    """Documents under ``path``: ``name, body`` in folders by bucket, a hash of the name."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def stored(self) -> DataFrame:
        schema = "name string, body string, bucket int"
        return self.spark.read.schema(schema).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """``name, body`` with bodies as VARIANT."""
        return self.stored().select("name", F.parse_json("body").alias("body"))

    def get(self, name: str) -> DataFrame:
        """The document of a name; only its bucket is read."""
        bucket = self.spark.range(1).select(self._bucket(F.lit(name))).first()[0]
        return self.stored().where((F.col("bucket") == bucket) & (F.col("name") == name)).select("name", F.parse_json("body").alias("body"))

    def _bucket(self, name: Column) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(self.buckets)).cast("int")

    def merge(self, changes: DataFrame) -> DataFrame:
        """Stores the bodies of ``changes`` (``name, body``) and deletes the documents whose new body is null; of a name that comes twice the greatest body counts.

        Changes with an unsafe name or a body that is no JSON object or array change nothing; they
        are returned, as ``name, why``. Buckets without a change keep their files.
        """
        checked = changes.select("name", "body", F.when(~safe_name(F.col("name")), "name").when(F.col("body").isNotNull() & ~whole_body(F.col("body")), "body").alias("why"))
        good = checked.where("why IS NULL").groupBy("name").agg(F.max("body").alias("body")).withColumn("bucket", self._bucket(F.col("name")))
        good = materialize(good, "document-changes")
        touched = [r["bucket"] for r in good.select("bucket").distinct().collect()]  # self.buckets at most
        if touched:
            old = self.stored().where(F.col("bucket").isin(touched)).join(good.select("name"), "name", "left_anti")
            rows = materialize(old.select("name", "body", "bucket").unionByName(good.where("body IS NOT NULL")), "documents")
            left = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
            rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
            for bucket in set(touched) - left:
                remove(self.spark, f"{self.path}/bucket={bucket}")
        return checked.where("why IS NOT NULL").select("name", "why")
