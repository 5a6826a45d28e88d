"""Sources and sinks: JSON catalogues, text files, configuration, NDJSON, logs, keyed caches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def read_catalog(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A catalogue of records: one file with a JSON array, or a folder that write_catalog made. None there: an empty one. Unknown fields are dropped."""
    fs, where = _file_system(spark, path)
    if not fs.exists(where):
        return spark.createDataFrame([], schema)
    one_file = fs.getFileStatus(where).isFile()
    return spark.read.schema(schema).option("multiLine", one_file).option("mode", "DROPMALFORMED").json(path)


def write_catalog(df: DataFrame, path: str) -> None:
    """Replaces ``path``: written beside it first and then renamed, so it may be read from the same path."""
    staged = f"{path}-{uuid.uuid4().hex}"
    df.write.json(staged)
    fs, old = _file_system(df.sparkSession, path)
    _, new = _file_system(df.sparkSession, staged)
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"could not rename {staged} to {path}")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``source_id, text``: each file one text."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1).alias("source_id"), F.col("value").alias("text"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``file_name, bytes, kind, entries``: JSON documents of any shape, profiled without a schema."""
    raw = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    v = F.try_parse_json("value")
    rows = raw.select(F.col("_metadata.file_name").alias("file_name"), F.length("value").cast("long").alias("bytes"), v.alias("v"), "value")
    shape = F.schema_of_variant("v")
    kind = F.when(F.col("v").isNull(), "invalid_json").when(shape.startswith("ARRAY"), "array").when(shape.startswith("OBJECT"), "object").otherwise("scalar")
    entries = F.when(kind == "array", F.json_array_length("value")).when(kind == "object", F.size(F.json_object_keys("value"))).otherwise(0)
    return rows.select("file_name", "bytes", kind.alias("kind"), entries.cast("long").alias("entries"))


def section_texts(df: DataFrame, column: str) -> DataFrame:
    """``section, text`` of a map of lists: a heading and a dashed line for each item; empty sections go."""
    rows = df.select(F.explode(column).alias("section", "items")).where(F.size("items") > 0)
    return rows.select("section", F.concat(F.lit("## "), "section", F.lit("\n- "), F.array_join("items", "\n- ")).alias("text"))


def write_ndjson(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


def append_log(df: DataFrame, path: str) -> None:
    """Appends conversation rows that have a session, a question and an answer; languages lower-cased, latencies at least 0."""
    ok = df
    for c in ("session_id", "question", "response"):
        ok = ok.where(F.trim(F.coalesce(c, F.lit(""))) != "")
    ok.withColumn("lang", F.lower("lang")).withColumn("latency_ms", F.greatest("latency_ms", F.lit(0))).write.mode("append").parquet(path)


def cache_read(entries: DataFrame, now: float) -> DataFrame:
    """``key, value, age`` of the entries that are the last of their key and have not expired."""
    last = entries.groupBy("key").agg(F.max_by(F.struct("value", "created_at", "expires_at"), "created_at").alias("e")).select("key", "e.*")
    return last.where(F.col("expires_at") > now).select("key", "value", F.greatest(F.lit(0.0), F.lit(now) - F.col("created_at")).alias("age"))
