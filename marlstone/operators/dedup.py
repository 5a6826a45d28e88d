"""Deduplication, set operations and mutation of tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[Column], order: Column) -> DataFrame:
    """The row with the smallest ``order`` (a unique column) of each key. Rows of one key meet in partial minima, not in a window."""
    row = F.struct(*[F.col(c) for c in df.columns])
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    return df.groupBy(*named).agg(F.min_by(row, order).alias("_row")).select("_row.*")


def upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` replaces the rows of ``base`` with its keys, and adds the others."""
    return base.join(new.select(key), key, "left_anti").select(*base.columns).unionByName(new.select(*base.columns))


def replace_partition(base: DataFrame, new: DataFrame, column: str, value) -> DataFrame:
    """``new`` in place of the rows of ``base`` whose ``column`` is ``value``."""
    return base.where(~F.col(column).eqNullSafe(F.lit(value))).unionByName(new)


def union_in_order(stages: list[DataFrame], key: str) -> DataFrame:
    """Rows of all stages, each key from the first stage that has it."""
    staged = reduce(DataFrame.unionByName, [s.withColumn("stage", F.lit(i)) for i, s in enumerate(stages)])
    return keep_first(staged, [F.col(key)], F.col("stage"))


def two_key_dedup(df: DataFrame, first: str, second: str, order: str, by: str) -> DataFrame:
    """Rows, in order within ``by``, whose first key is new and then whose second key is new among rows kept.

    A row dropped for its first key never registers its second, so the first row of each second
    key among the first rows of each first key is what a fold over rows in order keeps.
    """
    rows = df.select(by, first, second, order)
    for key in (first, second):
        rows = keep_first(rows, [F.col(by), F.col(key)], F.col(order))
    return rows


def reprocessed(catalog: DataFrame, files: DataFrame, key: str, file_key: str, least: int = 180, force: bool = False) -> DataFrame:
    """``key, state, chars`` of each entry of a catalogue (``key, text, method``) once it was looked through.

    An entry without a method or with a text under ``least`` characters, or every one if
    ``force``, takes the new text of its file (``file_key, new_text``): ``improved`` if that is
    longer, else ``reprocessed``; ``failed`` without a file. Others are ``kept``.
    """
    rows = catalog.join(files, catalog[key] == files[file_key], "left")
    needs = F.lit(force) | F.col("method").isNull() | (F.length(F.trim("text")) < least)
    state = F.when(~needs, "kept").when(F.col(file_key).isNull(), "failed").when(F.length("new_text") > F.length("text"), "improved").otherwise("reprocessed")
    chars = F.when(state.isin("improved", "reprocessed"), F.length("new_text")).otherwise(F.length("text"))
    return rows.select(key, state.alias("state"), chars.cast("long").alias("chars"))


def without_pattern(rows: DataFrame, key: str, pattern: str) -> DataFrame:
    """Rows whose ``key`` is not of a pattern, in which * stands for any text and ? for one sign. Null keys stay."""
    regex = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return rows.where(~F.coalesce(F.col(key).rlike(f"(?s)^{regex}$"), F.lit(False)))
