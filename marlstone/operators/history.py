"""Windows over turns of conversations and rings of latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _newest(key: str, order: str):
    return Window.partitionBy(key).orderBy(F.col(order).desc())


def last_n(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The ``n`` latest rows of each key; Spark prunes to them before the shuffle (WindowGroupLimit)."""
    return df.withColumn("rn", F.row_number().over(_newest(key, order))).where(F.col("rn") <= n).drop("rn")


def trim_by_budget(df: DataFrame, key: str, order: str, size: Column, most: int, keep_one: bool = True, pinned: Column | None = None) -> DataFrame:
    """Rows from the newest on while their sizes add up to ``most``; pinned rows stay and are charged first."""
    fixed = F.lit(False) if pinned is None else pinned
    rows = df.withColumn("_fixed", fixed).withColumn("_size", size)
    w = _newest(key, order).rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.when(~F.col("_fixed"), F.col("_size")).otherwise(0)).over(w)
    held = F.sum(F.when(F.col("_fixed"), F.col("_size")).otherwise(0)).over(Window.partitionBy(key))
    free = F.sum(F.when(~F.col("_fixed"), 1).otherwise(0)).over(w)
    rows = rows.withColumn("_used", used + held).withColumn("_nth", free)
    fits = F.col("_used") <= most
    if keep_one:
        fits = fits | (F.col("_nth") == 1)
    return rows.where(F.col("_fixed") | fits).drop("_fixed", "_size", "_used", "_nth")


def carried(df: DataFrame, key: str, order: str, value: Column) -> DataFrame:
    """``df`` with ``carried``: the last non-null value before each row."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("carried", F.last(value, ignorenulls=True).over(w))


#: Microseconds of the ranges of time that ``gap_sessions`` looks at by themselves, and rows of a key from which on a range is cut.
RANGE, RANGE_ROWS = 86_400_000_000, 1_000_000


def gap_sessions(rows: DataFrame, key: str, us: str, gap: int) -> DataFrame:
    """``rows`` with ``session``: a number within ``key`` that goes up where a row comes ``gap`` microseconds or more after the one before it.

    Gaps are found within each day of each key, then between days by the days' first and last
    times, so a key that holds most rows is dealt by day; a day with more than RANGE_ROWS of a key is cut into as many more
    ranges. Rows without a time or key are left out.
    """
    r = rows.where(F.col(key).isNotNull() & F.col(us).isNotNull()).withColumn("_day", F.floor(F.col(us) / RANGE))
    full = r.groupBy(key, "_day").agg(F.count("*").alias("_n")).where(F.col("_n") > RANGE_ROWS).select(key, "_day", F.ceil(F.col("_n") / RANGE_ROWS).alias("_cuts"))
    r = r.join(full, [key, "_day"], "left").withColumn("_part", F.floor((F.col(us) - F.col("_day") * RANGE) * F.coalesce("_cuts", F.lit(1)) / RANGE)).drop("_cuts")
    part = Window.partitionBy(key, "_day", "_part").orderBy(us)
    r = r.withColumn("_new", (F.coalesce(F.col(us) - F.lag(us).over(part), F.lit(0)) >= gap).cast("int"))
    r = r.withColumn("_run", F.sum("_new").over(part.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = r.groupBy(key, "_day", "_part").agg(F.min(us).alias("_low"), F.max(us).alias("_high"), F.max("_run").alias("_runs"))
    w = Window.partitionBy(key).orderBy("_day", "_part")
    apart = F.coalesce((F.col("_low") - F.lag("_high").over(w) >= gap).cast("int"), F.lit(0))
    ranges = ranges.withColumn("_apart", apart)
    before = F.sum(F.col("_apart") + F.col("_runs")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_runs")
    ranges = ranges.select(key, "_day", "_part", before.alias("_base"))
    return r.join(ranges, [key, "_day", "_part"]).withColumn("session", F.col("_base") + F.col("_run")).drop("_day", "_part", "_new", "_run", "_base")
