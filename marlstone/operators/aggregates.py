"""Aggregates over logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import line_shape


def nearest_rank(values: Column, p: float) -> Column:
    """The value at index round((n-1)p), half to even, of an array; 0 for an empty one."""
    at = F.bround((F.size(values) - 1) * p, 0).cast("int") + 1
    return F.when(F.size(values) == 0, F.lit(0.0)).otherwise(F.try_element_at(F.sort_array(values), at))


def status_group(code: Column) -> Column:
    """1xx and 3xx count as 2xx."""
    return F.when(code >= 500, "5xx").when(code >= 400, "4xx").otherwise("2xx")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part * 100.0 / whole, 2))


def repeated_edges(pages: DataFrame, doc: str, lines: str, share: float = 0.45, edge: int = 4, chars: int = 4) -> DataFrame:
    """``doc, shapes``: shapes of lines that stand among the first or last ``edge`` lines of two pages or more, and of a ``share`` of all pages, of a document.

    Shapes of fewer than ``chars`` characters don't count. A page has 2 ``edge`` of them at most, so a document
    has at most 2 ``edge`` / ``share``.
    """
    ends = F.concat(F.slice(lines, 1, edge), F.slice(F.reverse(lines), 1, edge))
    shapes = F.array_distinct(F.filter(F.transform(ends, line_shape), lambda x: F.length(x) >= chars))
    total = pages.groupBy(doc).agg(F.count("*").alias("_pages"))
    found = pages.select(doc, F.explode(shapes).alias("_shape")).groupBy(doc, "_shape").agg(F.count("*").alias("_n"))
    often = found.where("_n >= 2").join(total, doc).where(F.col("_n") / F.col("_pages") >= share)
    return often.groupBy(doc).agg(F.collect_set("_shape").alias("shapes"))


def without_headers(pages: DataFrame, doc: str, lines: str, share: float = 0.45) -> DataFrame:
    """``pages`` without the lines, anywhere in them, that have the shape of a header or footer which the pages of a document repeat."""
    found = pages.join(repeated_edges(pages, doc, lines, share), doc, "left")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.coalesce("shapes", F.array().cast("array<string>")), line_shape(x)))
    return found.withColumn(lines, kept).drop("shapes")


def session_sketches(events: DataFrame, key: str, ts: str) -> DataFrame:
    """``day, sketch``: a mergeable sketch of the distinct keys of each day; partial sketches meet, never the keys."""
    return events.where(F.col(key).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.hll_sketch_agg(key, F.lit(12)).alias("sketch"))


def sessions_between(sketches: DataFrame, first: str, last: str) -> DataFrame:
    """``live``: about how many distinct keys the days from ``first`` to ``last`` have, 1.6 % off as a rule; events are not read again."""
    days = sketches.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return days.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("live"))


def live_sessions(events: DataFrame, key: str, ts: str, days: int) -> DataFrame:
    """``day, live``: the exact number of distinct keys seen on each day or in the ``days`` - 1 before it; days without an event have no row.

    A key counts on the days up to ``days`` behind each of its own, so each of its days is sent to so many.
    """
    own = events.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.to_date(ts).alias("day")).distinct()
    there = own.select("day").distinct()
    ahead = own.select("_key", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("_n"), "day").select("_key", F.date_add("day", F.col("_n")).alias("day")).distinct()
    return ahead.join(there, "day").groupBy("day").agg(F.count("*").alias("live"))


def with_figures(rows: DataFrame, figures: DataFrame) -> DataFrame:
    """``rows`` with the columns of a table of one row."""
    return rows.join(F.broadcast(figures.limit(1)))
