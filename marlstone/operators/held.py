"""Queries that every task holds: dealt into parts of a bounded size, their answers merged."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

#: Parts into which the candidates of one query are dealt before the last selection.
SALTS = 256


def parts(rows: DataFrame, size: Column, most: int) -> Iterator[list[Row]]:
    """All rows of a table of queries, about ``most`` bytes at a time, by a hash of their columns."""
    n = -(-(rows.agg(F.sum(size)).first()[0] or 0) // most)
    for i in range(n):
        some = rows if n == 1 else rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(n)) == i)
        if held := some.collect():
            yield held


def in_parts(rows: DataFrame, size: Column, most: int, answer: Callable[[list[Row]], DataFrame], schema: str) -> DataFrame:
    """What ``answer`` makes of each part, one after the other."""
    out = rows.sparkSession.createDataFrame([], schema)
    for held in parts(rows, size, most):
        out = out.unionByName(answer(held))
    return out


def best_of_tasks(top: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """``top`` with ``rank``: the ``n`` first rows of each group, of which each task sends a few; they are merged in two steps, so few meet at once."""
    for keys in ([group, F.spark_partition_id() % SALTS], [group]):
        top = top.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
    return top


def named(top: DataFrame, number: str, name: str, names: list, kind: str = "long") -> DataFrame:
    """``top`` with the names of its numbers, a bounded list."""
    own = top.sparkSession.createDataFrame(list(enumerate(names)), f"{number} long, {name} {kind}")
    return top.join(F.broadcast(own), number).drop(number)
