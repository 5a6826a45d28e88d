"""Helpers shared by the training-data operators: shared-folder tables and graph components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Latest, materialize, scratch_path, shared_dir

__all__ = ["Latest", "connected_components", "groups", "id_hash", "materialize", "scratch_path", "shared_dir"]


def id_hash(col: str) -> Column:
    """crc32 of an id written as text; null ids hash like the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as ``src``, ``dst`` (long).

    Returns ``node``, ``root`` for each node with an edge to another node; the root is the
    smallest node of its component. Alternates large-star and small-star steps; each is a
    partial minimum per node and an equi-join with it, so no neighbour list is ever gathered.
    Rows with a null end and self loops count for nothing.
    """
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    ).distinct()
    table = Latest("edges")
    e = table.put(e)
    last = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = table.put(small.union(m.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        last = now
    raise RuntimeError("components did not settle")


def groups(batches, keys: list[str]):
    """Groups of consecutive rows with equal (non-null, numeric) ``keys``, as Arrow tables; a group may span batches."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        cols = [t.column(k).to_numpy() for k in keys]
        change = np.zeros(len(t) - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(t)]
        now = tuple(c[0] for c in cols)
        if held and tuple(held[-1].column(k)[-1].as_py() for k in keys) != now:
            yield pa.concat_tables(held)
            held = []
        for i, j in zip(cuts[:-2], cuts[1:-1]):
            held.append(t.slice(i, j - i))
            yield pa.concat_tables(held)
            held = []
        held.append(t.slice(cuts[-2]))
    if held:
        yield pa.concat_tables(held)
