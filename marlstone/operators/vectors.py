"""Nearest vectors by cosine for whole tables of queries: blocks multiplied, a few best kept in each task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..session import ship
from .held import best_of_tasks, in_parts, named

#: Bytes of query vectors that tasks hold together, and cosines that are computed at once.
QUERY_BYTES, CELLS = 1 << 26, 1 << 22
#: Decimals of a cosine: what differs beyond is equal, and goes by id.
DECIMALS = 6


def matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of unit length, in double precision, and which of a column's values they are: those of ``dims`` finite numbers, not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == dims)
    x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    norm = np.sqrt((x * x).sum(1))
    ok = np.isfinite(norm) & (norm > 0)
    return x[ok] / norm[ok, None], at[ok]


class Nearest:
    """The ``k`` nearest rows so far of each of some queries: by cosine, then by id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.sims: list[np.ndarray] = [np.zeros(0)] * len(queries)
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        self.least = np.full(len(queries), -np.inf)

    def add(self, x: np.ndarray, ids: np.ndarray, own: np.ndarray | None = None) -> None:
        """Offers rows to all queries, or to those of the numbers ``own``."""
        own = np.arange(len(self.queries)) if own is None else own
        step = max(1, CELLS // max(1, len(own)))
        for i in range(0, len(x), step):
            sims = np.round(self.queries[own] @ x[i : i + step].T, DECIMALS)
            rows, cols = np.nonzero(sims >= self.least[own, None])
            cuts = np.flatnonzero(np.diff(rows, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(rows)]):
                q, c = own[rows[a]], cols[a:b]
                s, d = np.concatenate([self.sims[q], sims[rows[a], c]]), np.concatenate([self.ids[q], ids[i + c]])
                best = np.lexsort((d, -s))[: self.k]
                self.sims[q], self.ids[q] = s[best], d[best]
                if len(best) == self.k:
                    self.least[q] = s[best[-1]]

    def batch(self) -> pa.RecordBatch:
        q = np.repeat(np.arange(len(self.ids)), [len(x) for x in self.ids])
        ids, sims = (np.concatenate(x) if x else np.zeros(0) for x in (self.ids, self.sims))
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids.astype(np.int64)), pa.array(sims)], ["q", "id", "sim"])


def held_vectors(asked: list[Row]) -> tuple[list, np.ndarray]:
    """Names and unit vectors of the queries that have one, of as many dimensions as the first of them."""
    dims = next((len(r["vector"]) for r in asked if r["vector"]), 0)
    if any(r["vector"] is not None and len(r["vector"]) != dims for r in asked):
        raise ValueError("query vectors differ in their dimensions")
    x, at = matrix(pa.array([r["vector"] for r in asked], pa.list_(pa.float64())), dims) if dims else (np.zeros((0, 1)), [])
    return [asked[i]["query_id"] for i in at], x


def knn(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, id_col, sim, rank``: the ``k`` rows nearest to each query (``query_id, vector``) by cosine, equal ones by id.

    One pass over the vectors for QUERY_BYTES of queries: a task multiplies its rows with all
    queries, block by block, and sends on ``k`` rows a query. Rows and queries that are null, zero, not
    finite or, rows, of other dimensions are near nothing; queries of several dimensions are an error.
    """
    ship(vectors.sparkSession)
    kind = queries.schema["query_id"].dataType.simpleString()

    def search(asked: list[Row]) -> DataFrame:
        names, q = held_vectors(asked)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = Nearest(q, k)
            for b in batches:
                x, at = matrix(b.column(1), q.shape[1])
                near.add(x, b.column(0).to_numpy(zero_copy_only=False)[at])
            yield near.batch()

        found = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")).mapInArrow(run, "q long, id long, sim double")
        top = best_of_tasks(found, "q", [F.desc("sim"), F.col("id")], k)
        return named(top, "q", "query_id", names, kind).select("query_id", F.col("id").alias(id_col), "sim", "rank")

    size = F.coalesce(F.size("vector"), F.lit(0)) * 8 + 16
    return in_parts(queries.select("query_id", F.col("vector").cast("array<double>")), size, QUERY_BYTES, search, f"query_id {kind}, {id_col} long, sim double, rank int")
