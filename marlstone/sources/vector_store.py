"""A stored table of vectors in inverted lists: files by the nearest of some centroids, of which a search reads the nearest few."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.held import best_of_tasks, in_parts, named
from ..operators.vectors import QUERY_BYTES, Nearest, held_vectors, matrix
from ..scratch import exists, remove
from ..session import ship

#: Rows that centroids are fitted on; rounds of fitting; lists at most; rows of a file.
SAMPLE, ROUNDS, LISTS, ROWS_OF_FILE = 20_000, 10, 4096, 1_000_000
#: Share of the nearest rows that a search finds, unless it says how many lists to probe; measured on the sample.
SHARE = 0.95


def fit_centroids(x: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means over unit vectors; a centroid that loses all rows stays where it was."""
    lists = max(1, min(lists, len(x)))
    centres = x[np.random.default_rng(seed).permutation(len(x))[:lists]] if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(ROUNDS if len(x) else 0):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    return centres


def probes_for(x: np.ndarray, centres: np.ndarray, share: float = SHARE, queries: int = 200, k: int = 10) -> int:
    """So many of the lists nearest to a row hold a ``share`` of the ``k`` rows nearest to it, over some rows of a sample."""
    some = x[:queries]
    if not len(some):
        return 1
    sims = some @ x.T
    sims[np.arange(len(some)), np.arange(len(some))] = -np.inf
    near = np.argsort(-sims, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(some @ centres.T), axis=1), axis=1)  # of each list among those nearest to a row
    at = np.take_along_axis(place, (x @ centres.T).argmax(1)[near], axis=1)
    return int(np.quantile(at, share, method="higher")) + 1 if at.size else 1


class VectorStore:
    """Vectors under ``path``: their centroids, and rows in folders by list. Rows keep their other columns.

    A vector belongs to the list of its nearest centroid. Rows without a usable vector (null, zero, not
    finite) are stored, in list -1, and never found.
    """

    def __init__(self, spark: SparkSession, path: str, centroids: np.ndarray, probes: int, schema: T.StructType, id_col: str, vector_col: str):
        self.spark, self.path, self.centroids, self.probes, self.schema, self.id_col, self.vector_col = spark, path, centroids, probes, schema, id_col, vector_col

    @property
    def dims(self) -> int:
        return self.centroids.shape[1]

    @classmethod
    def create(cls, rows: DataFrame, path: str, lists: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> VectorStore:
        """A new store of ``rows``; centroids, the square root of the rows' number unless ``lists`` says how many, are fitted on SAMPLE rows. All vectors must have as many dimensions."""
        spark = rows.sparkSession
        if exists(spark, path):
            raise FileExistsError(path)
        n, dims = cls._checked(rows, vector_col, None)
        some = rows.where(F.col(vector_col).isNotNull()).select(F.col(vector_col).cast("array<double>").alias("v"), F.xxhash64(id_col).alias("h"))
        some = some.where(F.pmod("h", F.lit(1_000_000)) < 2_000_000 * SAMPLE / max(1, n)).orderBy("h", "v").limit(SAMPLE)
        x, _ = matrix(pa.array([r["v"] for r in some.collect()], pa.list_(pa.float64())), dims)
        centroids = fit_centroids(x, min(LISTS, lists or round(n**0.5) or 1))
        store = cls(spark, path, centroids, probes_for(x, centroids), rows.schema, id_col, vector_col)
        centres = [(i, c.tolist(), store.probes, rows.schema.json(), id_col, vector_col) for i, c in enumerate(centroids)]
        spark.createDataFrame(centres, "list int, centroid array<double>, probes int, schema string, id_col string, vector_col string").coalesce(1).write.parquet(f"{path}/centroids")
        store._write(rows)
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorStore:
        if not exists(spark, f"{path}/centroids"):
            raise FileNotFoundError(path)
        rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
        return cls(spark, path, np.array([r["centroid"] for r in rows]), rows[0]["probes"], T.StructType.fromJson(json.loads(rows[0]["schema"])), rows[0]["id_col"], rows[0]["vector_col"])

    @staticmethod
    def _checked(rows: DataFrame, vector_col: str, dims: int | None) -> tuple[int, int]:
        size = F.when(F.col(vector_col).isNotNull(), F.size(vector_col))
        n, low, high = rows.agg(F.count("*"), F.min(size), F.max(size)).first()
        if low != high or (dims is not None and low is not None and low != dims):
            raise ValueError(f"vectors of {low} to {high} dimensions, {dims or 'as many for all'} wanted")
        return n, low or dims or 1

    def add(self, rows: DataFrame) -> None:
        """Appends rows with the columns of the store; vectors of other dimensions are an error, and nothing is then written."""
        self._checked(rows, self.vector_col, self.dims)
        self._write(rows.select(*self.schema.names))

    def _write(self, rows: DataFrame) -> None:
        ship(self.spark)
        centroids, at = self.centroids, rows.columns.index(self.vector_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = np.full(b.num_rows, -1, np.int32)
                x, ok = matrix(b.column(at).cast(pa.list_(pa.float64())), centroids.shape[1])
                if len(x):
                    own[ok] = (x @ centroids.T).argmax(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own)], [*b.schema.names, "list"])

        dealt = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType())]))
        n = rows.count()
        salts = max(1, -(-n // ROWS_OF_FILE))  # a list that holds most rows is written by as many tasks
        dealt.repartition("list", F.pmod(F.xxhash64(self.id_col), F.lit(salts))).write.mode("append").partitionBy("list").parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("list", T.IntegerType())])).parquet(f"{self.path}/rows")

    def count(self) -> int:
        return self.rows().count()

    def reset(self) -> None:
        """Removes all rows; centroids, and with them the dimensions, stay."""
        remove(self.spark, f"{self.path}/rows")
        self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField("list", T.IntegerType())])).write.parquet(f"{self.path}/rows")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, where: str | None = None) -> DataFrame:
        """``query_id, id, sim, rank``: the ``k`` nearest of the rows in the ``probes`` lists nearest to each query (``query_id, vector``); as many as hold a SHARE of the nearest rows of a sample, if not given.

        Only the folders of those lists are read. With as many probes as lists, the result is exact.
        ``where`` picks rows by their columns first. Queries of other dimensions are an error.
        """
        kind, probes = queries.schema["query_id"].dataType.simpleString(), probes or self.probes

        def part(asked: list[Row]) -> DataFrame:
            names, q = held_vectors(asked)
            if len(q) and q.shape[1] != self.dims:
                raise ValueError(f"query vectors of {q.shape[1]} dimensions, {self.dims} wanted")
            near = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, :probes] if len(q) else np.zeros((0, 0), int)
            of: dict[int, list[int]] = {}
            for i, lists in enumerate(near.tolist()):
                for one in lists:
                    of.setdefault(one, []).append(i)
            asking = {one: np.array(own) for one, own in of.items()}

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                best = Nearest(q, k)
                for b in batches:
                    x, at = matrix(b.column(1), q.shape[1])
                    ids, own = b.column(0).to_numpy(zero_copy_only=False)[at], b.column(2).to_numpy(zero_copy_only=False)[at]
                    for one in np.unique(own).tolist():
                        best.add(x[own == one], ids[own == one], asking[one])
                yield best.batch()

            rows = self.rows().where(F.col("list").isin(sorted(asking)) & F.col(self.id_col).isNotNull())
            rows = rows if where is None else rows.where(where)
            found = rows.select(F.col(self.id_col).cast("long"), F.col(self.vector_col).cast("array<double>"), "list").mapInArrow(run, "q long, id long, sim double")
            top = best_of_tasks(found, "q", [F.desc("sim"), F.col("id")], k)
            return named(top, "q", "query_id", names, kind).select("query_id", F.col("id").alias(self.id_col), "sim", "rank")

        size = F.coalesce(F.size("vector"), F.lit(0)) * 8 + 16
        return in_parts(queries.select("query_id", F.col("vector").cast("array<double>")), size, QUERY_BYTES, part, f"query_id {kind}, {self.id_col} long, sim double, rank int")
