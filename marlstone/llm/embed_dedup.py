"""Embedding near-duplicates by NN-descent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import Latest, connected_components, groups, materialize

THRESHOLD = 0.93
#: Neighbours in a node's list at first, and up to which the lists that are full of links grow.
NEIGHBOURS, MOST_NEIGHBOURS = 10, 40
#: How much longer full lists become at a time.
GROWTH = 4
#: Hyperplane tables that the first lists come from, and at most; rounds of refinement at most for each length of lists.
TABLES, MOST_TABLES, ROUNDS = 6, 48, 2
#: Rows of a leaf of the first graph, on average and at most; rows of a block of exact comparisons.
LEAF, MOST_IN_LEAF, BLOCK = 64, 512, 1024
#: Nodes compared with their whole label in one pass over it.
QUERY_BLOCK = 8192
#: Refinement ends when fewer entries than this share of all change.
SETTLED = 0.002
#: Recall of the audit at which no more tables are added.
RECALL = 0.97
#: By how much a cosine of rounded vectors may miss the true one.
MARGIN = 0.01
SEED = 20240229

#: ``old`` tells the entries of lists that were there a round before.
_EDGE = "src long, dst long, sim float, old boolean"


def _rounded(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of 8-bit bytes as unit vectors of single precision."""
    x = np.frombuffer(b"".join(vectors.to_pylist()), np.int8).reshape(len(vectors), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _units(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of lists of one length as unit vectors of double precision."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def floor_of(threshold: float) -> float:
    """The least cosine of two nodes that both link with a third: what is farther apart can not lead to a link."""
    return 2 * threshold * threshold - 1 - MARGIN if threshold > 0 else -2.0


def _top(src: np.ndarray, dst: np.ndarray, sim: np.ndarray, old: np.ndarray, k: int) -> list[np.ndarray]:
    """The ``k`` most similar ``dst`` of each ``src``, each once; of equal ones the smallest."""
    pair = np.lexsort((~old, dst, src))
    src, dst, sim, old = src[pair], dst[pair], sim[pair], old[pair]
    again = np.zeros(len(src), bool)
    again[1:] = (src[1:] == src[:-1]) & (dst[1:] == dst[:-1])
    src, dst, sim, old = src[~again], dst[~again], sim[~again], old[~again]
    order = np.lexsort((dst, -sim, src))
    src = src[order]
    keep = np.arange(len(src)) - np.searchsorted(src, src, "left") < k
    order = order[keep]
    return [src[keep], dst[order], sim[order], old[order]]


def _edges(src, dst, sim, old) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(np.asarray(sim, np.float32)), pa.array(old)], ["src", "dst", "sim", "old"])


def _columns(b: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in b.columns]


def _key(label, vector):
    """128 bits by which rows find the node of their label and vector."""
    vector = F.transform(vector, lambda x: x + F.lit(0.0))  # no negative zeros
    return F.struct(F.xxhash64(label, vector).alias("a"), F.xxhash64(F.lit(1), vector, label).alias("b"))


def nodes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``node, label, copies, key, dim, v, q``: each distinct usable vector of each label once, named by its smallest id.

    ``v`` is the vector (single precision if it was), ``q`` its unit vector rounded to 8 bits a component.
    """
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    single = vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType())
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    found = rows.where(usable & F.col("id").isNotNull()).groupBy("label", "v").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    found = found.select("node", "label", "copies", _key(F.col("label"), F.col("v").cast("array<double>")).alias("key"), F.size("v").alias("dim"), "v")

    def rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, out = b.column(4).to_numpy(), [b""] * b.num_rows
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = _units(b.column(5).take(pa.array(at)))
                q = np.rint(x / np.abs(x).max(1, keepdims=True) * 127).astype(np.int8).tobytes()
                for i, start in zip(at.tolist(), range(0, len(q), dim)):
                    out[i] = q[start : start + dim]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "q"])

    return found.mapInArrow(rounded, T.StructType([*found.schema.fields, T.StructField("q", T.BinaryType())]))


def _leaves(points: DataFrame, tables: range) -> DataFrame:
    """A row for each point and table: ``leaf`` (a hash of label, table, code and a salt if the leaf is large), ``node``, ``q``.

    Codes are made twice, first alone to count leaves, so vectors are moved once.
    """
    sizes = points.groupBy("label", "dim").count().select("label", "dim", F.greatest(F.lit(0), F.ceil(F.log2(F.col("count") / LEAF))).cast("int").alias("bits"))
    rows = points.join(sizes, ["label", "dim"]).select("label", "node", "q", "dim", "bits")

    def code(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            planes: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                dims, bits = b.column(3).to_numpy(), b.column(4).to_numpy()
                parts = [np.flatnonzero(dims == dim) for dim in np.unique(dims).tolist()]
                units = [_rounded(b.column(2).take(pa.array(at))) for at in parts]
                for t in tables:
                    codes = np.zeros(b.num_rows, np.int64)
                    for at, x in zip(parts, units):
                        dim = x.shape[1]
                        if (t, dim) not in planes:
                            planes[t, dim] = np.random.default_rng((SEED, t, dim)).standard_normal((dim, 40)).astype(np.float32)
                        sides = (x @ planes[t, dim] > 0).astype(np.int64)
                        codes[at] = (sides << np.arange(40)).sum(1) & ((1 << bits[at].astype(np.int64)) - 1)
                    cols = [b.column(0), b.column(3), pa.array(np.full(b.num_rows, t, np.int32)), pa.array(codes)]
                    yield pa.RecordBatch.from_arrays([*cols, b.column(1), b.column(2)] if whole else cols, names if whole else names[:4])

        return run

    names = ["label", "dim", "t", "code", "node", "q"]
    large = rows.mapInArrow(code(False), "label string, dim int, t int, code long").groupBy("label", "dim", "t", "code").count().where(F.col("count") > MOST_IN_LEAF)
    large = large.select("label", "dim", "t", "code", F.ceil(F.col("count") / MOST_IN_LEAF).cast("int").alias("parts"))
    coded = rows.mapInArrow(code(True), "label string, dim int, t int, code long, node long, q binary")
    salt = F.pmod(F.xxhash64("node", "t"), F.coalesce("parts", F.lit(1)))
    return coded.join(large, ["label", "dim", "t", "code"], "left").select(F.xxhash64("label", "dim", "t", "code", salt).alias("leaf"), "node", "q")


def first_graph(points: DataFrame, tables: range, floor: float, k: int = NEIGHBOURS) -> DataFrame:
    """``src, dst, sim``: the nearest of each node in the leaves it falls in, as far as ``floor``."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["leaf"]):
            if len(g) > 1:
                yield from _within(g.column("node").to_numpy(), _rounded(g.column("q")), floor, k)

    leaves = _leaves(points, tables).repartition("leaf").sortWithinPartitions("leaf")
    return nearest(leaves.mapInArrow(near, _EDGE), k)


def _within(ids: np.ndarray, x: np.ndarray, floor: float, k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` nearest of each of some nodes among the others, as far as ``floor``. A node that stands there again counts once."""
    ids, first = np.unique(ids, return_index=True)
    x = x[first]
    sims = x @ x.T
    np.fill_diagonal(sims, -3)
    i, j = np.nonzero(sims >= floor)
    if len(i):
        yield _edges(*_top(ids[i], ids[j], sims[i, j], np.zeros(len(i), bool), k))


def nearest(edges: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The ``k`` nearest of each ``src``; tasks reduce what they hold to that first, before it is shuffled and after each batch."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _edges(*_top(*_columns(b), k))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            cols = _columns(b)
            if held is not None:
                cols = [np.concatenate(c) for c in zip(held, cols)]
            if not len(cols[0]):
                continue
            cols = _top(*cols, k)
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            if cut:
                yield _edges(*(c[:cut] for c in cols))
            held = [c[cut:] for c in cols]
        if held is not None and len(held[0]):
            yield _edges(*held)

    return edges.mapInArrow(some, _EDGE).repartition("src").sortWithinPartitions("src").mapInArrow(best, _EDGE)


def refine(graph: DataFrame, points: DataFrame, floor: float, k: int = NEIGHBOURS, around: DataFrame | None = None) -> DataFrame:
    """One round: around each node (of ``around``, if given) its neighbours, and the nearest of those it is a neighbour of, are compared with each other."""
    back = nearest(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim", "old"), k)
    met = graph.select("src", "dst").union(back.select("src", "dst")).union(graph.select("src", F.col("src").alias("dst")))
    if around is not None:
        met = met.join(around, "src", "left_semi")
    rows = met.join(points.select("node", "q"), F.col("dst") == F.col("node")).select("src", "dst", "q")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["src"]):
            yield from _within(g.column("dst").to_numpy(), _rounded(g.column("q")), floor, k)

    rows = rows.repartition("src").sortWithinPartitions("src")
    return nearest(graph.withColumn("old", F.lit(True)).union(rows.mapInArrow(meet, _EDGE)), k)


def descend(graph: DataFrame, points: DataFrame, floor: float, k: int, table: Latest, rounds: int = ROUNDS, around: DataFrame | None = None) -> DataFrame:
    """Rounds of ``refine``, until lists settle; after the first only around nodes whose lists changed."""
    for i in range(rounds):
        graph = table.put(refine(graph, points, floor, k, around))
        fresh = graph.where("NOT old")
        if i + 1 == rounds or fresh.count() <= SETTLED * graph.count():
            return graph
        around = fresh.select("src").union(fresh.select(F.col("dst").alias("src"))).distinct()
    return graph


def verified(graph: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """``src < dst``: the graph's edges whose cosine in double precision reaches the threshold."""
    pairs = graph.where(F.col("sim") > threshold - MARGIN).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    a, b = (points.select(F.col("node").alias(c), F.col("v").alias(f"{c}_v")) for c in ("src", "dst"))
    rows = pairs.join(a, "src").join(b, "dst").select("src", "dst", F.size("src_v").alias("dim"), "src_v", "dst_v")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                r = b.filter(pa.array(dims == dim))
                ok = np.einsum("ij,ij->i", _units(r.column(3)), _units(r.column(4))) >= threshold
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in r.columns[:2]], ["src", "dst"])

    return rows.mapInArrow(check, "src long, dst long")


def saturated(graph: DataFrame, threshold: float, k: int) -> DataFrame:
    """``node``: those whose lists are full of links, so that more of them may be missing."""
    return graph.where(F.col("sim") > threshold - MARGIN).groupBy(F.col("src").alias("node")).count().where(F.col("count") >= k).select("node")


def exact_links(points: DataFrame, own: DataFrame, threshold: float) -> DataFrame:
    """``node, links, of_full, low``: links of the nodes of ``own`` (``node, full``) with all nodes of their label, in blocks.

    All nodes of a label are sent once for each QUERY_BLOCK of those asked for, which a task takes BLOCK at a time.
    A row for each node and pair of blocks in which it has links: their number, weighted by copies,
    that of those with nodes whose ``full`` is set, and the smallest node that they reach. A node
    outside ``own`` gets its links with nodes of it. A task holds two blocks and returns sums,
    never pairs.
    """
    every = points.select(F.xxhash64("label", "dim").alias("grp"), "node", "copies", "v").join(own.withColumn("chosen", F.lit(True)), "node", "left")
    every = every.withColumn("full", F.coalesce("full", F.lit(False))).withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    blocks = lambda n, size: F.ceil(n / size).cast("int")
    sizes = every.groupBy("grp").agg(blocks(F.count("*"), BLOCK).alias("of_all"), blocks(F.count_if("chosen"), QUERY_BLOCK).alias("of_own")).where("of_own > 0")
    every = every.join(sizes, "grp")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    row = ("node", "copies", "full", "chosen", "v")
    left = every.where("chosen").select("grp", place("of_own").alias("lo"), others("of_all").alias("hi"), F.lit(True).alias("left"), *row)
    right = every.select("grp", others("of_own").alias("lo"), place("of_all").alias("hi"), F.lit(False).alias("left"), *row)

    def links(x: np.ndarray, s: np.ndarray, t: np.ndarray, own: np.ndarray, others: np.ndarray, copies: np.ndarray, full: np.ndarray, chosen: np.ndarray) -> pa.RecordBatch:
        most = np.iinfo(np.int64).max
        near = (x[own] @ x[others].T >= threshold) & (s[:, None] != t)
        low_s, low_t = s, t
        while True:
            new_s = np.minimum(low_s, np.where(near, low_t, most).min(1))
            new_t = np.minimum(low_t, np.where(near, new_s[:, None], most).min(0))
            if (new_s == low_s).all() and (new_t == low_t).all():
                break
            low_s, low_t = new_s, new_t
        found = np.concatenate([near @ copies[others], np.where(chosen[others], 0, copies[own] @ near)])
        of_full = np.concatenate([near @ np.where(full[others], copies[others], 0), np.zeros(len(t), np.int64)])
        some = np.concatenate([near.any(1), near.any(0)])
        cols = (np.concatenate([s, t])[some], found[some].astype(np.int64), of_full[some].astype(np.int64), np.concatenate([low_s, low_t])[some])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["node", "links", "of_full", "low"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["grp", "lo", "hi"]):
            asked, ids, copies, full, chosen = (g.column(c).to_numpy() for c in ("left", "node", "copies", "full", "chosen"))
            asked, full, chosen = asked.astype(bool), full.astype(bool), chosen.astype(bool)
            own, others = np.flatnonzero(asked), np.flatnonzero(~asked)
            if len(own) and len(others):
                x = _units(g.column("v"))
                for i in range(0, len(own), BLOCK):
                    part = own[i : i + BLOCK]
                    yield links(x, ids[part], ids[others], part, others, copies, full, chosen)

    rows = left.union(right).repartition("grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi")
    return rows.mapInArrow(count, "node long, links long, of_full long, low long")


def recall(audited: DataFrame, exact: DataFrame, edges: DataFrame, points: DataFrame) -> float:
    """Share of all links of the nodes of ``audited`` (``node, full``) that lists have or that a node with a full list finds."""
    sums = exact.groupBy("node").agg(F.sum("links").alias("links"), F.sum("of_full").alias("of_full"))
    ends = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).join(audited.select("node"), F.col("src") == F.col("node"), "left_semi")
    listed = ends.join(points.select(F.col("node").alias("dst"), "copies"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("copies").alias("listed"))
    each = audited.join(sums, "node").join(listed, "node", "left")
    found = F.when(F.col("full"), F.col("links")).otherwise(F.col("of_full") + F.coalesce("listed", F.lit(0)))
    all_links, have = each.agg(F.sum("links"), F.sum(found)).first()
    return have / all_links if all_links else 1.0


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Vectors are compared within a label (and length) only. Those that are null, empty, zero or
    hold null or non-finite components, and those without a label or id, link with nothing.
    Equal vectors of a label are one node with so many copies; of equally near neighbours the
    smaller ids come first in a list. First lists come from hyperplane tables and keep
    neighbours within twice the angle of a link; NN-descent rounds refine them. A list that is full of
    links grows, with a round around its node, until it is not full or MOST_NEIGHBOURS long; nodes whose lists are still full are compared with their whole label. In the same
    pass all vectors whose id is divisible by 50 are, which gives the recall of the lists:
    under RECALL the tables are doubled, up to MOST_TABLES, and after that every node is
    compared with its whole label. Rows that repeat an id are rows of their own: each has the
    links of its vector. An empty table gives no rows; other columns are not read.
    """
    ship(vectors.sparkSession)
    points = materialize(nodes(vectors, id_col, vector_col, label_col), "points")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), _key(F.col(label_col).cast("string"), F.col(vector_col).cast("array<double>")).alias("key"))
    rows = rows.withColumn("key", F.when(F.col("vec_id").isNotNull(), F.col("key")))
    queries = points.select("node", "key").join(rows.where("vec_id % 50 = 0").select("key"), "key", "left_semi").select("node")
    floor, graph, tables, table = floor_of(threshold), None, range(0, TABLES), Latest("graph")
    while True:
        k = NEIGHBOURS
        new = first_graph(points, tables, floor, k)
        graph = table.put(new if graph is None else nearest(graph.union(new), MOST_NEIGHBOURS))
        graph = descend(graph, points, floor, k, table)
        full = materialize(saturated(graph, threshold, k), "full")
        while k < MOST_NEIGHBOURS and not full.isEmpty():
            k *= GROWTH
            graph = descend(graph, points, floor, k, table, 1, full.select(F.col("node").alias("src")))
            full = materialize(saturated(graph, threshold, k), "full")
        marked = full.withColumn("full", F.lit(True))
        own = materialize(queries.join(marked, "node", "left").select("node", F.coalesce("full", F.lit(False)).alias("full")).union(marked).distinct(), "own")
        outside = graph.join(full, graph["src"] == full["node"], "left_anti").join(full.select(F.col("node").alias("other")), F.col("dst") == F.col("other"), "left_anti")
        edges = materialize(verified(outside, points, threshold), "links")
        many = materialize(exact_links(points, own, threshold), "exact-links")
        if recall(own.join(queries, "node", "left_semi"), many, edges, points) >= RECALL:
            break
        if tables.stop >= MOST_TABLES:
            own = points.select("node", F.lit(True).alias("full"))
            many = materialize(exact_links(points, own, threshold), "exact-links")
            break
        tables = range(tables.stop, 2 * tables.stop)
    weights = points.select("node", "copies")
    ends = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    ends = ends.join(own, F.col("src") == F.col("node"), "left_anti").join(own, F.col("dst") == F.col("node"), "left_anti")
    few = ends.join(weights, F.col("dst") == F.col("node")).select(F.col("src").alias("node"), F.col("copies").alias("links"))
    links = few.union(many.select("node", "links")).groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(edges.union(many.select(F.col("low").alias("src"), F.col("node").alias("dst"))))
    each = points.select("node", "copies", "key").join(links, "node", "left").join(roots, "node", "left")
    each = each.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    own_id = F.coalesce("component_id", "vec_id")
    out = rows.join(each, "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own_id.alias("component_id"), F.coalesce(F.col("vec_id") == own_id, F.lit(True)).alias("kept"))
