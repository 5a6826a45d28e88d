"""SimHash fingerprints, pigeonring candidate search and near-duplicate components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import connected_components, materialize

BITS = 64
#: Segments of a fingerprint from the lowest bit: (shift, width).
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
MAX_DISTANCE = 4
#: Fingerprints of one bucket that a task compares with each other; larger buckets are cut into blocks of this many.
BLOCK = 4096
#: Tasks among which the fingerprints of one component are dealt when they look its smallest id up.
SALTS = 16


def fingerprint_bytes(text: bytes | None, k: int = 4) -> bytes:
    """The fingerprint of a UTF-8 text, big-endian: words between ASCII white space, A-Z lowered, k-word shingles."""
    words = (text or b"").lower().split()  # bytes: only ASCII letters and white space count
    if not words:
        return bytes(8)
    joined, n = b" ".join(words), max(1, len(words) - k + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(k, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, stops)])
    ones = np.zeros(BITS, np.int64)
    bits = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    for i in range(0, n, 65536):
        ones += np.unpackbits(bits[i : i + 65536], axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """``id_col`` and ``fp``, the fingerprint as a signed long, for every row.

    Null, empty and blank texts get zero. Other columns, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary() if pa.types.is_large_string(b.schema.field(1).type) else pa.binary())
            fps = b"".join(fingerprint_bytes(t.as_py(), k) for t in texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.frombuffer(fps, ">i8").astype(np.int64))], ["id", "fp"])

    ship(docs.sparkSession)
    ids = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", ids), T.StructField("fp", T.LongType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _part(shift: int, width: int):
    return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def parts_for(rows: int) -> int:
    """Parts into which the second segment of a chain is cut: more of them make longer keys, so buckets stay small."""
    return 2 if rows <= 1 << 26 else 4 if rows <= 1 << 30 else 13


def ring_keys(fps: DataFrame, parts: int = 2) -> DataFrame:
    """``key``, ``fp``: 5 x ``parts`` bucket keys for each fingerprint.

    A pair within 4 bits has, on the ring of five segments, a segment where it differs in 0 bits
    and in at most 1 over that and the next, so it agrees in that segment and in all but one
    of any parts of the next. Key parts*i+h holds segment i and all but part h of segment i+1;
    its lowest 8 bits are that number.
    """
    keys = []
    for i, (s, w) in enumerate(SEGMENTS):
        s2, w2 = SEGMENTS[(i + 1) % len(SEGMENTS)]
        cuts = [round(h * w2 / parts) for h in range(parts + 1)]
        for h in range(parts):
            others = ((1 << w2) - 1) & ~(((1 << cuts[h + 1]) - 1) & ~((1 << cuts[h]) - 1))
            rest = _part(s2, w2).bitwiseAND(F.lit(others).cast("long"))
            key = F.shiftleft(_part(s, w), 13).bitwiseOR(rest)
            keys.append(F.shiftleft(key, 8).bitwiseOR(F.lit(parts * i + h).cast("long")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


#: Bits of the chain's first so many segments, by the segment that it starts from, and the differences that it may have there.
CHAINS = np.array([[sum(((1 << w) - 1) << s for s, w in (SEGMENTS[(i + j) % len(SEGMENTS)] for j in range(n))) for n in range(1, len(SEGMENTS) + 1)] for i in range(len(SEGMENTS))], np.uint64)
BUDGETS = [n * MAX_DISTANCE // len(SEGMENTS) for n in range(1, len(SEGMENTS) + 1)]


def chain(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Indices of the differences ``x`` = a ^ b that keep to the chain's budget at each segment from ``start`` on.

    Each segment drops what is over its budget before the next is looked at; the last budget,
    over all segments, is the full Hamming check of what is left.
    """
    at = np.arange(len(x))
    for n, most in enumerate(BUDGETS):
        at = at[np.bitwise_count(x[at] & CHAINS[start[at], n]) <= most]
    return at


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links a-b with as few links as connect the same nodes: (node, smallest node that it reaches)."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = flat[: len(a)], flat[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[out], nodes[label[out]]


def _pairs(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, blk: np.ndarray, fp: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by (key, lo, hi): the group's rows, or block lo against block hi."""
    change = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    first = np.concatenate([[0], np.flatnonzero(change) + 1, [len(key)]])
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(key))  # rows of the group from here on
    bits, start = fp.view(np.uint64), (key & 255) // parts
    found: list[tuple[np.ndarray, np.ndarray]] = []
    size, s, active = 0, 1, np.flatnonzero(left > 1)
    while len(active):
        i = active[(lo[active] == hi[active]) | (blk[active] != blk[active + s])]
        i = i[chain(bits[i] ^ bits[i + s], start[i])]
        found.append((fp[i], fp[i + s]))
        size += len(i)
        if size > 500_000:
            found = [forest(*map(np.concatenate, zip(*found)))]
            size = len(found[0][0])
        s += 1
        active = active[left[active] > s]
    if not size:
        return fp[:0], fp[:0]
    return forest(*map(np.concatenate, zip(*found)))


def near_links(fps: DataFrame, block: int = BLOCK, parts: int = 2) -> DataFrame:
    """``src``, ``dst``: links that connect the same fingerprints as all pairs within 4 bits.

    fps: distinct ``fp``. Rows meet by bucket (keys are longer with more ``parts``); a bucket of more than ``block`` rows is cut into
    blocks by a hash, each pair of blocks in a group of its own. A group returns a spanning
    forest of its links, so rows out never grow with the square of a bucket.
    """
    keyed = ring_keys(fps, parts)
    large = keyed.groupBy("key").count().where(F.col("count") > block)
    large = large.select("key", F.ceil(F.col("count") / block).cast("int").alias("n"))
    cut = keyed.join(large, "key", "left").withColumn("blk", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("n")), F.lit(0)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1))
    rows = cut.select("key", "fp", "blk", other.alias("t"))
    rows = rows.select("key", F.least("blk", "t").alias("lo"), F.greatest("blk", "t").alias("hi"), "blk", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def links(cols: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _pairs(*cols, parts)], ["src", "dst"])

        for b in batches:
            cols = [c.to_numpy() for c in b.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            if not len(cols[0]):
                continue
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            cutoff = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0  # the last group may go on
            if cutoff:
                yield links([c[:cutoff] for c in cols])
            held = [c[cutoff:] for c in cols]
        if held is not None and len(held[0]):
            yield links(held)

    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return rows.mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """``id_col``, ``fp``, ``component_id`` for every row.

    Equal fingerprints are one node; component_id is the smallest id that links within 4 bits
    reach, the row's own included. Null ids never become a component_id (null where a
    component has no other). Repeated rows get a row each, an empty table gives none. Texts are
    fingerprinted whole, however long. A fingerprint that very many rows share is split by
    Spark's skew join.
    """
    prints = materialize(simhash(docs, id_col, text_col, k), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("first_id")), "nodes")
    roots = connected_components(near_links(nodes.select("fp"), parts=parts_for(nodes.count())))
    placed = materialize(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")), "placed")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    lowest = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("first_id").alias("component_id")).select("root", "component_id", salts)
    linked = placed.where("root IS NOT NULL").join(lowest, ["root", "salt"]).select("fp", "component_id")
    placed = placed.where("root IS NULL").select("fp", F.col("first_id").alias("component_id")).union(linked)
    return prints.join(placed, "fp").select(id_col, "fp", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """The rows of ``docs`` with one row of each component left: that with its smallest id.

    Of rows that repeat that id, the one with the smallest text stays (null counts as empty).
    Rows without an id belong to no component that could be named, and all stay. Texts are
    shuffled once, by id, at every size: the ids that stay grow with the rows, so they are
    never broadcast.
    """
    found = near_duplicates(docs, id_col, text_col, k)
    counted = found.where(F.col(id_col) == F.col("component_id")).groupBy(F.col(id_col).alias("_kept_id")).count()
    keep = materialize(counted.withColumnRenamed("count", "_times"), "kept-ids")
    kept = docs.join(keep.select("_kept_id").hint("merge"), docs[id_col] == keep["_kept_id"], "left_semi")
    again = keep.where("_times > 1").select("_kept_id")
    if not again.isEmpty():
        repeats = kept.join(again, kept[id_col] == again["_kept_id"], "left_semi")
        smallest = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.coalesce(text_col, F.lit("")))
        one = repeats.groupBy(id_col).agg(smallest.alias("_row")).select("_row.*")
        kept = kept.join(again, kept[id_col] == again["_kept_id"], "left_anti").unionByName(one)
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
