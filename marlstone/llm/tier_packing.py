"""Packing into windows of several lengths: documents by tier, gaps of long windows filled from shorter tiers, steps of equal size."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import materialize
from .packing import word_ids

#: Window lengths, powers of two.
TIERS = (256, 512, 1024, 2048, 4096)
END_ID = 2
#: Tokens that a task packs together, and tokens of a step, whose windows are all of one length.
BUFFER, STEP = 1 << 22, 1 << 16

Piece = tuple[int, int, int]  # document, start, length


class Pool:
    """Pieces waiting, by length."""

    def __init__(self, most: int):
        self.of: list[list[tuple[int, int]]] = [[] for _ in range(most + 1)]
        self.lengths: list[int] = []

    def add(self, doc: int, start: int, length: int) -> None:
        if not self.of[length]:
            insort(self.lengths, length)
        self.of[length].append((doc, start))

    def take(self, at: int) -> Piece:
        length = self.lengths[at]
        doc, start = self.of[length].pop()
        if not self.of[length]:
            self.lengths.pop(at)
        return doc, start, length


def plan(pieces: list[Piece], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full windows (length, pieces in order), and what is left over, shorter than one window.

    A piece belongs to the shortest tier that holds it. From the longest tier on, each of its
    pieces opens a window; the longest waiting piece that fits is put behind it, whole,
    until none fits; the rest of the gap is cut from the head of the longest piece waiting. So
    every window is full, and has one piece at most that was cut for it. Pieces longer than the
    longest tier are cut into its windows first, without a gap.
    """
    most, pool, made = tiers[-1], Pool(tiers[-1]), []
    for doc, start, length in pieces:
        for _ in range(length // most):
            made.append((most, [(doc, start, most)]))
            start += most
        if length % most:
            pool.add(doc, start, length % most)
    for shorter, size in zip((0, *tiers[:-1])[::-1], tiers[::-1]):
        while pool.lengths and pool.lengths[-1] > shorter:
            window = [pool.take(-1)]
            room = size - window[0][2]
            while room and pool.lengths:
                at = bisect_right(pool.lengths, room) - 1
                if at >= 0:
                    window.append(pool.take(at))
                else:
                    doc, start, length = pool.take(-1)
                    window.append((doc, start, room))
                    pool.add(doc, start + room, length - room)
                room -= window[-1][2]
            if room:
                return made, window
            made.append((size, window))
    return made, []


def tail(pieces: list[Piece]) -> list[tuple[int, list[Piece]]]:
    """Windows without padding for pieces of any sum: a power of two for each of its binary digits, the largest first."""
    made, rest = [], sum(p[2] for p in pieces)
    waiting = pieces[::-1]
    while rest:
        size = room = 1 << (rest.bit_length() - 1)
        window = []
        while room:
            doc, start, length = waiting.pop()
            if length > room:
                waiting.append((doc, start + room, length - room))
                length = room
            window.append((doc, start, length))
            room -= length
        made.append((size, window))
        rest -= size
    return made


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, step: int = STEP) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step, step_at``: a row for each piece of each document.

    A document is its ids and the end id. Each task packs what it reads, BUFFER tokens at a
    time; what fills no window waits for the next ones, and what is left in the end goes into
    windows of smaller powers of two. So every sequence is as long as its ``tier``, nothing is
    padded, and no text or id is ever shuffled. Sequences of a tier are numbered over all
    tasks and dealt into steps of ``step`` tokens; only the last step of a tier is smaller. Run by
    ``step_at``, which spreads the steps of each tier evenly from 0 to 1, every stretch of training has the same mix
    of lengths. Null and empty texts are the end id alone; repeated rows are packed each; null ids stay;
    an empty table gives no row; other columns are not read. A task holds BUFFER tokens, or one
    text's, if those are more.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids_of, end = word_ids(vocabulary), np.array([end_id], "<u4").tobytes()
        of_tier: dict[int, int] = {}
        held: list[tuple[int | None, bytes]] = []
        pieces: list[Piece] = []
        sequence = tokens = 0

        def placed(last: bool) -> pa.RecordBatch:
            nonlocal held, pieces, sequence, tokens
            made, left = plan(pieces, tiers)
            if last:
                made, left = made + tail(left), []
            rows = []
            for size, window in made:
                nth, offset = of_tier.get(size, 0), 0
                of_tier[size] = nth + 1
                for doc, start, length in window:
                    doc_id, ids = held[doc]
                    rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, part << 40 | sequence, offset, size, nth))
                    offset += length
                sequence += 1
            kept = sorted({p[0] for p in left})
            pieces = [(bisect_left(kept, doc), start, length) for doc, start, length in left]
            held, tokens = [held[i] for i in kept], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(names))], names)

        for b in batches:
            for at in range(0, b.num_rows, 256):
                texts = [t or "" for t in b.column(1).slice(at, 256).to_pylist()]
                for doc_id, ids in zip(b.column(0).slice(at, 256).to_pylist(), ids_of.encode(texts)):
                    ids += end
                    pieces.append((len(held), 0, len(ids) // 4))
                    held.append((doc_id, ids))
                    tokens += len(ids) // 4
                if tokens >= BUFFER:
                    yield placed(False)
        yield placed(True)

    ship(docs.sparkSession)
    pieces = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, ", ".join(f"{n} long" for n in names))
    pieces = materialize(pieces.withColumn("part", F.shiftright("sequence_id", 40)), "tier-pieces")
    counts = materialize(pieces.groupBy("part", "tier").agg((F.max("nth") + 1).alias("n")), "tier-counts")  # a few rows a task
    before = Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "tier", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    each = F.floor(F.lit(step) / F.col("tier"))
    steps = counts.groupBy("tier").agg(F.ceil(F.sum("n") / F.first(each)).alias("steps"))  # a row a tier
    rows = pieces.join(base, ["part", "tier"]).join(F.broadcast(steps), "tier").withColumn("step", F.floor((F.col("base") + F.col("nth")) / each))
    return rows.select(*names[:-1], "step", ((F.col("step") + 0.5) / F.col("steps")).alias("step_at"))
