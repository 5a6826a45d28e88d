"""Best-fit packing of tokenised documents with exact-complement hashing."""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import materialize

CAPACITY = 4096
END_ID = 1
#: Words whose ids a task keeps; at that many it starts anew, so memory stays bounded.
WORDS_KEPT = 800_000
#: Signs that the tokenizer never joins with letters before them.
SIGNS = ".,;:!?#$%&*)]}\"|"
#: New pieces that are encoded as one text, and signs that may stand between them.
TOGETHER, MARKS = 64, "✈☃♞☀"
#: Salts by which rows of one length are ranked apart from each other, at least, and rows for which there is one more.
SALTS, ROWS_OF_SALT = 256, 2_000_000

_tokenizers: dict = {}

Sequences = tuple[tuple[tuple[int, int], ...], int]  # ((length, copies), ...), how many like this


class WordIds:
    """Ids of texts by a tokenizer whose tokens never cross ASCII white space, which it drops.

    Each white-space-delimited piece is then encoded by itself, with the same ids as in its
    text, and kept as little-endian 32-bit ids. Of a piece of letters with signs behind
    them, letters and signs are encoded by themselves; A-Z are lower-cased either way. The
    tokenizer looks for its added tokens before it lower-cases, so a text that holds one in any
    case is left as it is. New pieces are encoded TOGETHER at a time, with a sign between them
    that has an id of its own; those that hold that sign themselves, one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        ids = lambda w: self.tokenizer.encode(w, add_special_tokens=False).ids
        self.mark = next((c for c in MARKS if len(ids(c)) == 1 and ids(f"a {c} b") == ids("a") + ids(c) + ids("b")), None)
        self.mark_id = self.mark and ids(self.mark)[0]

    def lowered(self, text: str) -> str:
        low = text.lower() if text.isascii() else text.encode().lower().decode()
        return text if any(a in low for a in self.added) else low

    def learn(self, words: list[str]) -> None:
        alone = [w for w in words if self.mark is None or self.mark in w]
        for i in range(0, len(alone), 10_000):
            for w, e in zip(alone[i : i + 10_000], self.tokenizer.encode_batch_fast(alone[i : i + 10_000], add_special_tokens=False)):
                self.known[w] = array("I", e.ids).tobytes()
        rest = [w for w in words if w not in self.known] if alone else words
        groups = [rest[i : i + TOGETHER] for i in range(0, len(rest), TOGETHER)]
        for i in range(0, len(groups), 100):
            some = groups[i : i + 100]
            for group, e in zip(some, self.tokenizer.encode_batch_fast([f" {self.mark} ".join(g) for g in some], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                data, at = ids.tobytes(), (4 * np.flatnonzero(ids == self.mark_id)).tolist()
                for w, a, b in zip(group, [0, *(x + 4 for x in at)], [*at, len(data)], strict=True):
                    self.known[w] = data[a:b]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.lowered(t).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        parts, whole = [], set()
        for w in set(chain.from_iterable(split)).difference(known):
            letters = w.rstrip(SIGNS)
            if letters != w and letters.isalpha():
                parts.append((w, letters, w[len(letters) :]))
            else:
                whole.add(w)
        whole.update(x for p in parts for x in p[1:] if x not in known)
        self.learn(list(whole))
        for w, letters, signs in parts:
            known[w] = known[letters] + known[signs]
        return [b"".join(map(known.__getitem__, words)) for words in split]


def word_ids(path: str) -> WordIds:
    """One for each worker process and vocabulary file."""
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def tokenize(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: ``doc_id, piece, start, length, ids_crc32`` (and ``ids``, binary).

    A document is its ids and the end id; only one over ``capacity`` is cut, into pieces of
    ``capacity`` and a rest. Null texts are empty ones: the end id alone. Repeated rows get
    their pieces each; an empty table gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end, step = word_ids(vocabulary), np.array([END_ID], "<u4").tobytes(), 4 * capacity
        for b in batches:
            for at in range(0, b.num_rows, 256):
                docs_ids, out = b.column(0).slice(at, 256).to_pylist(), []
                for doc, ids in zip(docs_ids, ids_of.encode([t or "" for t in b.column(1).slice(at, 256).to_pylist()])):
                    ids += end
                    for piece, i in enumerate(range(0, len(ids), step)):
                        part = ids[i : i + step]
                        out.append((doc, piece, i // 4, len(part) // 4, zlib.crc32(part), part))
                cols = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(cols, names)

    names, kinds = ["doc_id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    if with_ids:
        names, kinds, schema = [*names, "ids"], [*kinds, pa.binary()], f"{schema}, ids binary"
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, schema)


def exact_fills(left: np.ndarray, capacity: int, parts: int) -> list[Sequences]:
    """Sequences without a gap, taken from the pieces ``left`` of each length: from the longest on, each filled by up to ``parts`` others."""
    made: list[Sequences] = []

    def take(*lengths: int) -> bool:
        need: dict[int, int] = defaultdict(int)
        for x in lengths:
            need[x] += 1
        times = min(int(left[x]) // k for x, k in need.items())
        if times:
            for x, k in need.items():
                left[x] -= k * times
            made.append((tuple(need.items()), times))
        return times > 0

    if left[capacity]:
        take(capacity)
    for length in range(capacity - 1, 0, -1) if parts else ():
        gap = capacity - length
        if left[length] and left[gap]:
            take(length, gap)
        while parts > 1 and left[length]:
            low = np.flatnonzero(left[: gap // 2 + 1])
            low = low[left[gap - low] > 0]
            if not any(take(length, int(gap - a), int(a)) for a in low.tolist()):
                break
        while parts > 2 and left[length]:
            used = False
            for a in np.flatnonzero(left[:gap])[::-1].tolist():
                rest = gap - a
                low = np.flatnonzero(left[: min(rest // 2, a) + 1])
                low = low[(rest - low <= a) & (left[rest - low] > 0)]
                if any(take(length, a, int(rest - b), int(b)) for b in low.tolist()):
                    used = True
                    break
                if a * 3 < gap or not left[length]:
                    break
            if not used:
                break
    return made


def best_fit(left: np.ndarray, capacity: int) -> list[Sequences]:
    """Sequences for all pieces ``left`` of each length, the longest first, each put where the least room remains."""
    room: dict[int, list[Sequences]] = defaultdict(list)
    rooms: list[int] = []

    def put(pattern: tuple, times: int, space: int) -> None:
        if space not in room or not room[space]:
            insort(rooms, space)
        room[space].append((pattern, times))

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                space, pattern, times = capacity, (), n
            else:
                space = rooms[at]
                pattern, times = room[space].pop()
                if not room[space]:
                    rooms.pop(at)
            copies = min(space // length, n)
            full = min(times, n // copies)
            put((*pattern, (length, copies)), full, space - copies * length)
            n -= full * copies
            if pattern and times > full:
                put(pattern, times - full, space)
    return [x for some in room.values() for x in some]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Sequences]:
    """Sequences for so many pieces of each length: (((length, copies), ...), how many sequences like this).

    From the longest length on, sums of one, two and three lengths that fill the gap exactly
    are looked up among the lengths still available and consumed as often as all of them
    last; what then remains is packed best-fit, longest first. Where short pieces are few, sums of
    many of them leave long gaps to the rest, so the same is done with sums of two, of one and of no
    lengths, and the plan of fewest sequences counts: none is worse than best fit alone. Driver
    memory is bounded by ``capacity`` lengths.
    """
    best: list[Sequences] | None = None
    least = -(-sum(length * n for length, n in counts.items()) // capacity)
    for parts in (3, 2, 1, 0):
        left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            left[length] = n
        made = exact_fills(left, capacity, parts)
        made += best_fit(left, capacity)
        if best is None or sum(t for _, t in made) < sum(t for _, t in best):
            best = made
        if sum(t for _, t in best) == least:
            break
    return best


def slots(made: list[Sequences]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the piece with rank r among its length goes: sorted ``length << 40 | first rank``, first sequence, offset."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, times in made:
        offset = 0
        for length, copies in pattern:
            for _ in range(copies):
                rows.append((length << 40 | used[length], sequence, offset))
                used[length] += times
                offset += length
        sequence += times
    key, first, offset = (np.array(c, np.int64) for c in (zip(*sorted(rows)) if rows else ((), (), ())))
    return key, first, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (``doc_id, piece, start, length, ids_crc32``) with ``sequence_id`` and ``offset``.

    The driver gets a count for each length (``capacity`` rows at most) and plans; each row
    finds its place by its rank among rows of its length, which is counted by salt, so a
    length that a third of all rows share is ranked by many tasks. Lengths must be from 1 to
    ``capacity``. Equal rows are ranked in any order; their places are as good. Rows
    without an id are packed like others; no pieces, no rows.
    """
    pieces = materialize(pieces, "pieces")
    salts = max(SALTS, pieces.count() // ROWS_OF_SALT)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = materialize(pieces.groupBy("salt", "length").count(), "length-counts")
    key, first, offset = slots(plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("salt", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))  # a row for each salt and length
    rank = F.row_number().over(Window.partitionBy("salt", "length").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = pieces.withColumn("rank", rank).join(base, ["salt", "length"]).withColumn("rank", F.col("rank") - 1 + F.col("base"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(key, length << 40 | rank, "right") - 1
            sequence = first[at] + rank - (key[at] & ((1 << 40) - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset[at])], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
