"""Stretches of a text that repeat themselves: aligned blocks matched by an automaton over word numbers, extended exactly."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: A run repeats its period so many times at least, and has so many words at least.
TIMES, LEAST = 4, 6
#: Words looked at together, unless one text alone has more; and words of the blocks of one automaton, unless one block has more.
CHUNK, KEYS = 1 << 20, 1 << 18
#: Words of the grams that tell where larger blocks can repeat.
GRAM = 4

Run = tuple[int, int, int]


def stretches(near: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of at least ``least`` true values."""
    edges = np.flatnonzero(np.diff(near.astype(np.int8), prepend=0, append=0))
    start, end = edges[::2], edges[1::2]
    long = end - start >= least
    return start[long], end[long]


def gram_distances(w: np.ndarray) -> np.ndarray:
    """For each position of a gram of GRAM words, how far back the same gram stands (or one of the same hash); far where it is new."""
    n = max(0, len(w) - GRAM + 1)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = (h ^ w[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    out = np.full(n, np.iinfo(np.int64).max)
    out[order[1:][same]] = (order[1:] - order[:-1])[same]
    return out


def candidates(w: np.ndarray, block: int, far: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Stretches that the repeats of any run with a period from ``block`` to 2 ``block`` - 1 lie in, and the words of the grams compared.

    Behind its first period each gram of a run stands at most a period further back, too.
    """
    if block == 1:
        near = np.zeros(len(w), bool)
        near[1:] = w[1:] == w[:-1]
        return *stretches(near, LEAST - 1), 1
    if block == 2:
        pair = w[:-1] << 32 | w[1:]
        near = np.zeros(len(pair), bool)
        for d in (1, 2, 3):
            near[d:] |= pair[d:] == pair[:-d]
        return *stretches(near, (TIMES - 1) * block - 1), 2
    return *stretches(far < 2 * block, (TIMES - 1) * block - GRAM + 1), GRAM


def block_matches(w: np.ndarray, lo: int, hi: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of an aligned block within [lo, hi) and a place where it occurs again ``block`` to 2 ``block`` - 1 words later.

    The blocks are the keys of an automaton that reads the words behind them; among the
    ``block`` distances asked for, a place has one aligned block only.
    """
    import ahocorasick

    each = max(1, KEYS // block) * block
    for first in range(-(-lo // block) * block, hi - block + 1, each):
        stop = min(first + each, hi // block * block)
        own = tuple(w[first:stop].tolist())
        numbers: dict[tuple, int] = {}
        key_of = [numbers.setdefault(own[i : i + block], len(numbers)) for i in range(0, len(own), block)]
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for key, number in numbers.items():
            automaton.add_word(key, number)
        automaton.make_automaton()
        begin = first + block
        found = list(automaton.iter(tuple(w[begin : min(hi, stop + 2 * block)].tolist())))
        if found:
            place, number = np.array(found, np.int64).T
            place += begin - block + 1
            at = (place - block) // block * block
            ok = (at >= first) & (at < stop)
            ok[ok] = np.array(key_of)[(at[ok] - first) // block] == number[ok]
            yield at[ok], place[ok]


def extended(w: np.ndarray, at: int, d: int) -> tuple[int, int]:
    """The longest stretch around ``at`` in which words ``d`` apart are identical, from steps that double."""
    high, step, end = at, 64, len(w) - d
    while high < end:
        k = min(step, end - high)
        bad = w[high : high + k] != w[high + d : high + d + k]
        if bad.any():
            high += int(bad.argmax())
            break
        high, step = high + k, min(2 * step, CHUNK)
    low, step = at, 64
    while low:
        k = min(step, low)
        bad = w[low - k : low] != w[low - k + d : low + d]
        if bad.any():
            low -= int(bad[::-1].argmax())
            break
        low, step = low - k, min(2 * step, CHUNK)
    return low, high + d


def primitive(period: np.ndarray) -> bool:
    """Whether a sequence is no power of a shorter one."""
    n, rest, f = len(period), len(period), 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            if (period[n // f :] == period[: n - n // f]).all():
                return False
            while rest % f == 0:
                rest //= f
        f += 1
    return True


def covered(runs: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether some run (rows of start, end, period) holds [start, end)."""
    if not len(runs):
        return np.zeros(len(start), bool)
    runs = runs[np.argsort(runs[:, 0])]
    i = np.searchsorted(runs[:, 0], start, "right") - 1
    return (i >= 0) & (np.maximum.accumulate(runs[:, 1])[i] >= end)


def new_seeds(runs: np.ndarray, at: np.ndarray, place: np.ndarray, block: int) -> np.ndarray:
    """Which matches may belong to a run not yet in ``runs``, those of shorter periods.

    A block of four or more periods of a run matches within it at multiples of its period, which
    make no other run. Where it matches in another run of the same period, a longer
    period maps start to start or end to end.
    """
    runs = runs[(runs[:, 2] * TIMES <= block) & (runs[:, 1] - runs[:, 0] >= block)] if block >= 8 else runs[:0]
    if not len(runs):
        return np.ones(len(at), bool)
    runs = runs[np.argsort(runs[:, 0])]  # two that hold a block in common would be one, so ends are in order too
    i, j = (np.searchsorted(runs[:, 0], x, "right") - 1 for x in (at, place))
    inside = (i >= 0) & (j >= 0) & (runs[i, 1] >= at + block) & (runs[j, 1] >= place + block)
    mapped = (i != j) & ((runs[j, 0] - runs[i, 0] == place - at) | (runs[j, 1] - runs[i, 1] == place - at))
    return ~inside | mapped


def find_runs(w: np.ndarray, longest: int) -> list[Run]:
    """(start, length, period) of every run of a sequence whose parts, divided by words of their own, have at most ``longest`` words; by start, then period."""
    found: dict[tuple[int, int], int] = {}
    far = gram_distances(w) if longest >= TIMES * GRAM else None
    block = 1
    while longest >= max(LEAST, TIMES * block):
        start, end, gram = candidates(w, block, far)
        runs = np.array([(s, e, d) for (s, d), e in found.items()], np.int64).reshape(-1, 3)
        if block >= GRAM:
            new = ~covered(runs, start, end)
            start, end = start[new], end[new]
        areas: list[list[int]] = []
        for s, e in zip((start - 2 * block + 1).clip(0).tolist(), (end + gram - 1).tolist()):
            if areas and s <= areas[-1][1]:
                areas[-1][1] = e
            else:
                areas.append([s, e])
        seeds: set[tuple[int, int]] = set()
        for lo, hi in areas:
            for at, place in block_matches(w, lo, min(hi, len(w)), block):
                new = new_seeds(runs, at, place, block)
                seeds.update(zip((place - at)[new].tolist(), at[new].tolist()))
        last, until = 0, 0
        for d, at in sorted(seeds):
            if d != last or at >= until:
                low, high = extended(w, at, d)
                last, until = d, high - d
                if high - low >= max(LEAST, TIMES * d) and primitive(w[low : low + d]):
                    found[low, d] = high
        block *= 2
    return sorted((s, e - s, d) for (s, d), e in found.items())


def runs_of_texts(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each of a few texts, given as their words."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = lambda: len(numbers) + len(texts)
    parts, starts, at = [], [], 0
    for i, words in enumerate(texts):  # each text ends in a number of its own, so no run crosses it
        parts += [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), np.array([i])]
        starts.append(at)
        at += len(words) + 1
    out: list[list[Run]] = [[] for _ in texts]
    runs = find_runs(np.concatenate(parts), max(map(len, texts))) if texts else []
    for (start, length, period), i in zip(runs, np.searchsorted(starts, [r[0] for r in runs], "right") - 1):
        out[i].append((start - starts[i], length, period))
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run holds behind its first period, joined by one space."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, runs (array of start, length, period), collapsed`` for every row; words are what stands between ASCII white space.

    A run is a stretch of LEAST words or more that repeats its smallest period TIMES times or more
    and that no neighbouring word extends; collapsed is the text with each run's first period
    alone. For periods from B to 2B - 1, B a power of two, the aligned blocks of B words are
    searched by an automaton; a block that occurs B to 2B - 1 words later is extended both ways
    as far as words that far apart are identical. Blocks are searched only where grams repeat
    near enough to belong to such a run, which leaves none out. Null, empty and blank texts
    have no run and collapse to the empty text; repeated rows get a row each; null ids stay; an empty
    table gives none; other columns are not read. A task holds the words of CHUNK words of text or of
    one text, if that is longer; the time a text takes grows about as its length times the
    logarithm of its longest period.
    """

    def answer(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = runs_of_texts(texts)
        offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
        rows = np.array([r for some in runs for r in some], np.int64).reshape(-1, 3)
        fields = pa.StructArray.from_arrays([pa.array(c) for c in rows.T], ["start", "length", "period"])
        text = pa.array([collapsed(t, r) for t, r in zip(texts, runs)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, fields), text], ["doc_id", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, held, n = 0, [], 0
            for i, text in enumerate(b.column(1)):
                held.append((text.as_py() or "").encode().split())  # of bytes: ASCII white space alone
                n += len(held[-1])
                if n >= CHUNK or i == b.num_rows - 1:
                    yield answer(b.column(0).slice(first, len(held)), held)
                    first, held, n = i + 1, [], 0

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
