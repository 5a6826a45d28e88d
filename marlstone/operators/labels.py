"""Texts matched to the labels of a catalogue, of any size, by containment."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..session import ship
from .held import parts

#: Bytes of labels that tasks hold together.
LABEL_BYTES = 1 << 24


class Catalogue:
    """Labels in order, found in texts by one automaton for whole labels and one for their words; texts in labels by a search of all labels end to end."""

    def __init__(self, names: list[str]):
        import ahocorasick

        self.starts, self.every, at = [], "\0".join(names), 0
        self.whole, self.words = ahocorasick.Automaton(ahocorasick.STORE_INTS), ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, name in enumerate(names):
            self.starts.append(at)
            at += len(name) + 1
            for automaton, keys in ((self.whole, [name]), (self.words, name.split())):
                for key in keys:
                    if key and key not in automaton:
                        automaton.add_word(key, i)
        for automaton in (self.whole, self.words):
            automaton.make_automaton()
        self.blank = next((i for i, name in enumerate(names) if not name), None)

    @staticmethod
    def _first(automaton, text: str) -> int | None:
        return min((i for _, i in automaton.iter(text)), default=None) if len(automaton) else None

    def find(self, text: str) -> tuple[int, int] | None:
        """(0, the first label that holds the text or stands in it), else (1, the first with a word in it), else None."""
        at = self.every.find(text) if "\0" not in text and self.starts else -1
        held = None if at < 0 else bisect_right(self.starts, at) - 1
        found = [i for i in (held, self._first(self.whole, text), self.blank) if i is not None]
        if found:
            return 0, min(found)
        word = self._first(self.words, text)
        return None if word is None else (1, word)


def label_of(rows: DataFrame, key: str, text: str, labels: DataFrame) -> DataFrame:
    """``key, place``: the place of the label (``place, name``, places unique and in order) that each text means; texts that mean none have no row.

    Both are compared in lower case, texts trimmed. The first label that contains the text or stands in it; else
    the first with a word that stands in it. Tasks hold LABEL_BYTES of labels at a time; the best of all parts
    counts. Null texts, keys and names mean nothing.
    """
    ship(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()
    texts = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, F.lower(F.trim(text)).alias("_t"))
    names = labels.where("place IS NOT NULL AND name IS NOT NULL").select(F.col("place").cast("long").alias("place"), F.lower("name").alias("name"))

    def search(held: list[Row]) -> DataFrame:
        held = sorted(held, key=lambda r: r["place"])
        places, own = [r["place"] for r in held], [r["name"] for r in held]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            catalogue = Catalogue(own)
            for b in batches:
                found = [(k, *hit) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (hit := catalogue.find(t)) is not None]
                cols = [[x[0] for x in found], [x[1] for x in found], [places[x[2]] for x in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.schema.field(0).type, pa.int32(), pa.int64()))], [key, "tier", "place"])

        return texts.mapInArrow(run, f"{key} {kind}, tier int, place long")

    out = rows.sparkSession.createDataFrame([], f"{key} {kind}, tier int, place long")
    for held in parts(names, F.octet_length("name") + 16, LABEL_BYTES):
        out = out.unionByName(search(held))
    best = out.groupBy(key).agg(F.min(F.struct("tier", "place")).alias("b"))
    return best.select(key, F.col("b.place").alias("place"))
