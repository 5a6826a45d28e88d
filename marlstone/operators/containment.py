"""Search by parts of words: how many words of a query, and whether its whole phrase, a text contains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.text import norm_local
from ..session import ship
from .held import best_of_tasks, in_parts, named

#: Bytes of queries that tasks hold together; more of them are searched in as many parts.
QUERY_BYTES = 1 << 24
#: Words of texts whose parts a task remembers, and signs up to which it does.
WORDS_KEPT, KEPT_CHARS = 400_000, 64
NO_ID = np.iinfo(np.int64).max


class Parts:
    """The words of some queries that stand in a word of a text, found in one pass over it."""

    def __init__(self, words: list[str]):
        import ahocorasick

        self.known: dict[str, tuple[int, ...]] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, w in enumerate(words):
            self.automaton.add_word(w, i)
        self.automaton.make_automaton()

    def within(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            found = tuple({i for _, i in self.automaton.iter(word)})
            if len(word) <= KEPT_CHARS:
                if len(self.known) >= WORDS_KEPT:
                    self.known.clear()
                self.known[word] = found
        return found

def snippet(text: str, norm: str, words: list[str], before: int = 220, size: int = 650, head: int = 700) -> str:
    """A piece of the text around where the first of the words that it contains stands in it once normalised; its head if that piece is blank."""
    at = next((p for p in (norm.find(w) for w in words) if p >= 0), 0)
    return text[max(0, at - before) : at + size].strip() or text[:head].strip()


def local_search(docs: DataFrame, queries: DataFrame, n: int, least: int = 4) -> DataFrame:
    """``item_id, doc_id, score, snippet``: the ``n`` documents of each query that contain most of it, equal scores by id.

    docs: ``doc_id, text``; queries: ``item_id, phrase``. Both are normalised; of a query count the words of
    ``least`` letters or more, all words if none is so long. Each that stands in the text, maybe
    within a longer word, scores 2, as often as the query has it; the whole phrase 4. Texts
    are read once: each task finds the words of all queries in the words of its texts, remembers
    those of words it has met, and keeps ``n`` documents a query. Tasks hold QUERY_BYTES of queries at a time; more
    are searched in parts. Null texts and queries contain and find nothing; rows that repeat a
    query are one; a document without an id comes last among equals.
    """
    ship(docs.sparkSession)
    asked = queries.select("item_id", norm_local(F.col("phrase")).alias("phrase")).where("phrase <> ''").distinct()
    schema = "item_id long, doc_id long, score long, snippet string"
    return in_parts(asked, F.octet_length("phrase") + 16, QUERY_BYTES, lambda held: _search(docs, held, n, least), schema)


def _search(docs: DataFrame, asked: list[Row], n: int, least: int) -> DataFrame:
    words: dict[str, int] = {}
    wanted = [[w for w in phrase.split(" ") if len(w) >= least] or phrase.split(" ") for _, phrase in asked]
    uses: list[tuple[list[int], list[int]]] = []  # queries of each word, and what it scores in them
    for q, own in enumerate(wanted):
        for w in own:
            if words.setdefault(w, len(words)) == len(uses):
                uses.append(([], []))
            queries_of, scores = uses[words[w]]
            if queries_of and queries_of[-1] == q:
                scores[-1] += 2
            else:
                queries_of.append(q)
                scores.append(2)
    full = np.array([2 * len(own) for own in wanted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_in, of, adds = Parts(list(words)), [np.array(u[0]) for u in uses], [np.array(u[1]) for u in uses]
        best: list[list[tuple[int, int, str]]] = [[] for _ in asked]
        bar, bar_id = np.ones(len(asked), np.int64), np.full(len(asked), NO_ID)
        for b in batches:
            for doc, text, norm in zip(b.column(0).fill_null(NO_ID).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if not norm:
                    continue
                hit: set[int] = set()
                for w in set(norm.split(" ")):
                    hit.update(found_in.within(w))
                if not hit:
                    continue
                score = np.bincount(np.concatenate([of[i] for i in hit]), np.concatenate([adds[i] for i in hit]), len(asked)).astype(np.int64)
                can = score + 4 * (score == full)
                for q in np.flatnonzero((can > bar) | ((can == bar) & (doc < bar_id))).tolist():
                    s = int(score[q])
                    if s == full[q] and asked[q][1] in norm:
                        s += 4
                    own = best[q]
                    if s and (len(own) < n or (-s, doc) < own[-1][:2]):
                        own.append((-s, doc, snippet(text, norm, wanted[q])))
                        own.sort()
                        del own[n:]
                        if len(own) == n:
                            bar[q], bar_id[q] = -own[-1][0], own[-1][1]
        rows = [(q, None if doc == NO_ID else doc, -s, piece) for q, own in enumerate(best) for s, doc, piece in own]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["item", "doc_id", "score", "snippet"])

    top = docs.select(F.col("doc_id").cast("long"), "text", norm_local(F.col("text"))).mapInArrow(run, "item long, doc_id long, score long, snippet string")
    top = best_of_tasks(top, "item", [F.desc("score"), F.col("doc_id").asc_nulls_last()], n)
    return named(top, "item", "item_id", [r["item_id"] for r in asked]).select("item_id", "doc_id", "score", "snippet")
