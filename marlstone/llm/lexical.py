"""Ranked search over all documents: MaxScore in each shard, with integer weights."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, spread
from .common import materialize

#: Best documents of an item.
TOP = 20
#: A shard ends at so many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 1 << 16, 1 << 22
#: Bytes of items that tasks hold together; more of them are searched in as many parts.
ITEM_BYTES = 1 << 25
#: Parts into which an item's candidates are dealt before the last selection.
SALTS = 256
#: Makes a term of every sign but ASCII letters, digits and what is beyond ASCII a blank, and A-Z small.
_SIGNS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

Query = list[tuple[int, int]]  # (term, times)


def terms_of(text: str | None) -> list[bytes]:
    """Letters and digits of ASCII, and anything beyond it, as long as they stand together; only A-Z lower-cased."""
    return (text or "").encode().translate(_SIGNS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Best:
    """The best documents of one item so far: by score, then by id, without id last."""

    __slots__ = ("doc", "none", "score")

    def __init__(self):
        self.score, self.doc, self.none = (np.zeros(0, t) for t in (np.int64, np.int64, bool))

    def least(self) -> int:
        """The score that a document has to reach."""
        return int(self.score[-1]) if len(self.score) == TOP else 1

    def add(self, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        score, doc, none = np.concatenate([self.score, score]), np.concatenate([self.doc, doc]), np.concatenate([self.none, none])
        if len(score) > 4 * TOP:
            some = score >= -np.partition(-score, TOP - 1)[TOP - 1]
            score, doc, none = score[some], doc[some], none[some]
        order = np.lexsort((doc, none, -score))[:TOP]
        self.score, self.doc, self.none = score[order], doc[order], none[order]


class Shard:
    """Postings of some documents by term: documents in ascending order with what the term adds to their scores, and its most."""

    def __init__(self, doc: np.ndarray, none: np.ndarray, length: np.ndarray, terms: np.ndarray, tf: np.ndarray, sizes: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.doc, self.none = doc, none
        norm = 75 + 25 * length * n_docs // n_terms
        at = np.repeat(np.arange(len(doc)), sizes)
        order = np.argsort(terms, kind="stable")
        terms, self.at, tf = terms[order], at[order], tf[order]
        self.adds = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 12 * norm[self.at]))
        first = np.flatnonzero(np.diff(terms, prepend=-1))
        self.range = dict(zip(terms[first].tolist(), zip(first.tolist(), [*first[1:].tolist(), len(terms)])))
        self.most = dict(zip(terms[first].tolist(), np.maximum.reduceat(self.adds, first).tolist() if len(first) else []))
        self.total = np.zeros(len(doc), np.int64)

    def search(self, query: Query, best: Best) -> None:
        """Adds the documents of this shard that qualify to the best ones.

        Terms in order of their bounds; those whose bounds add up to less than the least score
        wanted are non-essential: alone they make no document qualify. Documents are taken
        from the postings of the essential ones; the others' are only probed, the largest
        bound first, for documents that can still qualify.
        """
        lists = sorted((times * self.most[t], t, times) for t, times in query if self.most.get(t))
        if not lists:
            return
        if len(best.score) < TOP:  # the documents of the rarest term give a first least score
            _, t, _ = lists[-1]
            a, b = self.range[t]
            first = Best()
            self._offer(self.at[a:b], lists[:-1], self.adds[a:b] * lists[-1][2], first, 1)
            least = max(best.least(), first.least())
        else:
            least = best.least()
        bounds = np.cumsum([x[0] for x in lists])
        probed = int(np.searchsorted(bounds, least))  # lists before this one are non-essential
        if probed == len(lists):
            return
        total = self.total
        for _, t, times in lists[probed:]:
            a, b = self.range[t]
            total[self.at[a:b]] += self.adds[a:b] * times
        at = np.flatnonzero(total) if len(lists) - probed > 1 else self.at[slice(*self.range[lists[-1][1]])]
        score = total[at]
        total[at] = 0
        self._offer(at, lists[:probed], score, best, least)

    def _offer(self, at: np.ndarray, lists: list[tuple[int, int, int]], score: np.ndarray, best: Best, least: int) -> None:
        left = sum(x[0] for x in lists)
        for bound, t, times in reversed(lists):
            can = score + left >= least
            at, score = at[can], score[can]
            a, b = self.range[t]
            own = self.at[a:b]
            i = np.searchsorted(own, at)
            hit = own[np.minimum(i, len(own) - 1)] == at
            score = score + np.where(hit, self.adds[a + np.minimum(i, len(own) - 1)] * times, 0)
            left -= bound
        can = score >= least
        at = at[can]
        best.add(score[can], self.doc[at], self.none[at])


def postings(docs: DataFrame, words: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, terms, tfs`` of each document with a term: all its terms counted, the wanted ones listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = words.get
        for b in batches:
            rows, ns, ends, terms, tfs = [], [], [0], [], []
            for i, t in enumerate(b.column(1)):
                found = terms_of(t.as_py())
                if found:
                    tf = Counter(map(get, found))
                    tf.pop(None, None)
                    rows.append(i)
                    ns.append(len(found))
                    terms.extend(tf.keys())
                    tfs.extend(tf.values())
                    ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(ns, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def top_of_shards(found: DataFrame, queries: list[Query], weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """``item, doc_id, score``: the best of each item among what each task reads, shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best() for _ in queries]
        held: list[pa.RecordBatch] = []
        docs = listed = 0

        def search() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            ids, lists = t.column(0), t.column(2).combine_chunks()
            flat = lambda x, to: x.to_numpy(zero_copy_only=False).astype(to)
            columns = flat(ids.fill_null(0), np.int64), flat(ids.is_null(), bool), flat(t.column(1), np.int64), flat(lists.flatten(), np.int64), flat(t.column(3).combine_chunks().flatten(), np.int64)
            shard = Shard(*columns, flat(lists.value_lengths(), np.int64), weights, n_docs, n_terms)
            for query, own in zip(queries, best):
                shard.search(query, own)

        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                held.append(b)
                docs, listed = docs + b.num_rows, listed + len(b.column(2).flatten())
                if docs >= SHARD_DOCS or listed >= SHARD_POSTINGS:
                    search()
                    held, docs, listed = [], 0, 0
        if held:
            search()
        n = [len(x.score) for x in best]
        item = np.repeat(np.arange(len(best)), n)
        doc = pa.array(np.concatenate([x.doc for x in best]), mask=np.concatenate([x.none for x in best]))
        yield pa.RecordBatch.from_arrays([pa.array(item), doc, pa.array(np.concatenate([x.score for x in best]))], ["item", "doc_id", "score"])

    return found.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the TOP documents with a score above 0 of each item (``item_id, text``).

    Documents are read once for the postings of the items' terms and for all counts, and their
    postings once, a shard after the other, by tasks that keep TOP documents an item. Items
    are held by every task, ITEM_BYTES of them at a time; more are searched in parts, each
    over all documents. Documents with equal scores rank by id, without id last; rows that
    repeat an id are documents of their own, rows that repeat an item's id and text are one
    item, and other texts of its id rank from 1 again. Null texts, and texts without a term, hold nothing and
    find nothing; empty tables give no row; columns of other names are not read.
    """
    ship(docs.sparkSession)
    items = items.select("item_id", "text").where("text IS NOT NULL").distinct()
    held = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-held // ITEM_BYTES)
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for part in range(parts):
        some = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        if asked := [(r["item_id"], r["text"]) for r in some.collect()]:
            out = out.unionByName(_search(docs, asked, id_col, text_col))
    return out


def _search(docs: DataFrame, items: list[tuple[int | None, str]], id_col: str, text_col: str) -> DataFrame:
    words: dict[bytes, int] = {}
    queries = [list(Counter(words.setdefault(w, len(words)) for w in terms_of(text)).items()) for _, text in items]
    found = materialize(postings(docs, words, id_col, text_col), "postings")
    n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(map(tuple, found.select(F.explode("terms")).groupBy("col").count().collect()))  # a row for each term of these items
    weights = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(words))], np.int64)
    top = top_of_shards(spread(found), queries, weights, n_docs, max(1, n_terms))
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    for keys in (["item", F.spark_partition_id() % SALTS], ["item"]):  # an item has TOP rows a task: few meet at once
        top = top.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= TOP)
    names = docs.sparkSession.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], "item long, item_id long")
    return top.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
