"""Ranked search against a score for every document, shards of any size, odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from marlstone.llm import lexical, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items):
    tokens = [(d, plain_terms(t)) for d, t in docs]
    tokens = [(d, ts, Counter(ts)) for d, ts in tokens if ts]
    n, total = len(tokens), sum(len(ts) for _, ts, _ in tokens)
    df = Counter(w for _, _, c in tokens for w in c)
    out = []
    for item, text in items:
        scored = []
        for d, ts, c in tokens:
            m = 100 - 25 + (25 * len(ts) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m)) for w in plain_terms(text) if c[w])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scored)[:20])]
    return out


def test_op11_query_against_plain(spark, sf):
    read = lambda name, *cols: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*cols).collect()]
    want = plain_search(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
    assert sorted(map(tuple, queries.op11_ranked_search(spark, sf).collect())) == sorted(want)


words = st.sampled_from(["a", "b", "c", "dd", "ee", "É", "é", "Z", "z9", "x"])
texts = st.lists(words, max_size=30).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, min_size=1, max_size=60), st.lists(texts, min_size=1, max_size=3), st.integers(1, 5), st.integers(1, 40))
def test_op11_shards(docs, items, top, size):
    """Shards of a few documents, few wanted: bounds hold terms and documents back, never the best."""
    was, lexical.TOP = lexical.TOP, top
    try:
        numbers, tokens = {}, [plain_terms(t) for t in docs]
        asked = [list(Counter(numbers.setdefault(w, len(numbers)) for w in plain_terms(t)).items()) for t in items]
        n, total = sum(map(bool, tokens)), max(1, sum(map(len, tokens)))
        df = Counter(w for ts in tokens for w in set(ts))
        weights = np.array([lexical.weight(n, df[w]) for w in numbers], np.int64)
        best, scores = [lexical.Best() for _ in items], [[] for _ in items]
        for at in range(0, len(docs), size):
            counts = [Counter(numbers[w] for w in ts if w in numbers) for ts in tokens[at : at + size]]
            arrays = [np.array(x, np.int64) for x in ([i for i in range(at, at + len(counts))], [len(ts) for ts in tokens[at : at + size]], [t for c in counts for t in c], [k for c in counts for k in c.values()], [len(c) for c in counts])]
            shard = lexical.Shard(arrays[0], np.zeros(len(counts), bool), *arrays[1:4], arrays[4], weights, n, total)
            for q, b in zip(asked, best):
                shard.search(q, b)
        names = list(numbers)
        for q, b in zip(asked, best):
            all_scores = [(-sum(times * weights[t] * (1000000000 * ts.count(names[t]) // (1000 * ts.count(names[t]) + 12 * (75 + 25 * len(ts) * n // total))) for t, times in q), d) for d, ts in enumerate(tokens)]
            assert [(-s, d) for s, d in sorted(all_scores) if s < 0][:top] == list(zip(b.score.tolist(), b.doc.tolist()))
    finally:
        lexical.TOP = was


def test_op11_skips_postings():
    """A rare term decides; the postings of the common one are probed for its documents alone."""
    n = 5000
    tf = np.ones(n + 30, np.int64)
    shard = lexical.Shard(np.arange(n), np.zeros(n, bool), np.full(n, 9), np.concatenate([np.zeros(n, np.int64), np.ones(30, np.int64)])[np.argsort(np.concatenate([np.arange(n), np.arange(30) * 7]), kind="stable")], tf, np.bincount(np.arange(30) * 7, minlength=n) + 1, np.array([1, 6000]), n, 9 * n)
    seen, offer = [], shard._offer
    shard._offer = lambda at, *rest: (seen.append(len(at)), offer(at, *rest))
    best = lexical.Best()
    shard.search([(0, 1), (1, 1)], best)
    assert seen == [30, 30] and best.doc.tolist() == [i * 7 for i in range(20)]


@pytest.mark.parametrize("held", [16, 1 << 25])
def test_op11_odd_rows(spark, monkeypatch, held):
    monkeypatch.setattr(lexical, "ITEM_BYTES", held)
    docs = [(1, None), (2, ""), (3, "!?"), (4, "Alpha beta"), (4, "alpha beta"), (None, "ALPHA gamma"), (7, "é É alpha"), (8, "delta " * 300_000), (9, "delta x"), *((100 + i, "tie delta") for i in range(40))]
    items = [(1, "alpha ALPHA beta"), (1, "alpha ALPHA beta"), (1, "delta"), (2, None), (3, "..."), (None, "É"), (5, "never seen"), (6, "tie")]
    d = spark.createDataFrame([(*r, 5, "q") for r in docs], "doc_id long, text string, n long, item string").repartition(3)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    got = sorted(map(tuple, lexical.search(d, q).collect()), key=str)
    assert got == sorted(plain_search(docs, list(dict.fromkeys(items))), key=str)
    assert lexical.search(d.limit(0), q).count() == lexical.search(d, q.limit(0)).count() == 0
    assert lexical.search(d, q).columns == ["item_id", "rank", "doc_id", "score"]
