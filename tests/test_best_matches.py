"""The best documents by BM25 against all scores of all documents."""

import random
import time

import numpy as np
import pytest
from marlstone.operators import best_matches as B
from marlstone.operators import retrieval
from pyspark.sql import functions as F


def found(df):
    return sorted(((r.query_id, r.doc_id, round(r.score, 6), r["rank"]) for r in df.collect()), key=str)


@pytest.mark.parametrize(("postings", "held"), [(1 << 22, 1 << 24), (40, 1 << 24), (7, 100)])
def test_best_matches(spark, monkeypatch, postings, held):
    """Copies, words in most documents, no words, null ids and texts, queries of several rows; shards and parts of any size."""
    monkeypatch.setattr(B, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(B, "QUERY_BYTES", held)
    rng = random.Random(postings)
    words = [f"w{i}" for i in range(40)]
    some = lambda most: " ".join(rng.choices(words, [1 / (i + 1) for i in range(40)], k=rng.randint(0, most)))
    docs = [(i, some(30)) for i in range(200)] + [(300 + i, "w0 w1 w2") for i in range(30)] + [(None, "w0 W1 w39 w39"), (400, None), (401, ""), (402, "!"), (403, "ñandú w0")]
    asked = [(f"q{i}", some(12)) for i in range(12)] + [("two", "w0 w5"), ("two", "w5 w6"), (None, "w3"), ("none", None), ("odd", "Ñandú nothing"), ("same", "w0 w1 w2")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame([(*x, 1) for x in asked], "query_id string, query string, n int")
    for n in (1, 7):
        want = retrieval.ranked(retrieval.bm25(d, q.where("query_id IS NOT NULL")), "query_id", [F.round("score", 6).desc(), F.col("doc_id")], n)
        assert found(B.best_matches(d, q.where("query_id IS NOT NULL"), n)) == found(want)
    assert B.best_matches(d.limit(0), q, 2).count() == B.best_matches(d, q.limit(0), 2).count() == 0


def test_context_sends_on_no_long_text(spark):
    """Blocks are cut before they are collected."""
    rows = spark.createDataFrame([(1, 1, "s", "a b " * 40_000), (1, 2, "s", "c"), (2, 1, "s", "x " * 9)], "g int, r int, s string, t string")
    out = retrieval.build_context(rows, "g", "r", "s", "t", 50)
    assert {r.g: r.context for r in out.collect()} == {1: ("[Source: s]\n" + "a b " * 20)[:50].rsplit(" ", 1)[0], 2: "[Source: s]\n" + "x " * 9}
    assert "substring(concat" in out._jdf.queryExecution().optimizedPlan().toString().split("collect_list")[1]


def test_many_queries_in_blocks(spark):
    """Queries of frequent words, whose scores lie close together: 12,000 of them over 3,000 documents in one task, by blocks and not one by one."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) ** 0.7 for i in range(400)]
    d = spark.createDataFrame([(i, " ".join(rng.choices(words, weights, k=120))) for i in range(3000)], "doc_id long, text string").coalesce(1)
    q = spark.createDataFrame([(i, " ".join(rng.choices(words, weights, k=30))) for i in range(12_000)], "query_id long, query string")

    def seconds(asked):
        began = time.time()
        return B.best_matches(d, asked, 3), time.time() - began

    few = q.where("query_id < 40")
    got, least = seconds(few)
    assert found(got) == found(retrieval.ranked(retrieval.bm25(d, few), "query_id", [F.round("score", 6).desc(), F.col("doc_id")], 3))
    got, most = seconds(q)
    assert got.count() == 36_000 and found(got.where("query_id < 40")) == found(B.best_matches(d, few, 3))
    assert most - least < 8


@pytest.mark.parametrize("n", [1, 5])
def test_shard_by_all_paths(n):
    """Copies, weights of zero and below, words asked twice: scores in double precision decide, whichever path a document takes."""
    rng = np.random.default_rng(n)
    for least_weight, copies in ((0.1, 500), (-1.0, 0), (0.1, 0)):
        there = rng.random((700, 30)) < np.linspace(0.9, 0.02, 30)
        there[100 : 100 + copies] = there[3]
        adds = np.where(there, rng.uniform(least_weight, 5, (700, 30)), 0)
        adds[100 : 100 + copies] = adds[3]
        adds[there & (rng.random((700, 30)) < 0.02) & (least_weight < 0)] = 0
        at, w = np.nonzero(there)
        asked = [np.sort(rng.choice(30, k, replace=False)) for k in rng.integers(1, 12, 300)]
        times = [rng.integers(1, 3, len(x)).astype(np.int32) for x in asked]
        best = B.Best(300, n)
        shard = B.Shard(700, at * 30 + w, adds[at, w], 30)
        shard.search(np.concatenate(asked).astype(np.int32), np.concatenate(times), np.cumsum([0, *map(len, asked)]), best, np.arange(700) * 2, np.zeros(700, bool))
        for q, (x, t) in enumerate(zip(asked, times)):
            score = adds[:, x] @ t
            held = np.flatnonzero(there[:, x].any(axis=1))
            want = held[np.lexsort((held, -B.rounded(score[held])))][:n]
            assert (best.doc[q][best.score[q] > -np.inf] == want * 2).all() and np.allclose(best.score[q][best.score[q] > -np.inf], score[want])
