"""Searches against plain loops: words and phrases, vectors, stored vectors, both fused; evidence and page headers."""

import re

import numpy as np
import pytest
from marlstone.functions import lexicons as lex
from marlstone.functions import rules
from marlstone.operators import aggregates, containment, retrieval, vectors
from marlstone.plans import QUERIES
from marlstone.sources.vector_store import VectorStore
from pyspark.sql import functions as F


def norm(text):
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9áéíóúñü\s]", " ", (text or "").lower())).strip()


def plain_local_search(docs, queries, n):
    out = []
    for item, phrase in dict.fromkeys((i, norm(p)) for i, p in queries):
        words = [w for w in phrase.split() if len(w) >= 4] or phrase.split()
        scored = []
        for doc, text in docs:
            t = norm(text)
            score = 2 * sum(w in t for w in words) + 4 * (bool(phrase) and phrase in t)
            if score:
                at = next((t.find(w) for w in words if w in t), 0)
                scored.append((-score, doc is None, doc or 0, text[max(0, at - 220) : at + 650].strip() or text[:700].strip()))
        out += [(item, None if none else doc, -s, piece) for s, none, doc, piece in sorted(scored)[:n]]
    return sorted(out, key=str)


@pytest.mark.parametrize("held", [40, 1 << 24])
def test_local_search(spark, monkeypatch, held):
    monkeypatch.setattr(containment, "QUERY_BYTES", held)
    monkeypatch.setattr(containment, "WORDS_KEPT", 3)
    long = "gattaca" * 14_286
    docs = [(1, None), (2, ""), (3, "Zip!  zapping, the rest"), (4, "zapping"), (5, "the rest of ZAP"), (5, "the rest of ZAP"), (None, "the rest"), (7, " " * 900 + "rest" + " x" * 900), (8, "año-nuevo 2024"), (9, long + " rest"), (10, "a b c")]
    asked = [(1, "the rest"), (1, "the rest"), (2, "zapp zapp unknown"), (3, "a b"), (4, None), (5, "!?"), (6, "año NUEVO"), (7, "taca"), (None, "rest of"), (9, "it is")]
    queries = asked + [(8, long)] * (held > 40)
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, score int").repartition(3)
    q = spark.createDataFrame([(*r, "x") for r in queries], "item_id long, phrase string, doc_id string")
    for n in (1, 3):
        assert sorted(map(tuple, containment.local_search(d, q, n).collect()), key=str) == plain_local_search(docs, queries, n)
    assert containment.local_search(d.limit(0), q, 2).count() == containment.local_search(d, q.limit(0), 2).count() == 0


def test_local_search_leaves_no_item_out(spark, sf):
    """Each item is part of some text of the tables or shares a word of four letters with one."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 20").select("item_id").distinct().count()
    assert QUERIES["local_search"](spark, sf).select("item_id").distinct().count() == items


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def plain_knn(rows, queries, k):
    out = []
    for q, v in queries:
        if v is None or not np.isfinite(v).all() or not np.any(v):
            continue
        sims = [(-round(float(unit(np.array(x)) @ unit(np.array(v))), 6) + 0.0, i) for i, x in rows if i is not None and x is not None and len(x) == len(v) and np.isfinite(x).all() and np.any(x)]
        out += [(q, i, r + 1) for r, (_, i) in enumerate(sorted(sims)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("held", [100, 1 << 26])
def test_knn(spark, monkeypatch, held):
    monkeypatch.setattr(vectors, "QUERY_BYTES", held)
    monkeypatch.setattr(vectors, "CELLS", 7)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(60)]
    rows += [(100, None), (101, [0.0] * 4), (102, [1.0, 2.0]), (103, [float("nan"), 0.0, 0.0, 1.0]), (None, rows[0][1]), (0, rows[0][1])]
    queries = [("a", rows[3][1]), ("b", [0.0] * 4), ("c", None), ("a", rows[3][1]), ("d", rows[9][1])]
    r = spark.createDataFrame([(*x, 1.0) for x in rows], "vec_id long, embedding array<double>, sim double").repartition(4)
    q = spark.createDataFrame(queries, "query_id string, vector array<double>")
    assert sorted(((x.query_id, x.vec_id, x.rank) for x in vectors.knn(r, q, 5).collect()), key=str) == plain_knn(rows, queries, 5)
    assert vectors.knn(r.limit(0), q, 5).count() == vectors.knn(r, q.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        vectors.held_vectors([{"query_id": 1, "vector": [1.0]}, {"query_id": 2, "vector": [1.0, 2.0]}])


def test_vector_store(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.2 * rng.normal(size=8)).tolist(), i % 3) for i in range(600)]
    odd = [(900, None, 0), (901, [0.0] * 8, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    path = str(tmp_path / "store")
    store = VectorStore.create(df, path)
    with pytest.raises(FileExistsError):
        VectorStore.create(df, path)
    with pytest.raises(FileNotFoundError):
        VectorStore.open(spark, str(tmp_path / "none"))
    store = VectorStore.open(spark, path)
    assert store.count() == 602 and store.dims == 8 and len(store.centroids) == 25
    queries = [(i, rows[i][1]) for i in range(0, 600, 20)]
    q = spark.createDataFrame(queries, "query_id long, vector array<double>")
    found = lambda df: sorted(((r.query_id, r.vec_id, r["rank"]) for r in df.collect()), key=str)
    exact = plain_knn([r[:2] for r in rows], queries, 10)
    assert found(store.search(q, 10, len(store.centroids))) == exact
    few = store.search(q, 10, 8)
    assert len({x[:2] for x in found(few)} & {x[:2] for x in exact}) >= 0.9 * len(exact)
    assert found(store.search(q, 4, 25, where="label = 2")) == plain_knn([r[:2] for r in rows if r[2] == 2], queries, 4)
    store.add(spark.createDataFrame([(700, rows[0][1], 9)], df.schema))
    assert [r.vec_id for r in store.search(q.where("query_id = 0"), 2, 1).orderBy("rank").collect()] == [0, 700]
    for bad in ([1.0, 2.0], [1.0] * 9):
        with pytest.raises(ValueError):
            store.add(spark.createDataFrame([(1, bad, 1)], df.schema))
        with pytest.raises(ValueError):
            store.search(spark.createDataFrame([(1, bad)], "query_id long, vector array<double>"), 2)
    assert store.count() == 603
    store.reset()
    assert store.count() == 0 and store.search(q, 3).count() == 0
    store.add(df)
    assert VectorStore.open(spark, path).count() == 602


def test_store_search_recall(spark, sf):
    """Of the ten nearest of every item, the lists probed hold nine tenths."""
    mid = sf.replace("sf0.001", "sf0.01")
    exact = {(r.query_id, r.vec_id) for r in QUERIES["knn_join"](spark, mid).collect()}
    some = {(r.query_id, r.vec_id) for r in QUERIES["store_search"](spark, mid).collect()}
    assert len(some & exact) >= 0.9 * len(exact)


def test_hybrid_search(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "doc_id long, embedding array<double>")
    d = spark.createDataFrame([(1, "nothing of it here"), (2, "nothing of it here"), (3, "rare word there"), (4, "rare word alone"), (5, "a filler text"), (6, "a filler line")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "rare word", [1.0, 0.0])], "query_id long, query string, vector array<double>")
    got = [(r["rank"], r.doc_id, r.distance) for r in retrieval.hybrid_search(v, d, q, 3).orderBy("rank").collect()]
    # 2 has the text of 1; 3 and 4 are found by their words, 3 also by its vector
    assert got == [(1, 3, 1.0), (2, 1, 0.0)]
    wide = {r.doc_id: r.distance for r in retrieval.hybrid_search(v, d, q, 4).collect()}
    assert wide == {1: 0.0, 3: 1.0, 4: 0.5}


def test_lexical_rerank(spark):
    rows = [(1, 1, "Zip, the zap!", "none"), (1, 2, "Zip, the zap!", "ZIP... the zap"), (1, 3, "Zip, the zap!", "zapping the"), (2, 1, "a b", "a b"), (2, 2, "a b", None), (3, 1, None, "x")]
    df = spark.createDataFrame(rows, "g int, old int, q string, t string")
    got = {(r.g, r.old): (r.hits, r["rank"]) for r in retrieval.lexical_rerank(df, "g", "old", "q", "t").collect()}
    assert got == {(1, 2): (6, 1), (1, 3): (2, 2), (1, 1): (0, 3), (2, 1): (0, 1), (2, 2): (0, 2), (3, 1): (0, 1)}


@pytest.mark.parametrize(("answer", "context", "ok"), [
    ("uno\n  EVIDENCIA: \"dos tres\" y \" cuatro \"", "x dos tres cuatro", True),
    ("Evidencia: \"falta\"\nnada", "no hay", False),
    ("dice Evidencia: \"no hay\"", "no hay", False),
    ("el envío tarda 3,5 dias habiles", "El ENVÍO tarda 3,5 dias", True),
    ("el envío tarda 3,6 dias habiles", "El ENVÍO tarda 3,5 dias", False),
    ("desde hasta entre sobre envio", "desde hasta entre sobre envio", False),
    ("cartas grandes", "descartas grandes!", True),
    ("", "algo", False), ("algo mas", "", False), (None, "algo", False), ("algo", None, False),
])
def test_grounded(spark, answer, context, ok):
    row = spark.createDataFrame([(answer, context)], "a string, c string").select(rules.grounded(F.col("a"), F.col("c")).alias("ok"), rules.evidence_quotes(F.col("a")).alias("q")).first()
    assert row.ok is ok
    line = next((x for x in (answer or "").splitlines() if x.strip().lower().startswith("evidencia:")), "")
    assert row.q == [x.strip() for x in re.findall('"([^"]+)"', line) if x.strip()]
    assert "sobre" in lex.EVIDENCE_STOPS


def test_page_headers(spark):
    head, foot = ["Acme  Corp", "page 1"], ["x", "printed 2024"]
    pages = [("a", i, [*[h.replace("1", str(i)) for h in head], f"body {chr(97 + i)}", "y", "z", "w", f"only here {chr(97 + i)}", *foot]) for i in range(4)] + [("b", 0, head + foot), ("c", 0, None), ("c", 1, [])]
    df = spark.createDataFrame(pages, "doc string, page int, lines array<string>")
    got = {(r.doc, r.page): r.lines for r in aggregates.without_headers(df, "doc", "lines").collect()}
    assert got == {**{("a", i): [f"body {chr(97 + i)}", "y", "z", "w", f"only here {chr(97 + i)}", "x"] for i in range(4)}, ("b", 0): head + foot, ("c", 0): None, ("c", 1): []}
