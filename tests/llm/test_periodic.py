"""Periodic runs against all periods of all positions, and odd rows."""

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from marlstone.llm import periodic, queries


def plain_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            whole = words[i : j + q]
            if j > i and len(whole) >= max(6, 4 * q) and not any(whole[e:] == whole[:-e] for e in range(1, q)):
                out.append((i, len(whole), q))
            i = max(j, i + 1)
    return sorted(out)


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


powers = st.recursive(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), lambda parts: st.builds(lambda xs, k: (sum(xs, []) * k)[:400], st.lists(parts, min_size=1, max_size=4), st.integers(1, 9)), max_leaves=8)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(powers, st.just([])), min_size=1, max_size=4), st.sampled_from([8, 1 << 18]))
def test_op13_runs_against_plain(texts, keys):
    was, periodic.KEYS = periodic.KEYS, keys
    try:
        got = periodic.runs_of_texts([[w.encode() for w in t] for t in texts])
    finally:
        periodic.KEYS = was
    assert got == [plain_runs(t) for t in texts]


def test_op13_query_against_plain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    for r in docs.itertuples():
        words, h = (r.text or "").encode().split(), zlib.crc32(str(r.doc_id).encode())
        words = [w.decode() for w in words]
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        told, kept = sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(plain_collapsed(words, runs))
        milli = best[1] and 1000 * best[1] // best[2]
        g = got[r.doc_id]
        assert (g.n_runs, g.start, g.length, g.period, g.exponent_milli, g.runs_sha256, g.collapsed_sha256) == (len(runs), *best, milli, told, kept)


@pytest.mark.parametrize("chunk", [3, 1 << 20])
def test_op13_odd_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(periodic, "CHUNK", chunk)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 6), (4, "a " * 6), (None, "a b " * 4 + "a"), (6, "é\x0bé　é\x1cé " * 2), (7, "x " * 300_000 + "y")]
    df = spark.createDataFrame([(*r, "z", 0) for r in rows], "doc_id long, text string, collapsed string, start int")
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(df).collect()]
    want = [(1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 6, 1)], "a"), (4, [(0, 6, 1)], "a"), (None, [(0, 9, 2)], "a b"), (6, [], "é é　é\x1cé é é　é\x1cé"), (7, [(0, 300_000, 1)], "x y")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert periodic.periodic_runs(df.limit(0)).count() == 0
    assert {r.text for r in queries.repeated_tails(df.where("doc_id IS NULL OR doc_id < 3").select("doc_id", "text")).collect()} == {None, "", "a b " * 4 + "a"}


def test_op13_long_texts_take_seconds():
    """Powers within powers, long periods, and texts of few words."""
    for words in ([b"a"] * 200_000, ([b"a"] * 999 + [b"b"]) * 200, [b"%d" % (i % 50_000) for i in range(200_000)], [b"ab"[i * i % 7 % 2 :][:1] for i in range(200_000)]):
        runs = periodic.runs_of_texts([words])[0]
        assert runs[0] == plain_first(words, runs[0])


def plain_first(words, run):
    start, length, q = run
    assert all(words[i] == words[i + q] for i in range(start, start + length - q))
    assert start + length == len(words) or words[start + length] != words[start + length - q]
    return run
