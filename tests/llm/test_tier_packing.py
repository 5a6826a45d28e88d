"""Windows of several lengths: full, gapless, every id once, steps of equal size."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from marlstone.llm import queries, tier_packing


def covered(pieces, docs):
    """Every token of every document in exactly one piece."""
    by = {}
    for doc, start, length in pieces:
        by.setdefault(doc, []).append((start, length))
    for doc, n in docs.items():
        at = 0
        for start, length in sorted(by.pop(doc)):
            assert start == at and length > 0
            at += length
        assert at == n
    assert not by


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 70), st.sampled_from([4, 8, 16, 32, 33, 31])), max_size=60))
def test_op12_plan(lengths):
    tiers = (4, 8, 16, 32)
    made, left = tier_packing.plan([(i, 0, n) for i, n in enumerate(lengths)], tiers)
    last = tier_packing.tail(left)
    for size, window in made + last:
        assert sum(p[2] for p in window) == size and size & (size - 1) == 0
    assert {size for size, _ in made} <= set(tiers) and sum(p[2] for p in left) < 32
    covered([p for _, window in made + last for p in window], dict(enumerate(lengths)))
    # a window's first piece is of its tier; it is cut for one gap at most, so pieces are few
    assert all(window[0][2] > size // 2 or size == 4 for size, window in made)
    assert sum(len(w) for _, w in made) <= len(lengths) + sum(n // 32 for n in lengths) + len(made)


def check(got, docs, end=2):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(queries.vocabulary())
    covered([tuple(r) for r in got[["doc_id", "start", "length"]].itertuples(index=False)], got.groupby("doc_id").doc_tokens.first().to_dict())
    by_doc = dict(list(got.groupby("doc_id")))
    assert set(by_doc) == set(docs)
    for d, text in docs.items():
        ids = np.array([*encode.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        for p in by_doc[d].itertuples():
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
        assert g.length.sum() == g.tier.iloc[0] and g.tier.nunique() == 1


@pytest.mark.parametrize("buffer", [3_000, 1 << 22])
def test_op12_round_trip(spark, sf, monkeypatch, buffer):
    monkeypatch.setattr(tier_packing, "BUFFER", buffer)
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    got = queries.op12_tier_packing(spark, sf).toPandas()
    check(got, dict(zip(docs.doc_id, docs.text)))
    assert (got.tier <= 4096).all()
    sequences = got.drop_duplicates("sequence_id")
    for tier, of in sequences.groupby("tier"):
        sizes = of.groupby("step").tier.sum()
        assert sizes.index.tolist() == list(range(len(sizes)))
        assert (sizes.iloc[:-1] == tier_packing.STEP).all() and sizes.iloc[-1] <= tier_packing.STEP
        assert np.allclose(sorted(of.step_at.unique()), (np.arange(len(sizes)) + 0.5) / len(sizes))


def test_op12_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "word " * 9000), (4, "<|endoftext|> é"), (5, "a")]
    df = spark.createDataFrame([(*r, 7, 0) for r in rows], "doc_id long, text string, tier long, part long")
    check(tier_packing.pack(df.coalesce(1), queries.vocabulary()).toPandas(), dict(rows))
    again = tier_packing.pack(df.union(df).where("doc_id IN (1, 5)").selectExpr("nullif(doc_id, 1) AS doc_id", "text"), queries.vocabulary()).toPandas()
    assert sorted(again.length) == [1, 1, 2, 2] or again.length.sum() == 6
    assert again.doc_id.isna().sum() >= 2
    assert tier_packing.pack(df.limit(0), queries.vocabulary()).count() == 0
