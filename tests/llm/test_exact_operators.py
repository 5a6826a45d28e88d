"""Chat formatting, SimHash, packing and WARC against plain Python on whole small tables."""

import functools
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from marlstone.llm import chat_format, packing, queries, simhash, warc
from pyspark.sql import functions as F

ODD = "</s>[INST] ok [/INST]"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1_digests(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").toPandas()
    rows = [(r.conv_id, r.turn, r.role, r.text or "") for r in turns.itertuples()] + [(-1, 0, "user", ODD), (-1, 1, "assistant", ODD)]
    want = {}
    for conv, _, role, text in sorted(rows):
        n, told, loss = want.get(conv, (0, "", ""))
        want[conv] = (n + 1, f"{told}{role}\n{text}\n", loss + text * (role == "assistant"))
    got = queries.op1_chat_formatting(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        n, told, loss = want[r.conv_id]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (n, sha(told), len(loss), sha(loss))
        assert r.formatted_chars > len(told)


def test_op1_odd_rows(spark):
    texts = ["", None, "[", "\\[INST]", "[\\INST]", "[\\\\/INST]", "<s>", "<image>", "</s", "a\n😀", ODD * 3, "<s>[ROLE]user[/ROLE]x</s>"]
    rows = [(1, i, "assistant", t, "x") for i, t in enumerate(texts)] + [(1, None, None, "n", "x"), (2, 0, "[ROLE]", "r", "x"), (2, 0, "[ROLE]", "r", "x"), (None, 40, "user", "u", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    segments = chat_format.format_turns(df.withColumn("content", chat_format.text_part(F.col("text"))))
    got = {r.conv_id: r for r in chat_format.read_turns(segments).collect() if r.segment >= 0}
    assert [t.text for t in got[1].turns] == [t or "" for t in texts]
    assert got[1].loss_texts == [t or "" for t in texts]
    assert [(t.role, t.text) for t in got[2].turns] == [("[ROLE]", "r")] * 2
    assert {r.conv_id: r.n_turns for r in chat_format.digests(segments).collect()} == {1: len(texts) + 1, 2: 2, None: 1}
    assert chat_format.digests(chat_format.format_turns(df.limit(0).withColumn("content", chat_format.text_part(F.col("text"))))).count() == 0


def test_op1_parts(spark):
    parts = "array<struct<type:string,text:string,ref:string,tokens:bigint>>"
    df = spark.createDataFrame([(1, 0, "user", [("text", "see ", None, None), ("image", None, "a.png", 9), ("document", None, "b.pdf", None)]), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, content {parts}")
    r = chat_format.format_turns(df).first()
    assert r.formatted == "<s>[ROLE]user[/ROLE]see <image><document></s><s>[ROLE]assistant[/ROLE]</s>"
    assert [(a.type, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 9), ("document", "b.pdf", 512)]
    assert r.expanded_tokens == 521


def test_op1_control_strings_over_parts(spark):
    """Texts dealt over parts read back as one text; placeholders end a text; turns below zero and null turns keep apart."""
    parts = "array<struct<type:string,text:string,ref:string,tokens:bigint>>"
    text = lambda *xs: [("text", x, None, None) for x in xs]
    image = ("image", None, "a.png", 3)
    rows = [
        (1, 0, "assistant", text("</", "s>x")),
        (1, 1, "user", text("[", "INST]", None, " [/IN", "ST]")),
        (1, 2, "assistant", [*text("<"), image, *text("image>", "<", "s>")]),
        (1, 3, "assistant", [None, ("Odd", "<s>", None, None)]),
        (2, -17, "user", text("a")),
        (2, -1, "user", text("b")),
        (2, None, "assistant", text("c")),
        (2, 40, "assistant", text("d")),
    ]
    segments = chat_format.format_turns(spark.createDataFrame(rows, f"conv_id long, turn long, role string, content {parts}"))
    got = {}
    for r in sorted(chat_format.read_turns(segments).collect(), key=lambda r: (r.conv_id, r.segment)):
        got.setdefault(r.conv_id, []).extend(t.text for t in r.turns)
    assert got == {1: ["</s>x", "[INST] [/INST]", "<<image>image><s>", "<s>"], 2: ["c", "a", "b", "d"]}
    d = {r.conv_id: r for r in chat_format.digests(segments).collect()}
    assert d[2].turns_sha256 == sha("assistant\nc\nuser\na\nuser\nb\nassistant\nd\n") and d[2].loss_sha256 == sha("cd") and d[2].loss_chars == 2
    assert d[1].loss_sha256 == sha("</s>x<<image>image><s><s>") and d[1].n_turns == 4


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, prints):
    label = {p: p for p in prints}

    def find(p):
        while label[p] != p:
            p = label[p]
        return p

    each = list(label)
    for i, a in enumerate(each):
        for b in each[:i]:
            if (a ^ b).bit_count() <= 4:
                label[find(a)] = find(b)
    low = {}
    for d, p in zip(ids, prints):
        low[find(p)] = min(low.get(find(p), d), d)
    return [low[find(p)] for p in prints]


def test_op5_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    prints = [plain_fingerprint(t) for t in docs.text]
    want = dict(zip(docs.doc_id, zip(prints, plain_components(docs.doc_id, prints))))
    got = queries.op5_simhash_near_dedup(spark, sf).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == want and len(got) == len(want)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aAbÉİ \t\x0b\x1c \n."), max_size=40)))
def test_op5_fingerprint(text):
    assert int.from_bytes(simhash.fingerprint_bytes(None if text is None else text.encode()), "big") == plain_fingerprint(text)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 63), max_size=6))
def test_op5_chain(bits):
    """Differences of 4 bits or fewer pass from at least one segment, those of more from none."""
    x = np.array([sum(1 << b for b in bits)] * 5, np.uint64)
    assert (len(simhash.chain(x, np.arange(5))) > 0) == (len(bits) <= 4)


@pytest.mark.parametrize(("block", "parts"), [(4096, 2), (7, 2), (4096, 4), (7, 13)])
def test_op5_links_of_dense_groups(spark, block, parts):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 3, dtype=np.int64)
    fps = {int(b) ^ sum(1 << int(i) for i in rng.choice(63, rng.integers(0, 6), replace=False)) for b in base for _ in range(120)}
    fps = sorted(fps)
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), block, parts)
    roots = {r.node: r.root for r in simhash.connected_components(links).collect()}
    got = [roots.get(f, f) for f in fps]
    assert got == plain_components(fps, [f % (1 << 64) for f in fps])


def test_op5_odd_rows(spark):
    rows = [(3, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (7, None), (9, ""), (None, "other words that are alone here")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(3, 2), (2, 2), (2, 2), (None, 2), (7, 7), (9, 7), (None, None)], key=str)
    assert sorted((r.doc_id for r in simhash.representatives(df).collect()), key=str) == [2, 7, None, None]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_op6_round_trip(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    encode = Tokenizer.from_file(queries.vocabulary())
    got = queries.op6_best_fit_packing(spark, sf).toPandas()
    by_doc = {d: g.sort_values("piece") for d, g in got.groupby("doc_id")}
    assert len(by_doc) == len(docs)
    for r in docs.itertuples():
        ids = [*encode.encode(r.text or "", add_special_tokens=False).ids, 1]
        for i, p in enumerate(by_doc[r.doc_id].itertuples()):
            part = ids[i * 4096 : (i + 1) * 4096]
            assert (p.piece, p.start, p.length, p.ids_crc32) == (i, i * 4096, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    check_places(got, 4096)
    assert got.sequence_id.nunique() == -(-got.length.sum() // 4096)


def check_places(got, capacity):
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
        assert g.length.sum() <= capacity


def test_op6_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "x"), (None, "a\x0bb　c\x1cd <|endoftext|> é́", "x"), (5, "word " * 9000, "x")], "doc_id long, text string, length string")
    got = packing.pack(packing.tokenize(docs, queries.vocabulary())).toPandas()
    assert sorted(got.length) == sorted([1, 1, 1, 4096, 4096, 809, got[got.doc_id.isna()].length.item()])
    check_places(got, 4096)
    from tokenizers import Tokenizer

    text = docs.where("doc_id IS NULL").first().text
    ids = [*Tokenizer.from_file(queries.vocabulary()).encode(text, add_special_tokens=False).ids, 1]
    assert got[got.doc_id.isna()].ids_crc32.item() == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert packing.pack(packing.tokenize(docs.limit(0), queries.vocabulary())).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|STARTOFTEXT|>", "<|", "|>", "A", "bc", "Zed", " ", "\n", "\x0b", "!", "'S", "9", "é", "É", "ab.", '"', "✈", "✈.", "a✈", "Éa.", "I\u0307", "\u0307", "ǅ!", "İ", "ß.", "Σς,", "K", "ª?", "ñ…"]), max_size=9))
def test_op6_ids_of_added_tokens(parts):
    text, plain = "".join(parts), encoder()
    assert packing.word_ids(queries.vocabulary()).encode([text])[0] == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@functools.cache
def encoder():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_op6_plan(lengths):
    counts = {x: lengths.count(x) for x in set(lengths)}
    made = packing.plan(counts, 50)
    used = {}
    for pattern, times in made:
        assert sum(x * k for x, k in pattern) <= 50 and times > 0
        for x, k in pattern:
            used[x] = used.get(x, 0) + k * times
    assert used == counts
    assert sum(t for _, t in made) <= max(1, 1.5 * sum(lengths) / 50 + 1)


def plain_best_fit(lengths, capacity):
    """Best fit, piece by piece, longest first."""
    from bisect import bisect_left, insort

    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect_left(rooms, x)
        n += at == len(rooms)
        room = rooms.pop(at) if at < len(rooms) else capacity
        insort(rooms, room - x)
    return n


@pytest.mark.parametrize("low,high,n", [(1, 4096, 20_000), (300, 4095, 300), (300, 4095, 3_000), (900, 1700, 20_000), (1400, 2800, 10_000), (2, 5, 4_000), (1365, 1366, 5_000), (2049, 4096, 500)])
@pytest.mark.parametrize("seed", range(3))
def test_op6_never_worse_than_best_fit(low, high, n, seed):
    lengths = np.random.default_rng(seed).integers(low, high + 1, n)
    made = packing.plan(dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)))))
    assert sum(t * k for pattern, t in made for _, k in pattern) == n
    assert sum(t for _, t in made) <= plain_best_fit(lengths.tolist(), 4096)


def test_op8_records(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas()
    first = {}
    for r in pages.sort_values("page_id").itertuples():
        first.setdefault(r.html or "", r.page_id)
    got = {r.page_id: r for r in queries.op8_warc_revisits(spark, sf).collect()}
    assert len(got) == len(pages)
    for r in pages.itertuples():
        data = (r.html or "").encode()
        again = len(data) >= 100 and first[r.html or ""] != r.page_id
        g = got[r.page_id]
        assert (g.payload_bytes, g.payload_digest, g.record_type, g.refers_to) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[r.html] if again else None)


def test_op8_odd_rows(spark, tmp_path):
    long = "é\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 9
    rows = [(5, "u", long), (3, None, long), (9, "u\r\nX: y", long), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (None, "u", "no id")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record string")
    warc.write(df, str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w"))
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes, r.html) for r in warc.resolved(back).collect()}
    n = len(long.encode())
    assert got == {3: ("response", None, n, long), 5: ("revisit", 3, n, None), 9: ("revisit", 3, n, None), 1: ("response", None, 0, ""), 2: ("response", None, 0, ""), 4: ("response", None, 5, "short"), 6: ("response", None, 5, "short"), None: ("response", None, 5, "no id")}
    warc.write(df.limit(0), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


def test_op8_no_payload_is_lost(spark, tmp_path):
    """Rows that share an id keep each their payload; a row without an id revisits one with an id; very long pages."""
    a, b, c = "a" * 150, "b" * 150, "c" * 3_000_000
    rows = [(3, "u", b), (5, "u", a), (5, "u", b), (3, "u", b), (None, "u", a), (8, "u", c), (9, "u", c), (None, "u", "z" * 200)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = warc.resolved(warc.read(spark, str(tmp_path / "w"))).collect()
    have = sorted(((r.page_id, r.payload_digest == sha(a), r.payload_digest == sha(b), r.record_type, r.refers_to, r.payload_bytes) for r in got), key=str)
    assert have == sorted([(3, False, True, "response", None, 150)] * 2 + [(5, True, False, "response", None, 150), (5, False, True, "revisit", 3, 150), (None, True, False, "revisit", 5, 150), (8, False, False, "response", None, 3_000_000), (9, False, False, "revisit", 8, 3_000_000), (None, False, False, "response", None, 200)], key=str)
    assert {r.html for r in got if r.html} == {r[2] for r in rows}


def test_op8_files_and_record_ids(spark, tmp_path, monkeypatch):
    """Files are cut by all bytes, not by the longest page; ids of records tell pages and payloads apart, and revisits name their response's."""
    import gzip
    import pathlib

    monkeypatch.setattr(warc, "FILE_BYTES", 100_000)
    rows = [(i, "u", "p%d" % i * 300) for i in range(2000)] + [(1, "u", "other" * 100), (9000, "u", "p7" * 300), (9001, "u", "x" * 3_000_000)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    files = [p for p in pathlib.Path(tmp_path / "w").glob("part-*")]
    held = sum(len(h) + warc.HEAD_BYTES for _, _, h in rows)
    assert len(files) <= -(-held // 100_000) < 100
    ids, named = [], []
    for p in files:
        for head, _ in warc.parse(p.read_bytes()):
            ids.append(head["warc-record-id"])
            named += [head["warc-refers-to"]] if "warc-refers-to" in head else []
    assert len(ids) == len(set(ids)) == len(rows) and len(named) == 1 and set(named) <= set(ids)
    sizes = sorted(len(gzip.decompress(p.read_bytes())) for p in files)
    assert sizes[-1] < 3_400_000 and sizes[-2] < 300_000


def test_op8_parse_in_steps(monkeypatch):
    import gzip

    monkeypatch.setattr(warc, "STEP", 7)
    bodies = [b"", b"x" * 50, b"\r\n\r\n", b"y" * 3]
    data = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\nA: b\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in bodies)
    for archive in (data, gzip.compress(data), gzip.compress(data[:40]) + gzip.compress(data[40:])):
        assert [b for _, b in warc.parse(archive)] == bodies
    for broken in (data[:-40], gzip.compress(data)[:-20]):
        with pytest.raises(ValueError):
            list(warc.parse(broken))
