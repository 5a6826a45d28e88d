"""Language identification: TF-IDF n-gram vectors against several clustered centroids per language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import id_hash

#: Slots that n-grams hash to.
SLOTS = 2048
#: Rows of each language, about, that centroids are fitted on, chosen by a hash of id and text; and rows of all languages, of which
#: each then gets its share. The driver holds twice as many vectors at most.
SAMPLE, SAMPLE_OF_ALL = 1200, 10_000
CENTROIDS = 4
ROUNDS = 12
#: Code points of a text that are counted at a time.
STEP = 1 << 18
SHARPNESS = 25.0
#: Share of the learning sample that lies below its language's rejection cosine.
REJECT = 0.002

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[:97] = 32
_FOLD[123:] = 32


def counts(text: str) -> np.ndarray:
    """Counts by slot of the 1-, 2- and 3-grams of a text; ASCII that is no letter counts as space, runs as one.

    Texts are read STEP code points at a time; the last two of a step begin the n-grams of the next.
    """
    total = np.zeros(SLOTS, np.int64)
    held = np.zeros(0, np.uint32)
    for i in range(0, len(text), STEP):
        code = np.frombuffer(text[i : i + STEP].lower().encode("utf-32-le", "replace"), np.uint32)
        ascii_only = code < 128
        code = np.where(ascii_only, _FOLD[np.where(ascii_only, code, 0)], code)
        before = np.concatenate([held[-1:] if len(held) else [np.uint32(0)], code[:-1]])
        code = code[(code != 32) | (before != 32)]
        a = np.concatenate([held, code]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        two = (a[:-1] >> np.uint64(17)) * np.uint64(0xC2B2AE3D27D4EB4F) + a[1:]
        three = (two[:-1] >> np.uint64(15)) * np.uint64(0x165667B19E3779F9) + a[2:] if len(a) > 2 else a[:0]
        for h in (a[len(held) :][code != 32], two[1:] if len(held) == 2 else two, three):
            total += np.bincount((h >> np.uint64(64 - 11)).astype(np.int64), minlength=SLOTS)
        held = np.concatenate([held, code])[-2:]
    return total


def vectors(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), SLOTS), np.float32)
    for i, t in enumerate(texts):
        if t:
            out[i] = counts(t) * idf
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Texts, and texts with each slot, over all rows; tasks sum up, and their sums are added up by slot, so the driver gets SLOTS numbers in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(SLOTS, np.int64)
        for b in batches:
            for t in b.column(0):
                if s := t.as_py():
                    n, df = n + 1, df + (counts(s) > 0)
        own = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(own, -1)), pa.array(np.append(df[own], n))], ["slot", "n"])

    df = np.zeros(SLOTS + 1, np.int64)
    for r in docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        df[r["slot"]] = r["n"]
    return int(df[-1]), df[:-1]


def cluster(x: np.ndarray, k: int = CENTROIDS) -> np.ndarray:
    """Spherical k-means; starts from rows far from each other."""
    centres = x[:1]
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[np.argmin((x @ centres.T).max(1))]])
    for _ in range(ROUNDS):
        near = (x @ centres.T).argmax(1)
        sums = np.stack([x[near == c].sum(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centres.astype(np.float32)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, cosine, rejected`` for every row.

    Learns from text and non-null lang of rows with crc32(doc_id as text) mod 4 other than 2:
    document frequencies from all of them, centroids from about SAMPLE rows a language (fewer
    where that would be over SAMPLE_OF_ALL in all). Of languages with equal cosines the first by
    name counts. Texts are read whole, in steps.
    score is the share of the best language; rejected marks texts whose cosine to their
    nearest centroid is under that seen in all but REJECT of the language's sample: they are
    still given their nearest language. Texts
    that are null or have no letter are ``und`` with score 0, as is everything if there is
    nothing to learn from. Repeated rows get a row each, an empty table none; other columns are not read.
    """
    ship(docs.sparkSession)
    held_out = id_hash(id_col) % 4 == 2
    known = docs.where(~held_out & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    n, df = document_frequencies(known)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    each = min(SAMPLE, SAMPLE_OF_ALL // max(1, len(sizes)) + 1)
    u = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text"), F.lit(1_000_000)) / 1_000_000
    share = F.create_map(*[F.lit(x) for lang, size in sizes.items() for x in (lang, min(1.0, each / size))]) if sizes else F.lit(None)
    centres, names, least = np.zeros((0, SLOTS), np.float32), [], []
    if sizes:
        sample = known.where(u < share[F.col("lang")]).orderBy(F.xxhash64("doc_id", "text"), "lang", "text").limit(2 * each * len(sizes))

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = vectors(b.column(0).to_pylist(), idf).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

        rows = sorted((r["lang"], bytes(r["x"])) for r in sample.select("text", "lang").mapInArrow(weigh, "lang string, x binary").collect())
        for lang in sorted({r[0] for r in rows}):
            x = np.stack([np.frombuffer(r[1], np.float16) for r in rows if r[0] == lang]).astype(np.float32)
            x = x[x.any(1)]
            if len(x):
                own = cluster(x)
                centres = np.vstack([centres, own])
                names += [lang] * len(own)
                least += [float(np.quantile((x @ own.T).max(1), REJECT))] * len(own)
    langs = sorted(set(names))
    group = [np.flatnonzero([x == lang for x in names]) for lang in langs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = b.column(2).to_pylist()
                has = np.array([bool(langs) and bool(t) and _LETTER.search(t) is not None for t in texts])
                pred, score, best, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
                if langs:
                    cos = vectors(texts, idf) @ centres.T
                    by = np.stack([cos[:, g].max(1) for g in group], axis=1).astype(np.float64)
                    part = np.exp(SHARPNESS * (by - by.max(1, keepdims=True)))
                    top = by.argmax(1)
                    for i in np.flatnonzero(has):
                        pred[i] = langs[top[i]]
                    score = np.where(has, 1 / part.sum(1), 0.0)
                    best = np.where(has, by.max(1), 0.0)
                    rejected = ~has | (best < np.array(least)[cos.argmax(1)])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred), pa.array(score), pa.array(best), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "cosine", "rejected"])

    return docs.select(F.col(id_col).cast("long"), held_out.alias("held_out"), text_col).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, cosine double, rejected boolean")
