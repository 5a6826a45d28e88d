"""Chunks of documents: cut at line ends, sentence ends or spaces within a window, with overlap."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_text

# Where a window may be cut, least chunk, structural line starts.
CUTS = ("\n", ". ", "? ", "! ", "; ", ": ", ", ", " ")
LEAST_CHARS = 40
STARTS = r"#{1,3}\s|FUENTE:|TITULO:|TIPOS:|\[Fuente:"


def overlap_of(size: int) -> int:
    return min(80, max(size // 4, 24))


def cut(text: str, size: int, overlap: int) -> list[str]:
    """Pieces of at most ``size``. A cut before 45 % of the window is moved to its end; each piece starts ``overlap`` before the last cut."""
    out, at, text = [], 0, text.strip()
    n = len(text)
    while n - at > size:
        best = max(text.rfind(c, at, at + size) for c in CUTS) - at
        if best < size * 0.45:
            best = size
        if piece := text[at : at + best].strip():
            out.append(piece)
        at += max(best - overlap, 1)
        while at < n and text[at].isspace():
            at += 1
    if at < n:
        out.append(text[at:])
    return out


def blocks_of(text: Column) -> Column:
    """Normalised text split before structural lines, as an array."""
    marked = F.regexp_replace(norm_text(text), rf"(?m)^(?={STARTS})", "\u0000")
    return F.filter(F.transform(F.split(marked, "\u0000"), lambda b: F.btrim(b, F.lit(" \n"))), lambda b: b != "")


def segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``source_id, block_index, block``, a row for each block."""
    return docs.select(F.col(id_col).alias("source_id"), F.posexplode(blocks_of(F.col(text_col))).alias("block_index", "block"))


def chunks(docs: DataFrame, size: int = 250, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``source_id, chunk_index, chunk, chunk_chars, content_hash``.

    The index counts pieces that are then dropped for being under 40 characters. Null and empty
    texts give none. Each row is cut where it is read, without a shuffle; rows that share an id
    stay documents of their own.
    """
    overlap = overlap_of(size)
    blocks = docs.select(F.col(id_col).alias("source_id"), F.coalesce(blocks_of(F.col(text_col)), F.array().cast("array<string>")).alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for source, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                index = 0
                for block in own:
                    for piece in [block] if len(block) <= size else cut(block, size, overlap):
                        if len(piece) >= LEAST_CHARS:
                            rows.append((source, index, piece, len(piece), hashlib.sha1(piece.encode()).hexdigest()[:16]))
                        index += 1
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], ["source_id", "chunk_index", "chunk", "chunk_chars", "content_hash"])

    return blocks.select(F.col("source_id").cast("long"), "blocks").mapInArrow(run, "source_id long, chunk_index long, chunk string, chunk_chars long, content_hash string")
