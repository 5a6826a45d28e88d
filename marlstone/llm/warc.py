"""WARC archives: revisit resolution by payload digest, writing, reading back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import materialize

#: Payloads of fewer bytes are written in full each time.
LEAST_BYTES = 100
#: Bytes of one archive file, about, and of a record's headers; a reader's task holds one file, compressed.
FILE_BYTES, HEAD_BYTES = 1 << 28, 500
#: Bytes that a reader inflates at a time.
STEP = 1 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def heads_of(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, payload_digest, payload_bytes`` for every row. Null payloads are empty."""
    payload = F.encode(F.coalesce(html_col, F.lit("")), "UTF-8")
    return pages.select(F.col(id_col).alias("page_id"), F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))


def resolve(heads: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``page_id, payload_digest, payload_bytes, refers_to`` for every row of ``heads``; ``refers_to`` is null for responses.

    Headers alone are shuffled: the smallest id of each digest is a partial minimum, and the
    join on digests moves ids and digests, never payloads. A row without an id revisits any
    row with one, and is a response if there is none; rows that repeat the smallest id are all
    responses.
    """
    first = heads.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    later = (F.col("first_id") < F.col("page_id")) | F.col("page_id").isNull()
    return heads.join(first.select("payload_digest", "first_id"), "payload_digest", "left").select("page_id", "payload_digest", "payload_bytes", F.when(later, F.col("first_id")).alias("refers_to"))


def _urn(page: Column, digest: Column) -> Column:
    """The id of a record: its page's, and the payload's, as rows that share an id may differ in that."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), F.substring(digest, 1, 32), F.lit(">"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES, heads: DataFrame | None = None, files: int | None = None) -> DataFrame:
    """``record``: a WARC/1.1 record for each row, without the two line ends that close it.

    A revisit has no payload; its headers are made anew and name the response. What a row is
    depends on its id and payload together, so rows that share an id and differ in payload each
    keep theirs, as responses or as revisits of a response that holds it. Records have ids of page and payload: only rows that repeat
    both share one. Null ids and addresses are written as empty ones, null payloads as empty; an
    empty table gives no records; other columns are not read. ``heads`` are those of ``pages``, if they are at
    hand; ``files`` is how many partitions, and so files, the records are dealt into, by id and payload.
    """
    heads = heads_of(pages, id_col, html_col) if heads is None else heads
    mark = lambda page: F.xxhash64(page, "payload_digest")
    decided = resolve(heads, least).where("refers_to IS NOT NULL").groupBy(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), mark("page_id").alias("key")).agg(F.min("refers_to").alias("refers_to"))
    html = F.coalesce(html_col, F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(url_col, F.lit("")).alias("url"), html.alias("html"), F.sha2(F.encode(html, "UTF-8"), 256).alias("payload_digest")).withColumn("key", mark("page_id"))
    if files:
        rows = rows.repartition(files, "key")  # the join then finds them dealt by its key
    same = (rows["key"] == decided["key"]) & rows["page_id"].eqNullSafe(decided["_id"]) & (rows["payload_digest"] == decided["_digest"])
    rows = rows.join(decided, same, "left").withColumnRenamed("payload_digest", "digest")
    crlf, seen = "\r\n", F.col("refers_to").isNotNull()
    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]", "")
    body = F.when(seen, F.lit("")).otherwise(F.col("html"))
    head = F.concat(
        F.lit(f"WARC/1.1{crlf}WARC-Type: "),
        F.when(seen, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{crlf}WARC-Record-ID: "),
        _urn(F.col("page_id"), F.col("digest")),
        F.lit(f"{crlf}WARC-Date: {DATE}{crlf}WARC-Target-URI: "),
        uri,
        F.lit(f"{crlf}WARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.when(seen, F.concat(F.lit(f"{crlf}WARC-Profile: {PROFILE}{crlf}WARC-Refers-To: "), _urn(F.col("refers_to"), F.col("digest")))).otherwise(F.lit("")),
        F.lit(f"{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(crlf + crlf),
    )
    return rows.select(F.concat(head, body).alias("record"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES) -> None:
    """Archives of ``pages`` as gzipped WARC files under ``path``, by Spark's own writer: as many as their bytes need, whatever the longest page.

    Null ids, addresses and payloads are written as empty ones, repeated rows each; an empty table makes an archive without records.
    """
    heads = materialize(heads_of(pages, id_col, html_col), "warc-heads")
    held = heads.agg(F.sum(F.col("payload_bytes") + HEAD_BYTES)).first()[0] or 0
    files = max(pages.sparkSession.sparkContext.defaultParallelism, -(-held // FILE_BYTES))
    out = records(pages, id_col, url_col, html_col, least, heads, files)
    out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _inflated(data: bytes) -> Iterator[bytes]:
    """``data`` in pieces of at most STEP bytes if it is gzipped, in one member or many; else as it is."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        d = zlib.decompressobj(31)
        while not d.eof:
            piece = d.decompress(data, STEP)
            if not piece and not d.eof and not d.unconsumed_tail:
                raise ValueError("the archive ends within a member")
            data = d.unconsumed_tail
            yield piece
        data = d.unused_data


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and body of each record of an archive; holds STEP bytes and one record."""
    pieces, held, at = _inflated(data), b"", 0
    while True:
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if (piece := next(pieces, None)) is None:
                if held[at:].strip():
                    raise ValueError("the archive ends within a record")
                return
            held, at = held[at:] + piece, 0
        lines = held[at:end].decode("utf-8").split("\r\n")
        head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        start, size = end + 4, int(head["content-length"])
        if len(held) < start + size + 4:
            parts = [held[start:]]
            while sum(map(len, parts)) < size + 4 and (piece := next(pieces, None)) is not None:
                parts.append(piece)
            held, start = b"".join(parts), 0
        if len(held) < start + size:
            raise ValueError("the archive ends within a record")
        yield head, held[start : start + size]
        at = start + size + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, url, record_type, payload_digest, refers_to, html`` of each record in the archives under ``path``.

    The digest of a response is that of the payload read; it must be the one in its header. An
    empty id is read back as null, an empty address as empty. Records that repeat are rows of
    their own; archives without records give no rows. A task inflates one file in steps and
    holds its longest record.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "html"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]

        def page(urn: str | None) -> int | None:
            number = urn.removeprefix("<urn:page:").split(":")[0] if urn else ""
            return int(number) if number else None

        for b in batches:
            for content in b.column(0):
                out = []
                for head, body in parse(content.as_py()):
                    digest, kind = head["warc-payload-digest"].removeprefix("sha256:"), head["warc-type"]
                    if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"damaged record {head['warc-record-id']}")
                    full = kind == "response"
                    out.append((page(head["warc-record-id"]), head["warc-target-uri"], kind, digest, len(body) if full else None, page(head.get("warc-refers-to")), body.decode("utf-8") if full else None))
                    if len(out) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, html string")


def resolved(archive: DataFrame) -> DataFrame:
    """Records read back, each with its full payload's size: revisits are joined to the responses they name.

    The response is that of the id and digest named, so an id with several payloads does no harm.
    Rows stay as many as they are; no archive, no rows.
    """
    named = archive.where("refers_to IS NOT NULL").select("refers_to", F.col("payload_digest").alias("digest")).distinct()
    responses = archive.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest"), "payload_bytes")
    full = responses.join(named, ["refers_to", "digest"], "left_semi").groupBy("refers_to", "digest").agg(F.max("payload_bytes").alias("full_bytes"))
    out = archive.join(full.withColumnRenamed("refers_to", "_to"), (F.col("refers_to") == F.col("_to")) & (F.col("payload_digest") == F.col("digest")), "left")
    return out.withColumn("payload_bytes", F.coalesce("payload_bytes", "full_bytes")).drop("full_bytes", "_to", "digest")
