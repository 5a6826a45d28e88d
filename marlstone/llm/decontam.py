"""Benchmark decontamination by spaced-seed hashing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Seeds over consecutive tokens; a 0 ignores the token there. Three substitutions in 16 tokens always leave a hit.
MASKS = ("111011", "1101011")
#: What items of 7 tokens need besides: one substitution at the second or the last but one spoils both masks above.
SEVEN = "1011101"
#: Tokens of an overlap, and how many of them must be equal at their places.
WINDOW, SAME = 13, 11
#: Bytes of the small side of a join up to which it is broadcast.
BROADCAST_BYTES = 10_000_000


def token_hashes(text: Column) -> Column:
    """64-bit hashes of a text's tokens: runs of letters and digits, lower-cased. Null has none."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def masks_for(size: int) -> tuple[str, ...]:
    """Masks whose hits leave no overlap of an item of so many tokens out: short items must match whole."""
    shortest = min(map(len, MASKS))
    return ("1" * size,) if size < shortest else (*MASKS, SEVEN) if size == 7 else MASKS


def _seeded(rows: DataFrame, keys: list[str], place: str, masks: list[str], allowed: Column | None = None) -> DataFrame:
    """A row for each mask (that ``allowed``, an array of masks, has) and place: ``keys``, ``place``, ``seed``.

    Places are exploded before seeds are hashed, so hashing runs in generated code and a text's
    tokens are held once. They are exploded through a slice: from a plain column a filter on its
    size would be derived, and tokens made twice.
    """
    each = rows.select(*keys, "tokens", *([allowed.alias("allowed")] if allowed is not None else []), F.posexplode(F.slice("tokens", 1, F.size("tokens"))).alias(place, "first"))
    each = each.withColumn("mask", F.explode(F.array(*[F.lit(m) for m in masks])))
    seed = F.lit(None).cast("long")
    for m in masks:
        taken = [F.get("tokens", F.col(place) + o) for o, x in enumerate(m) if o and x == "1"]
        fits = (F.col("mask") == m) & (F.col(place) + len(m) <= F.size("tokens"))
        seed = F.when(fits, F.xxhash64("first", *taken, F.lit(int(m, 2)))).otherwise(seed)
    if allowed is not None:
        seed = F.when(F.array_contains("allowed", F.col("mask")), seed)
    return each.select(*keys, place, seed.alias("seed")).where("seed IS NOT NULL")


def _known_small(df: DataFrame, tokens: str | None = None) -> DataFrame:
    """``df``, broadcast if it is small enough: 24 bytes a row, which are counted, and 8 for each of its ``tokens``; else joins shuffle it."""
    size = F.lit(24) if tokens is None else F.size(tokens) * 8 + 24
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_key, doc_id, item_id, start, matched, length``: the best verified overlap of each text with each item.

    items: ``item_id, text``. Seeds of both sides are joined; around each hit the tokens on its
    diagonal are compared, and some WINDOW of them (or the whole item, if shorter) must have
    SAME equal (as large a share). Items of fewer tokens than a mask spans are sought whole, so
    even one of a single word is found wherever that word stands; null and empty texts on either
    side match nothing. doc_key is a hash of id and text, the same for rows that repeat both:
    they share one row here. Of diagonals that match as well the first counts. Very long texts
    cost in proportion to their tokens; an empty table on either side gives no rows; other
    columns are not read. start is the token where the item begins in the text, and negative if
    its head is missing.
    """
    key = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("doc_key")
    texts = docs.select(key, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    tests = items.select("item_id", token_hashes(F.col("text")).alias("item")).where(F.size("item") > 0).distinct()
    tests = materialize(tests, "items")
    sizes = sorted(r[0] for r in tests.select(F.least(F.size("item"), F.lit(8))).distinct().collect())  # 8 at most
    masks = sorted({m for n in sizes for m in masks_for(n)})
    if not masks:
        masks = list(MASKS)
    own = F.array(*[F.lit(m) for m in MASKS])
    for n in (n for n in sizes if n < 8):
        own = F.when(F.size("tokens") == n, F.array(*[F.lit(m) for m in masks_for(n)])).otherwise(own)
    marks = materialize(_seeded(tests.withColumnRenamed("item", "tokens"), ["item_id"], "item_place", masks, own).distinct(), "item-seeds")
    found = _seeded(texts.select("doc_key", token_hashes(F.col("text")).alias("tokens")), ["doc_key"], "place", masks).join(_known_small(marks), "seed")
    hits = materialize(found.select("doc_key", "item_id", (F.col("place") - F.col("item_place")).alias("start")).distinct(), "hits")
    held = hits.select("doc_key").distinct()
    near = texts.join(_known_small(held), "doc_key", "left_semi").select("doc_key", "doc_id", token_hashes(F.col("text")).alias("tokens"))
    pairs = near.dropDuplicates(["doc_key"]).join(hits, "doc_key").join(_known_small(tests, "item"), "item_id")
    size = F.size("item")
    same = F.transform("item", lambda x, j: F.when((F.col("start") + j >= 0) & (F.get("tokens", F.greatest(F.col("start") + j, F.lit(0))) == x), 1).otherwise(0))
    wide = F.least(size, F.lit(WINDOW))
    firsts = F.sequence(F.lit(1), size - wide + 1)
    best = F.array_max(F.transform(firsts, lambda i: F.aggregate(F.slice(F.col("same"), i, wide), F.lit(0), lambda a, x: a + x)))
    checked = pairs.select("doc_key", "doc_id", "item_id", "start", "item", same.alias("same"))
    checked = checked.where(best >= F.ceil(wide * SAME / WINDOW))
    total = F.aggregate("same", F.lit(0), lambda a, x: a + x).cast("long")
    checked = checked.select("doc_key", "doc_id", "item_id", "start", total.alias("matched"), size.cast("long").alias("length"))
    first = F.struct((-F.col("matched")).alias("m"), "start", "length")
    out = checked.groupBy("doc_key", "doc_id", "item_id").agg(F.min(first).alias("b"))
    return out.select("doc_key", "doc_id", "item_id", F.col("b.start").cast("long").alias("start"), (-F.col("b.m")).alias("matched"), "b.length")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap no item, all columns as they are.

    Null and empty texts stay, as does every row if there are no items; rows that repeat stay or
    go together. Columns of any other names are carried along.
    """
    bad = materialize(overlaps(docs, items, id_col, text_col).select(F.col("doc_key").alias("_bad")).distinct(), "contaminated")
    key = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    bad = _known_small(bad)
    return docs.join(bad, key == bad["_bad"], "left_anti")
