"""Chat formatting: typed content parts, a reversible template, a loss mask. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings with a meaning in formatted text (fixed values). Inside texts they are escaped.
CONTROL_WORDS = ("s", "INST", "ROLE", "image", "audio", "document")
#: Tokens that a part's placeholder stands for where the part has no count of its own.
PART_TOKENS = {"image": 256, "audio": 128, "document": 512}
#: Long conversations' ids up to which they are broadcast (8 bytes each); beyond, the same join shuffles.
BROADCAST_ROWS = 1_000_000
#: Turns of a conversation that are formatted together.
SEGMENT = 16
#: The segment of rows without a turn: before any other.
NO_TURN = -(1 << 63)

_ANY = "/?(?:" + "|".join(CONTROL_WORDS) + ")"
#: An opening bracket, backslashes, the rest of a control string: each escape adds a backslash, each unescape takes one.
_ESCAPE = rf"([<\[])(\\*{_ANY}[>\]])"
_UNESCAPE = rf"([<\[])\\(\\*{_ANY}[>\]])"

TURN, ROLE_END, TURN_END = "<s>[ROLE]", "[/ROLE]", "</s>"

PART = "struct<type:string,text:string,ref:string,tokens:bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2")


def text_part(text: Column) -> Column:
    """``content`` of one text part."""
    null = F.lit(None).cast("string")
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), null.alias("ref"), F.lit(None).cast("long").alias("tokens")))


def kind_of(part: Column) -> Column:
    return F.lower(F.coalesce(part["type"], F.lit("text")))


def visit(done: Column, part: Column) -> Column:
    """The visitor's step: ``done`` (body so far, text not yet escaped) after one typed part.

    Texts that follow each other are joined before they are escaped, so a control string dealt
    over two parts is escaped too; a placeholder ends a text. Unknown types count as text, null
    texts and parts are empty.
    """
    text = F.struct(done["body"].alias("body"), F.concat(done["text"], F.coalesce(part["text"], F.lit(""))).alias("text"))
    placeholder = F.concat(done["body"], escape(done["text"]), F.lit("<"), kind_of(part), F.lit(">"))
    return F.when(kind_of(part).isin(*PART_TOKENS), F.struct(placeholder.alias("body"), F.lit("").alias("text"))).otherwise(text)


def body_of(parts: Column) -> Column:
    start = F.struct(F.lit("").alias("body"), F.lit("").alias("text"))
    return F.aggregate(parts, start, visit, lambda done: F.concat(done["body"], escape(done["text"])))


def part_tokens(part: Column) -> Column:
    out = F.lit(0).cast("long")
    for name, n in PART_TOKENS.items():
        out = F.when(kind_of(part) == name, F.coalesce(part["tokens"], F.lit(n).cast("long"))).otherwise(out)
    return out


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "content") -> DataFrame:
    """Conversations in segments of at most 16 turn numbers; concatenated by ``segment`` they are the formatted text.

    turns: one row a turn; ``content`` is an array of parts (type, text, ref, tokens).
    Returns ``conv_id, segment, n_turns, formatted, loss_spans`` (start and length in code
    points of each assistant text), ``attachments`` (turn, part, type, ref, tokens, in order)
    and ``expanded_tokens``, their sum. Rows are ordered by turn, then role, then text; null
    turns come first, null roles, contents and texts are empty. Repeated rows are turns of
    their own. Other columns are not read. Segments of one long conversation are formatted by
    many tasks.
    """
    role = F.coalesce(F.col(role_col), F.lit("")).alias("role")
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role, F.coalesce(F.col(content_col), F.array().cast(f"array<{PART}>")).alias("parts"))
    rows = rows.withColumn("segment", F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(NO_TURN)))
    rows = rows.withColumn("body", body_of(F.col("parts")))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(ROLE_END))
    files = F.filter(
        F.transform("parts", lambda p, i: F.struct(F.col("turn"), i.alias("part"), F.lower(p["type"]).alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens"))),
        lambda f: f["type"].isin(*PART_TOKENS),
    )
    turn = F.struct("turn", "role", "body", head.alias("head"), files.alias("files"))
    out = rows.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    piece = lambda x: F.concat(x["head"], x["body"], F.lit(TURN_END))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        span = F.array(F.struct((acc["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).cast("long").alias("length")))
        return F.struct(
            (acc["at"] + F.length(piece(x))).alias("at"),
            F.when(x["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    attachments = F.flatten(F.transform("t", lambda x: x["files"]))
    return out.select(
        "conv_id",
        "segment",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", piece), "").alias("formatted"),
        F.aggregate("t", start, step)["spans"].alias("loss_spans"),
        attachments.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, f: a + f["tokens"]))


def read_turns(segments: DataFrame) -> DataFrame:
    """``segments`` with ``turns``: array of (role, text) read back from ``formatted``, placeholders as they stand, and ``loss_texts``, what the loss mask covers, unescaped.

    Null roles and texts were written as empty ones and are read so; repeated turns are turns each; no segments, no rows.
    """
    marked = F.split("formatted", TURN_END, -1)
    marked = F.slice(marked, 1, F.size(marked) - 1)
    parts = F.transform(marked, lambda m: F.split(F.substr(m, F.lit(len(TURN) + 1)), r"\[/ROLE\]", 2))
    turns = F.transform(parts, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return segments.withColumn("turns", turns).withColumn("loss_texts", loss)


def conversations_of(segments: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted``, ``n_turns``, ``expanded_tokens``: the segments of a conversation joined in order.

    Conversations without an id are one; a conversation's text is held by one task; no segments, no rows.
    """
    one = F.sort_array(F.collect_list(F.struct("segment", "formatted")))
    out = segments.groupBy("conv_id").agg(one.alias("s"), F.sum("n_turns").alias("n_turns"), F.sum("expanded_tokens").alias("expanded_tokens"))
    return out.select("conv_id", F.array_join(F.transform("s", lambda x: x["formatted"]), "").alias("formatted"), "n_turns", "expanded_tokens")


def digests(segments: DataFrame) -> DataFrame:
    """Digests of each conversation, from what ``read_turns`` reads back.

    A conversation of one segment is digested where it was read; only texts of longer ones are
    moved, to be joined in order. Conversations without an id are one; turns without a number are one segment, and
    so one row; repeated turns count each; no segments, no rows.
    """
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    many = segments.groupBy(F.col("conv_id").alias("_many")).count().where("count > 1").select("_many", F.lit(True).alias("long"))
    many = F.broadcast(many) if many.count() <= BROADCAST_ROWS else many
    rows = read_turns(segments).select("conv_id", "segment", "n_turns", F.length("formatted").alias("chars"), told.alias("told"), F.array_join("loss_texts", "").alias("loss"))
    rows = rows.join(many, F.col("conv_id").eqNullSafe(F.col("_many")), "left")
    digest = lambda t, loss: F.struct(F.sha2(t, 256).alias("turns"), F.length(loss).cast("long").alias("chars"), F.sha2(loss, 256).alias("loss"))
    alone = F.when(F.col("long").isNull(), digest(F.col("told"), F.col("loss")))
    piece = F.when(F.col("long"), F.struct("segment", "told", "loss"))
    out = rows.select("conv_id", "n_turns", "chars", alone.alias("alone"), piece.alias("piece")).groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"), F.first("alone", True).alias("alone"), F.sort_array(F.collect_list("piece")).alias("s")
    )
    joined = lambda name: F.array_join(F.transform("s", lambda x: x[name]), "")
    out = out.withColumn("d", F.coalesce("alone", digest(joined("told"), joined("loss"))))
    return out.select("conv_id", "n_turns", F.col("d.turns").alias("turns_sha256"), F.col("d.chars").alias("loss_chars"), F.col("d.loss").alias("loss_sha256"), "formatted_chars")
