"""Text functions on columns: normalising, fingerprints, tokens, extraction. Null in, null out, unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lex


def words_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")


def contains_any(text: Column, phrases) -> Column:
    """Whether any phrase is a substring; phrases may stand inside words."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def count_contained(text: Column, phrases) -> Column:
    out = F.lit(0)
    for p in phrases:
        out = out + F.contains(text, F.lit(p)).cast("int")
    return out


def norm_text(text: Column) -> Column:
    """Line feeds, single spaces; lines that are empty, noise words, signs and digits only, page marks, addresses or of at most 2 characters go."""
    clean = F.transform(lines(F.regexp_replace(text, r"[ \t]+", " ")), lambda x: F.trim(x))
    low = lambda x: F.lower(x)
    kept = F.filter(
        clean,
        lambda x: (F.length(x) > 2)
        & ~low(x).isin(*lex.NOISE_LINES)
        & ~x.rlike(r"^[#@|/\\\-_=*.,:;~\[\](){}0-9 ]+$")
        & ~low(x).rlike(r"^p[áa]gina +[0-9]+$")
        & ~low(x).startswith("http://")
        & ~low(x).startswith("https://"),
    )
    return F.array_join(kept, "\n")


def norm_question(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r]+", " "))


def norm_local(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9áéíóúñü \t\n\r]", " "), r"[ \t\n\r]+", " "))


def line_shape(line: Column) -> Column:
    """A line in lower case, trimmed, with # for each number and single blanks."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(line)), r"\d+", "#"), r"\s+", " ")


def fold_accents(text: Column) -> Column:
    return F.translate(F.lower(text), lex.ACCENTS, lex.PLAIN)


def norm_match(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(fold_accents(text), r"[^a-z0-9 \t\n\r]", " "), r"[ \t\n\r]+", " "))


def fingerprint(text: Column, chars: int | None = None) -> Column:
    """16 hex digits of the SHA-1 of the lower-cased text, or of its head of ``chars``; empty for empty."""
    head = text if chars is None else F.substring(text, 1, chars)
    return F.when(F.length(text) == 0, F.lit("")).otherwise(F.substring(F.sha1(F.lower(head)), 1, 16))


def bm25_tokens(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-záéíóúñü0-9]+"), F.lit(0)), lambda x: F.length(x) >= 2)


def token_count(text: Column) -> Column:
    """Words and single signs."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\w+|[^\s\w]"), F.lit(0)))


def whole_phrase(text: Column, phrase: Column) -> Column:
    return F.contains(F.concat(F.lit(" "), norm_match(text), F.lit(" ")), F.concat(F.lit(" "), norm_match(phrase), F.lit(" ")))


def tracking_code(text: Column) -> Column:
    """The match of the first pattern, in order, that matches the upper-cased text; null if none does."""
    up = F.upper(F.trim(text))
    return F.coalesce(*[F.nullif(F.regexp_extract(up, p, 0), F.lit("")) for p in lex.TRACKING_CODES])


def detect_lang(text: Column) -> Column:
    """``en`` if it has at least two markers more than ``es``; else ``es``."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.trim(text)), F.lit("[a-z]+"), F.lit(0)))
    en = F.size(F.array_intersect(found, words_array(lex.ENGLISH_MARKERS)))
    es = F.size(F.array_intersect(found, words_array(lex.SPANISH_MARKERS)))
    return F.when(F.length(F.trim(text)) < 3, F.lit("es")).when(en > es + 1, F.lit("en")).otherwise(F.lit("es"))


def truncate_sentence(text: Column, most: int) -> Column:
    """At most ``most`` characters, ended at the last sentence end after position 30, else at the last space with dots."""
    head = F.substring(text, 1, most)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?])", 1)
    word = F.concat(F.trim(F.regexp_extract(head, r"(?s)^(.*) ", 1)), F.lit("..."))
    return F.when(F.length(text) <= most, text).when(F.length(sentence) > 31, F.trim(sentence)).otherwise(word)


def clean_bullets(text: Column) -> Column:
    return F.array_join(F.transform(lines(text), lambda x: F.regexp_replace(x, r"^([ \t]*)[●•▪▸►][ \t]*", "$1- ")), "\n")


def clean_answer(text: Column) -> Column:
    """Cleaner of model answers: hidden thoughts, emphasis, headings and links go, blank lines at most one; line starts become dashes."""
    t = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    for pattern, new in ((r"\*\*([^*]+)\*\*", "$1"), (r"(?m)^#{1,6} +", ""), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"`+", ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
        t = F.regexp_replace(t, pattern, new)
    return F.trim(clean_bullets(t))


def drop_template_lines(text: Column, tags, fallback: str = "") -> Column:
    kept = F.filter(lines(text), lambda x: ~F.lower(F.trim(x)).rlike("^(" + "|".join(tags) + ")"))
    return F.coalesce(F.nullif(F.array_join(kept, "\n"), F.lit("")), F.lit(fallback))


def sanitize_name(text: Column, suffix: str) -> Column:
    base = F.regexp_replace(F.regexp_extract(text, "([^/]*)$", 1), r"[^A-Za-z0-9_.\-]", "_")
    return F.when(F.lower(base).endswith(suffix), base).otherwise(F.concat(base, F.lit(suffix)))


def composite_key(*parts: Column, size: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("||", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, size)


def parse_weight(text: Column) -> Column:
    """Kilograms from the first weight in a text: grams over 100 are scaled, others not; kilos next; else the first bare number, grams if between 100 and 50000."""
    low = F.replace(F.lower(F.trim(text)), F.lit(","), F.lit("."))
    number = r"([0-9]+\.?[0-9]*)"
    first = lambda tail: F.nullif(F.regexp_extract(low, number + tail, 1), F.lit("")).cast("double")
    grams, kilos, bare = first(r"\s*g(?:r(?:amo)?s?)?\b"), first(r"\s*k(?:g|ilo)?s?\b"), first("")
    scaled = lambda x, when: F.when(when, F.round(x / 1000, 3)).otherwise(x)
    return F.when(grams.isNotNull(), scaled(grams, grams > 100)).when(kilos.isNotNull(), kilos).otherwise(scaled(bare, (bare > 100) & (bare < 50000)))


def parse_hour(text: Column, default: float) -> Column:
    """Decimal hours of a text like 8:30 or 8.5; what is neither is ``default``."""
    t = F.trim(text)
    clock = F.regexp_extract(t, r"^\s*([0-9]+)\s*:\s*([0-9]+)\s*$", 1).try_cast("double") + F.regexp_extract(t, r"^\s*([0-9]+)\s*:\s*([0-9]+)\s*$", 2).try_cast("double") / 60
    return F.coalesce(clock, t.try_cast("double"), F.lit(float(default)))


def parse_interval(text: Column) -> Column:
    """``start`` and ``end`` of the first two times HH:MM in a text; null with fewer."""
    times = F.regexp_extract_all(text, F.lit("[0-9]{1,2}:[0-9]{2}"), F.lit(0))
    return F.when(F.size(times) >= 2, F.struct(parse_hour(F.get(times, 0), 0).alias("start"), parse_hour(F.get(times, 1), 0).alias("end")))


def is_open(local: Column, week: tuple[Column, Column], saturday: tuple[Column, Column], sunday: Column) -> Column:
    """Whether a local time is within opening hours: texts of opening and closing on weekdays and Saturdays; Sundays only if their text has an interval."""
    h, day, rest = F.hour(local) + F.minute(local) / 60.0, F.weekday(local), parse_interval(sunday)
    within = lambda start, end: (h >= start) & (h < end)
    weekday = within(parse_hour(week[0], 8.5), parse_hour(week[1], 16.5))
    return F.when(day < 5, weekday).when(day == 5, within(parse_hour(saturday[0], 9), parse_hour(saturday[1], 13))).otherwise(F.coalesce(within(rest["start"], rest["end"]), F.lit(False)))


def json_to_text(payload: Column, most: int = 20) -> Column:
    """A JSON object told line by line; the JSON itself if nothing in it is told; null if it is no object.

    Keys that begin with _ go; of lists the first ``most`` values, joined; of objects each value
    on a line of its own; of texts those of more than 10 characters. Other values go.
    """
    as_text = lambda x: F.from_json(x, "map<string,string>")
    once = lambda x, f: F.get(F.transform(F.array(x), f), 0)  # noqa: E731  # binds a value that is costly and used again

    def line(key: Column, value: Column, kind: Column) -> Column:
        items = F.array_join(F.slice(F.from_json(value, "array<string>"), 1, most), ", ")
        inner = F.array_join(F.transform(F.map_entries(as_text(value)), lambda s: F.concat(F.lit("  "), s["key"], F.lit(": "), F.coalesce(s["value"], F.lit("null")))), "\n")
        return (
            F.when(F.startswith(key, F.lit("_")), F.lit(None).cast("string"))
            .when(F.startswith(kind, F.lit("ARRAY")), F.concat(key, F.lit(": "), items))
            .when(F.startswith(kind, F.lit("OBJECT")), once(inner, lambda x: F.concat_ws("\n", F.concat(key, F.lit(":")), F.nullif(x, F.lit("")))))
            .when((kind == "STRING") & (F.length(value) > 10), F.concat(key, F.lit(": "), value))
        )

    def told(both: Column) -> Column:
        kind = lambda e: F.coalesce(F.schema_of_variant(F.try_element_at(both["kinds"], e["key"])), F.lit(""))
        lines = F.transform(F.map_entries(both["texts"]), lambda e: once(kind(e), lambda k: line(e["key"], e["value"], k)))
        return once(F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n"), lambda t: F.coalesce(F.nullif(t, F.lit("")), F.when(both["texts"].isNotNull(), payload)))

    return once(F.struct(as_text(payload).alias("texts"), F.from_json(payload, "map<string,variant>").alias("kinds")), told)


def lenient_bool(text: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(text, F.lit("")))).isin("false", "0", "no", "off", "")


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(6371.0) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays, in double precision."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    d = lambda x: x.cast("double")
    dot = total(F.zip_with(a, b, lambda x, y: d(x) * d(y)))
    norm = lambda x: F.sqrt(total(F.transform(x, lambda v: d(v) * d(v))))
    return dot / (norm(a) * norm(b))
