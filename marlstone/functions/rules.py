"""Rule classifiers: ordered CASE expressions over text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lex
from .text import contains_any, lines, norm_local, norm_match, tracking_code, words_array


def word_set(text: Column) -> Column:
    return F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower(text), r"[^0-9a-zà-ÿ_\s]", " ")), r"\s+"))


def any_pattern(patterns, unless=None) -> str:
    """One Java pattern of several, and of those that must not be followed by one of their exceptions."""
    return "|".join([*patterns, *(f"{p}(?!{'|'.join(x)})" for p, x in (unless or {}).items())])


def is_injection(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"(?iusU)(?:{any_pattern(lex.INJECTION, lex.INJECTION_UNLESS)})")


def stems(pattern: str) -> list[str]:
    """Literal texts one of which every match of a pattern contains: the best that a part of it which must be there tells. Empty if none is."""
    from re import _constants as c
    from re import _parser

    def best(parts) -> list[str]:
        options, run = [], ""
        for op, arg in [*parts, (None, None)]:
            if op is c.LITERAL:
                run += chr(arg)
                continue
            options += [[run]] if run else []
            run = ""
            if op is c.BRANCH:
                each = [best(x) for x in arg[1]]
                options += [sorted({w for x in each for w in x})] if all(each) else []
            elif op is c.SUBPATTERN:
                options.append(best(arg[-1]))
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[0] > 0:
                options.append(best(arg[2]))
        return max(options, key=lambda x: min(map(len, x), default=0), default=[])

    return best(_parser.parse(pattern))


def found_by_stems(text: Column, patterns, unless=None) -> Column:
    """Whether one of several patterns is found; each is looked for only in texts that contain a text which it needs."""
    out = F.lit(False)
    for p, exceptions in [*((p, None) for p in patterns), *(unless or {}).items()]:
        here = text.rlike(f"(?U)(?:{p}{f'(?!{"|".join(exceptions)})' if exceptions else ''})")
        out = out | ((contains_any(text, needed) & here) if (needed := stems(p)) else here)
    return out


def has_word(text: Column, words) -> Column:
    """Whether one of some words stands in a lower-case text between signs that are no letter, digit or low line."""
    return text.rlike(f"(?<![0-9a-zà-ÿ_])(?:{'|'.join(words)})(?![0-9a-zà-ÿ_])")


def is_out_of_domain(text: Column) -> Column:
    """Network questions are; texts with a domain word are not; then off-topic patterns are, and alien words without a word of postal intent."""
    t = F.lower(F.trim(text))
    network = contains_any(t, ("ip", "dns", "scan", "puerto")) & t.rlike(f"(?U)(?:{any_pattern(lex.NETWORK)})")
    out = (
        F.when(F.length(t) == 0, False)
        .when(network, True)
        .when(has_word(t, lex.DOMAIN), False)
        .when(found_by_stems(t, lex.OFF_TOPIC, lex.OFF_TOPIC_UNLESS), True)
        .otherwise(has_word(t, lex.ALIEN) & ~has_word(t, lex.POSTAL_INTENT))
    )
    return F.coalesce(out, F.lit(False))


def is_hallucination(answer: Column) -> Column:
    return contains_any(F.lower(F.coalesce(answer, F.lit(""))), lex.HALLUCINATION)


def is_tracking(text: Column) -> Column:
    """Whether a text has a tracking code or asks for one."""
    asks = text.rlike("(?iuU)\\b(" + "|".join(lex.TRACKING_WORDS) + ")\\b")
    return F.coalesce(tracking_code(text).isNotNull() | asks, F.lit(False))


def is_off_topic_answer(question: Column, answer: Column) -> Column:
    """Whether an answer has no word of the domain and no key word of its question, which has some."""
    said = F.lower(answer)
    keys = F.filter(word_set(question), lambda w: (F.length(w) >= 4) & ~w.isin(*lex.QUESTION_STOPS))
    off = ~contains_any(said, lex.ANSWER_DOMAIN) & (F.size(keys) > 0) & ~F.exists(keys, lambda w: F.contains(said, w))
    return F.coalesce((F.length(question) > 0) & (F.length(answer) > 0) & off, F.lit(False))


def invented_data(answer: Column, context: Column, known=()) -> Column:
    """Concrete data of an answer (long numbers, decimals, amounts with units, phones) that its context lacks.

    Years, short ranges and what holds one of the ``known`` numbers are left out. Empty if the
    context has fewer than 50 characters. Repeats count.
    """
    found = F.regexp_extract_all(answer, F.lit("(?iU)" + "|".join(lex.CONCRETE_DATA)), F.lit(0))
    bare = lambda x: F.regexp_replace(F.lower(x), r"(?U)[.,\s\-–]", "")

    def invented(x: Column) -> Column:
        tight = F.regexp_replace(F.lower(x), r"(?U)\s+", "")
        general = tight.rlike(r"^(1[89][0-9]{2}|20[0-9]{2}|[0-9]{1,3}[-–][0-9]{1,3})$") | contains_any(tight, known)
        return ~general & ~F.contains(bare(context), bare(x))

    return F.when((F.length(answer) > 0) & (F.length(F.trim(context)) >= 50), F.filter(found, invented)).otherwise(F.array().cast("array<string>"))


def has_invented_data(answer: Column, context: Column, known=(), least: int = 5) -> Column:
    return F.coalesce(F.size(invented_data(answer, context, known)) >= least, F.lit(False))


def quick_replies(answer: Column, lang: Column, most: int = 3) -> Column:
    """Replies to offer after an answer, by its language and words, in order; at most ``most``."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    offered = lambda rules: F.flatten(F.array(*[F.when(contains_any(low, words), words_array(said)).otherwise(F.array().cast("array<string>")) for words, said in rules]))
    return F.slice(F.when(lang == "en", offered(lex.QUICK_REPLIES["en"])).otherwise(offered(lex.QUICK_REPLIES["es"])), 1, most)


def location_of(text: Column, places) -> Column:
    """``asked`` and ``place``: whether a text asks for a location, aliases of cities rewritten one after the other, and the first place that it then contains."""
    t = F.lower(text)
    for alias, city in lex.CITY_ALIASES.items():
        t = F.replace(t, F.lit(alias), F.lit(city))
    asked = contains_any(t, lex.LOCATION)
    first = F.coalesce(*[F.when(F.contains(t, F.lit(p)), F.lit(p)) for p in places])
    return F.struct(F.coalesce(asked, F.lit(False)).alias("asked"), F.when(asked, first).alias("place"))


def city_of(branch: str) -> str:
    """A branch's city: its name in lower case without what kind of office it is."""
    return re.sub(r"^(regional|oficina\s+central)\s*:\s*", "", branch.lower()).strip()


def only_city(text: Column, branches: list[str]) -> Column:
    """The first of a few branches whose city is, or contains, a text that names one by itself; aliases count. Null if none does."""
    t = F.lower(F.trim(text))
    names = F.create_map(*[F.lit(x) for kv in lex.CITY_ALIASES.items() for x in kv])
    t = F.coalesce(F.try_element_at(names, t), t)
    return F.coalesce(*[F.when(F.contains(F.lit(city_of(b)), t), F.lit(b)) for b in branches if city_of(b)])


def location_scope(text: Column) -> Column:
    """``regionales`` or ``sucursales``: by the whole text, then by words in it, regional ones first; null if neither."""
    t = F.lower(F.trim(text))
    regional, branch = F.lit("regionales"), F.lit("sucursales")
    return (
        F.when(t.isin("__ubicacion_regionales__", "regional", "regionales"), regional)
        .when(t.isin("__ubicacion_sucursales__", "sucursal", "sucursales"), branch)
        .when(t.rlike(r"(?U)\b(regional|regionales|oficina central)\b"), regional)
        .when(t.rlike(r"(?U)\b(sucursal|sucursales)\b"), branch)
    )


def best_label(text: Column, labels: list[tuple[str, str]], known: dict[str, str] | None = None) -> Column:
    """The value of the label, of a few (value, label) in order, that a text means; null if none.

    The first label that contains the text or stands in it; else the first with a word in it;
    else the value of the first of ``known`` that stands in it.
    """
    t = F.lower(F.trim(text))
    tiers = [F.when(F.contains(F.lit(name.lower()), t) | F.contains(t, F.lit(name.lower())), F.lit(value)) for value, name in labels]
    tiers += [F.when(contains_any(t, name.lower().split()), F.lit(value)) for value, name in labels]
    tiers += [F.when(F.contains(t, F.lit(key)), F.lit(value)) for key, value in (known or {}).items()]
    return F.coalesce(*tiers, F.lit(None).cast("string"))


def is_smalltalk(text: Column) -> Column:
    """All words are small talk, or a text of at most 15 characters has no domain word in it and doesn't start like a question."""
    t = F.lower(F.trim(text))
    every = F.forall(F.split(t, r"\s+"), lambda w: w.isin(*lex.SMALLTALK))
    question = t.rlike(r"^(" + "|".join(lex.QUESTION_STARTS) + r")([^a-z0-9_à-ÿ]|$)")
    return (F.length(t) > 0) & (every | ((F.length(t) <= 15) & ~contains_any(t, lex.DOMAIN) & ~question))


def is_greeting(text: Column) -> Column:
    return F.trim(text).rlike(f"(?iuU){lex.GREETING}") | is_smalltalk(text)


def is_terse(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return (F.length(t) <= 3) | t.isin(*lex.TERSE)


def is_incomplete(text: Column) -> Column:
    """Whether an answer breaks off."""
    t = F.rtrim(text)
    last = F.substring(t, -1, 1)
    word = F.rtrim(F.lower(F.element_at(F.split(t, r"\s+"), -1)), F.lit(".,;:"))
    items = F.filter(F.transform(lines(t), lambda x: F.trim(x)), lambda x: x.rlike(r"^[-*•]? *[A-Za-z0-9_][^:]{1,40}: *.+"))
    short_item = (F.size(items) >= 2) & (F.length(F.trim(F.regexp_extract(F.element_at(items, -1), "^[^:]*:(.*)$", 1))) < 8)
    return (
        F.when(F.length(F.trim(text)) < 20, False)
        .when(last.isin(".", "!", "?", "…"), F.coalesce(short_item, F.lit(False)))
        .when(last.isin(",", ":", ";", "-", "–", "—", "("), True)
        .when(word.isin(*lex.LAST_WORDS), True)
        .otherwise((F.length(t) > 80) & last.rlike(r"^\p{L}$"))
    )


def is_structured(text: Column) -> Column:
    t = F.trim(text)
    return (F.length(t) > 0) & (t.rlike(r"^(```|\{|\[|dict\(|json|python)") | F.contains(t, F.lit("\n")) | t.rlike(r"(^|\s)([0-9]+\.\s|[•\-]\s)"))


def is_useful(text: Column) -> Column:
    return (F.length(F.trim(text)) >= 40) & (F.length(F.regexp_replace(text, r"[^\p{L}]", "")) >= 20)


def letter_ratio(line: Column) -> Column:
    return F.length(F.regexp_replace(line, r"[^\p{L}]", "")) / F.greatest(F.length(line), F.lit(1))


def is_noise_line(line: Column, least: float = 0.18, least_in_table: float = 0.35) -> Column:
    """Empty, two characters at most, rules, table rows and sign runs with few letters, page marks, addresses."""
    x = F.trim(line)
    shape = F.regexp_replace(F.lower(x), "[0-9]+", "#")
    return (
        (F.length(x) <= 2)
        | x.rlike(r"^[-_=|+.:;, ]{3,}$")
        | ((F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2) & (letter_ratio(x) < least_in_table))
        | shape.rlike(r"^p[áa]gina +#( +de +#)?$")
        | shape.isin("www", "http", "https", "comparte", "share", "menu", "inicio")
        | shape.rlike(r"^https?://[^ ]+$")
        | ((letter_ratio(x) < least) & x.rlike(r"[|+\-_=]{2,}"))
    )


def special_query(text: Column, phrases) -> Column:
    """``tracking`` if the text has a code, ``capabilities`` if one of the phrases stands in it as a whole, else null."""
    padded = F.concat(F.lit(" "), norm_match(text), F.lit(" "))
    asked = contains_any(padded, [f" {p} " for p in phrases])
    return F.when(tracking_code(text).isNotNull(), "tracking").when(asked, "capabilities")


def escalation_reason(confidence: Column, response: Column, error: Column, asked: Column) -> Column:
    unsure = contains_any(F.lower(response), lex.UNCERTAIN)
    return F.when(asked, "user_request").when(error, "error").when(confidence < 0.3, "low_confidence").when(unsure, "uncertain_response").otherwise("")


def evidence_quotes(answer: Column) -> Column:
    """What stands in quotation marks on the first line of an answer that begins with "Evidencia:"; blank quotes go."""
    said = F.get(F.filter(lines(answer), lambda x: F.startswith(F.lower(F.trim(x)), F.lit("evidencia:"))), F.lit(0))
    quotes = F.transform(F.regexp_extract_all(said, F.lit('"([^"]+)"'), F.lit(1)), lambda x: F.trim(x))
    return F.coalesce(F.filter(quotes, lambda x: x != ""), F.array().cast("array<string>"))


def quotes_stand(quotes: Column, context: Column) -> Column:
    """Whether there are quotes and all of them stand in the context as they are."""
    return (F.size(quotes) > 0) & F.forall(quotes, lambda x: F.contains(F.coalesce(context, F.lit("")), x))


def grounded(answer: Column, context: Column, least: int = 2) -> Column:
    """Whether a context supports an answer: it holds all the answer's quotes, or ``least`` distinct words and every number of it.

    Words have four letters or more and are no stop words; they are looked for in the normalised context, in longer words
    too, numbers (with a decimal sign) in the context as it is.
    """
    found = F.array_distinct(F.regexp_extract_all(F.lower(answer), F.lit("[a-záéíóúñü0-9]+"), F.lit(0)))
    words = F.filter(found, lambda w: (F.length(w) >= 4) & ~w.isin(*lex.EVIDENCE_STOPS))
    told = F.get(F.transform(F.array(norm_local(context)), lambda c: F.size(F.filter(words, lambda w: F.contains(c, w)))), F.lit(0))
    numbers = F.forall(F.regexp_extract_all(answer, F.lit(r"(?U)\b\d+[.,]?\d*\b"), F.lit(0)), lambda n: F.contains(context, n))
    both = (F.length(answer) > 0) & (F.length(context) > 0)
    return F.coalesce(both & (quotes_stand(evidence_quotes(answer), context) | ((told >= least) & numbers)), F.lit(False))
