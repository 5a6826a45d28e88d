"""Texts that are said without a model: redirections, canned answers, special queries, files told in words."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lex
from .rules import any_pattern
from .text import clean_answer, contains_any, json_to_text


def redirect_topic(question: Column) -> Column:
    """The first topic of which a word stands in a question, maybe within a longer word; null if none does."""
    t = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    return F.coalesce(*[F.when(contains_any(t, words), F.lit(topic)) for topic, words in lex.REDIRECT_TOPICS.items()])


def redirection(question: Column, lang: Column, answers: Mapping[str, str], standard: str) -> Column:
    """What a question out of scope is told: a refusal if it is about the network, else the answer to its topic, else the standard one."""
    network = F.coalesce(question, F.lit("")).rlike(f"(?iuU)(?:{any_pattern(lex.NETWORK)})")
    refused = F.when(lang == "en", lex.REFUSALS["en"]).otherwise(lex.REFUSALS["es"])
    by_topic = F.create_map(*[F.lit(x) for kv in answers.items() for x in kv])
    return F.when(network, refused).otherwise(F.coalesce(F.try_element_at(by_topic, redirect_topic(question)), F.lit(standard)))


def empty_answer(question: Column, lang: Column) -> Column:
    """What is said while nothing is loaded: another sentence to a greeting."""
    greets = contains_any(F.lower(F.trim(F.coalesce(question, F.lit("")))), lex.EMPTY_GREETINGS)
    (hola, nada), (hello, nothing) = lex.EMPTY_ANSWERS["es"], lex.EMPTY_ANSWERS["en"]
    return F.when(lang == "en", F.when(greets, hello).otherwise(nothing)).otherwise(F.when(greets, hola).otherwise(nada))


def no_info_line(question: Column, lang: Column, skill: Column, most: int = 200) -> Column:
    """A log line for a question that found nothing."""
    known = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("?"))
    return F.concat(F.lit("SIN_INFO | pregunta='"), F.left(F.trim(F.coalesce(question, F.lit(""))), F.lit(most)), F.lit("' | lang="), known(lang), F.lit(" | skill="), known(skill))


def preview(text: Column) -> Column:
    """An answer while it still comes: cleaned, single blanks, one blank line at most."""
    return F.trim(F.regexp_replace(F.regexp_replace(clean_answer(text), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def special_answer(kind: Column, templates: Mapping[str, Column]) -> Column:
    """The answer to a special query of some kind, one of ``templates``; null for none, an error for a kind that is unknown."""
    out = F.when(kind.isNull(), F.lit(None).cast("string"))
    for name, told in templates.items():
        out = out.when(kind == name, told)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown special query: "), kind)).cast("string"))


def request_limit(path: Column, method: Column, chat: int, default: int) -> Column:
    """Requests that a client may make in a window, by what it asks for; null where there is no limit."""
    return F.when((path == "/api/chat") & (method == "POST"), chat).when(F.startswith(path, F.lit("/api/")), default)


def _field(payload: Column, path: str, default: str = "") -> Column:
    return F.coalesce(F.get_json_object(payload, path), F.lit(default))


def _items(payload: Column, path: str, kind: str) -> Column:
    return F.coalesce(F.from_json(F.get_json_object(payload, path), f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def json_file_text(name: Column, payload: Column, owner: str = "the institution", defaults: Mapping[str, str] | None = None) -> Column:
    """A JSON file told in words, by what its name says it is: an institution, links, contacts; else as ``json_to_text`` does.

    ``owner`` is whom it is about; ``defaults`` are told where a field (former, year, decree, renamed, phone, mail, web, tracking) is missing.
    """
    known = {**dict.fromkeys(("former", "year", "decree", "renamed", "phone", "mail", "web", "tracking"), ""), **(defaults or {})}
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    get = lambda path, key="": _field(payload, path, known.get(key, ""))
    links = "struct<nombre:string,url:string,descripcion:string>"
    empty = lambda x: F.coalesce(x, F.lit(""))

    def listed(path: str, head: str, line) -> Column:
        rows = _items(payload, path, links)
        return F.when(F.size(rows) > 0, F.concat(F.lit(head), F.array_join(F.transform(rows, lambda e: F.concat(F.lit("\n- "), line(e))), "")))

    institution = F.concat_ws(
        "\n\n",
        say(f"{owner} es la institucion postal nacional. Antes se llamaba ", get("$.institucion.nombre_anterior", "former"), ". Fue creada en ", get("$.institucion.anio_creacion", "year"), " mediante decreto ", get("$.institucion.decreto_creacion", "decree"), ". En ", get("$.institucion.anio_nombre_actual", "renamed"), " adopto su nombre actual."),
        say("Contacto: telefono ", get("$.contacto.telefono", "phone"), ", email ", get("$.contacto.email", "mail"), ", web ", get("$.contacto.web_url", "web")),
        say("Horario de atencion: ", get("$.horario.semana"), ". Sabados: ", get("$.horario.sabado"), ". Domingos cerrado."),
        say("Para rastrear envios usa el codigo de tracking en ", get("$.tracking.url", "tracking"), ". Ejemplo de codigo: ", get("$.tracking.ejemplo_codigo"), "."),
        listed("$.servicios", "Servicios disponibles:", lambda e: F.concat(empty(e["nombre"]), F.lit(": "), empty(e["descripcion"]))),
        listed("$.enlaces", f"Enlaces utiles de {owner}:", lambda e: F.concat(empty(e["nombre"]), F.lit(": "), empty(e["url"]))),
    )
    whole = F.from_json(payload, f"array<{links}>")
    rows = F.coalesce(F.when(F.startswith(F.ltrim(payload), F.lit("[")), whole), _items(payload, "$.enlaces", links))
    enlaces = F.concat(F.lit(f"Enlaces de interes de {owner}:"), F.array_join(F.transform(rows, lambda e: F.concat(F.lit("\n- "), empty(e["nombre"]), F.lit(": "), empty(e["url"]), F.lit(". "), empty(e["descripcion"]))), ""))
    kinds = F.transform_values(F.from_json(payload, "map<string,variant>"), lambda k, v: F.schema_of_variant(v))
    entries = F.map_entries(F.from_json(payload, "map<string,string>"))

    def contact(e: Column) -> Column:
        kind = F.coalesce(F.try_element_at(kinds, e["key"]), F.lit(""))
        return F.when(kind == "STRING", F.concat(e["key"], F.lit(": "), e["value"])).when(F.startswith(kind, F.lit("ARRAY")), F.concat(e["key"], F.lit(": "), F.array_join(F.from_json(e["value"], "array<string>"), ", ")))

    contacts = F.array_join(F.concat(F.array(F.lit(f"Informacion de contacto institucional de {owner}:")), F.filter(F.transform(entries, contact), lambda x: x.isNotNull())), "\n")
    is_institution = F.contains(name, F.lit("institucion")) & F.startswith(F.coalesce(F.get_json_object(payload, "$.institucion"), F.lit("")), F.lit("{"))
    return F.when(is_institution, institution).when(F.contains(name, F.lit("enlaces")), enlaces).when(F.contains(name, F.lit("contacto")), F.coalesce(contacts, F.lit(f"Informacion de contacto institucional de {owner}:"))).otherwise(F.coalesce(json_to_text(payload), payload))
