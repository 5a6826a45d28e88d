"""Texts said without a model, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import replies as R
from ..functions import text as T
from ..functions.rules import special_query
from ..operators import aggregates as A
from ..session import spread, table
from ..streaming import state as S
from .answers import completed
from .registry import ORACLE_SQL, query, sql_list
from . import table_queries  # noqa: F401  its SQL is part of one here
from .rule_queries import _BROKEN_SQL, _re
from .text_queries import clean_sql

_WORDS = [w for words in lex.REDIRECT_TOPICS.values() for w in words]
_ANSWERS = {"country": "we send anywhere", "weather": "no weather here", "sports": "parcels only"}
_HINTS = ["dame la ip", "", *_WORDS]
_Q = f"(text || ' ' || {sql_list(_HINTS)}[doc_id % {len(_HINTS)} + 1])"


def _hinted(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spread(d).select("doc_id", F.concat("text", F.lit(" "), F.get(T.words_array(_HINTS), (F.col("doc_id") % len(_HINTS)).cast("int"))).alias("q"), F.when(F.col("doc_id") % 2 == 0, "en").otherwise("es").alias("lang"))


def _topic_sql(column: str) -> str:
    each = " ".join(f"WHEN len(list_filter({sql_list(words)}, lambda w: contains({column}, w))) > 0 THEN '{topic}'" for topic, words in lex.REDIRECT_TOPICS.items())
    return f"CASE {each} END"


@query(f"""WITH q AS (SELECT doc_id, {_Q} AS q, doc_id % 2 = 0 AS en FROM documents), t AS (SELECT *, {_topic_sql("lower(trim(q))")} AS topic, regexp_matches(lower(q), '{_re(lex.NETWORK)}') AS network FROM q)
SELECT doc_id, topic, CASE WHEN network THEN CASE WHEN en THEN '{lex.REFUSALS["en"]}' ELSE '{lex.REFUSALS["es"]}' END {" ".join(f"WHEN topic = '{k}' THEN '{v}'" for k, v in _ANSWERS.items())} ELSE 'post only' END AS answer FROM t""")
def redirect_text(spark, sf_dir):
    """What texts, with a hint at a topic put in, are told when they are out of scope."""
    rows = _hinted(spark, sf_dir)
    return rows.select("doc_id", R.redirect_topic(F.col("q")).alias("topic"), R.redirection(F.col("q"), F.col("lang"), _ANSWERS, "post only").alias("answer"))


_GREETS = f"len(list_filter({sql_list(lex.EMPTY_GREETINGS)}, lambda w: contains(lower(trim(text)), w))) > 0"


@query(f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN {_GREETS} THEN '{lex.EMPTY_ANSWERS["en"][0]}' ELSE '{lex.EMPTY_ANSWERS["en"][1]}' END ELSE CASE WHEN {_GREETS} THEN '{lex.EMPTY_ANSWERS["es"][0]}' ELSE '{lex.EMPTY_ANSWERS["es"][1]}' END END AS answer,
  'SIN_INFO | pregunta=''' || left(trim(text), 200) || ''' | lang=' || coalesce(nullif(lang, ''), '?') || ' | skill=' || coalesce(nullif(source, ''), '?') AS line FROM documents""")
def empty_answers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    lang = F.when(F.col("doc_id") % 2 == 0, "en").otherwise("es")
    return d.select("doc_id", R.empty_answer(F.col("text"), lang).alias("answer"), R.no_info_line(F.col("text"), F.col("lang"), F.col("source")).alias("line"))


@query(f"SELECT doc_id, trim(regexp_replace(regexp_replace({clean_sql('t')}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')) AS shown FROM (SELECT doc_id, '<think>a' || chr(10) || '</think>**' || replace(text, '. ', '.' || repeat(chr(10), 4) || '●  ') AS t FROM documents)")
def preview(spark, sf_dir):
    """Answers as they are shown while they come."""
    built = F.concat(F.lit("<think>a\n</think>**"), F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n\n\n●  ")))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", R.preview(built).alias("shown"))


_SAID = ["is the shop open", "C0007A02018BO", "todo de la casa", "R123456789BO is the one", "nothing"]


@query(f"""WITH s AS (SELECT count(*) AS n, count(*) FILTER (WHERE s_acctbal > 0) AS placed FROM supplier),
k AS (SELECT o_orderkey, {sql_list(_SAID)}[o_orderkey % 5 + 1] || ' ' || (o_orderkey % 7) AS t FROM orders),
c AS (SELECT *, nullif(regexp_extract(upper(t), '[A-Z][0-9]+[A-Z][0-9]+BO|[A-Z][0-9]{{6,}}BO', 0), '') AS code FROM k)
SELECT o_orderkey, CASE WHEN code IS NOT NULL THEN code || ': https://tracking.example/search?tracking=' || code WHEN contains(t, 'is the') OR contains(t, 'de la') THEN 'branches: ' || n || ', placed: ' || placed || ', not placed: ' || (n - placed) END AS answer FROM c, s""")
def special_answers(spark, sf_dir):
    """Special queries answered from templates and the tables' figures."""
    s = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"), F.count_if(F.col("s_acctbal") > 0).alias("placed"))
    said = F.concat(F.get(T.words_array(_SAID), (F.col("o_orderkey") % 5).cast("int")), F.lit(" "), (F.col("o_orderkey") % 7).cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", said.alias("t")).withColumn("kind", special_query(F.col("t"), ["is the", "de la"]))
    code = T.tracking_code(F.col("t"))
    figures = F.concat(F.lit("branches: "), F.col("n").cast("string"), F.lit(", placed: "), F.col("placed").cast("string"), F.lit(", not placed: "), (F.col("n") - F.col("placed")).cast("string"))
    told = {"tracking": F.concat(code, F.lit(": https://tracking.example/search?tracking="), code), "capabilities": figures}
    return rows.join(F.broadcast(s)).select("o_orderkey", R.special_answer(F.col("kind"), told).alias("answer"))


@query(f"""WITH s AS (SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders), q AS ({ORACLE_SQL["priority_queue"]})
SELECT o_orderkey, urgency, total::BIGINT AS total, pending::BIGINT AS pending, done::BIGINT AS done FROM (SELECT o_orderkey, urgency FROM q JOIN orders USING (o_orderkey) ORDER BY urgency, o_orderdate, o_orderkey LIMIT 20), s""")
def ticket_queue(spark, sf_dir):
    """The head of the queue, 20 tickets, with the figures of all."""
    from .registry import QUERIES

    o = table(spark, sf_dir, "orders")
    figures = o.agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return A.with_figures(QUERIES["priority_queue"](spark, sf_dir).limit(20), figures)


def _more(texts):
    return [f"**{len(t)}** more." if len(t) % 3 == 0 else "" if len(t) % 3 == 1 else None for t in texts]


@query(f"""WITH i AS (SELECT doc_id, text, rtrim(text) AS t FROM documents), j AS (SELECT *, substring(t, -1, 1) AS l, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '^[-*•]? *[A-Za-z0-9_][^:]{{1,40}}: *.+')) AS items,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '^[-*•]?\\s*[\\pL\\pN\\pM_][^:]{{1,40}}:'))) >= 2 AS list FROM i), k AS (SELECT *, coalesce({_BROKEN_SQL}, false) AS broken FROM j)
SELECT doc_id, CASE WHEN NOT broken THEN text WHEN length(text) % 3 = 0 THEN text || CASE WHEN list THEN chr(10) WHEN regexp_matches(substring(text, -1, 1), '^\\pL$') THEN ' ' ELSE '' END || length(text) || ' more.' WHEN ends_with(rtrim(text), '?') THEN text ELSE text || ' ¿Necesitas más detalles?' END AS answer FROM k""")
def completed_answers(spark, sf_dir):
    """Texts that break off, continued by a model interface (a stub, which the SQL knows)."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("answer")))
    return completed(d, "answer", _more)


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, event_id, CASE WHEN event_type = 'click' THEN 3 WHEN event_type IN ('purchase', 'view') THEN 6 END AS most, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS event_id, 0::BIGINT AS rn, 0 AS status, 0::BIGINT AS free, []::BIGINT[] AS held FROM events
  UNION ALL SELECT user_id, event_id, rn, CASE WHEN most IS NULL OR len(h) < most THEN 200 ELSE 429 END, greatest(most - len(h) - CASE WHEN len(h) < most THEN 1 ELSE 0 END, CASE WHEN most IS NOT NULL THEN 0 END), CASE WHEN most IS NULL THEN held WHEN len(h) < most THEN list_append(h, us) ELSE h END
  FROM (SELECT e.*, held, list_filter(held, lambda x: e.us - x < 86400000000) AS h FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
SELECT user_id, event_id, status::INTEGER AS status, free::INTEGER AS "left" FROM r WHERE rn > 0""")
def limited_paths(spark, sf_dir):
    """Requests a client may make in a day, by what it asks for, with what it has left; a recurrence."""
    kind = F.col("event_type")
    path = F.when(kind.isin("click", "purchase"), "/api/chat").when(kind == "view", "/api/pages").otherwise("/static")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), R.request_limit(path, F.when(kind == "click", "POST").otherwise("GET"), 3, 6).alias("most"))
    out = S.rate_limit(e, "user_id", "us", "event_id", "most", 86_400_000_000)
    return out.select("user_id", "event_id", F.when(F.col("accepted"), 200).otherwise(429).alias("status"), "left")


_TOLD_LINK = "chr(10) || '- ' || s_name || ': u' || s_suppkey"
_DETAIL = "CASE WHEN s_suppkey % 2 = 0 THEN 'd ' || s_nationkey ELSE '' END"


@query(f"""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'Enlaces de interes de Acme:' || {_TOLD_LINK} || '. ' || {_DETAIL} || chr(10) || '- : . ' WHEN 1 THEN 'Informacion de contacto institucional de Acme:' || chr(10) || 'a: ' || s_name || chr(10) || 'b: x, 2'
  WHEN 2 THEN 'Acme es la institucion postal nacional. Antes se llamaba Old. Fue creada en ' || s_suppkey || ' mediante decreto . En  adopto su nombre actual.' || chr(10) || chr(10) || 'Contacto: telefono 5, email , web ' || chr(10) || chr(10) || 'Horario de atencion: w. Sabados: . Domingos cerrado.'
    || chr(10) || chr(10) || 'Para rastrear envios usa el codigo de tracking en . Ejemplo de codigo: .' || chr(10) || chr(10) || 'Enlaces utiles de Acme:' || {_TOLD_LINK}
  WHEN 3 THEN 'long: a long text of ' || s_name ELSE 'Enlaces de interes de Acme:' || {_TOLD_LINK} || '. ' || {_DETAIL} END AS told FROM supplier""")
def json_files(spark, sf_dir):
    """JSON files told in words by the kind that their names say they are."""
    key = F.col("s_suppkey")
    link = F.concat(F.lit('{"nombre":"'), "s_name", F.lit('","url":"u'), key.cast("string"), F.lit('"'), F.when(key % 2 == 0, F.concat(F.lit(',"descripcion":"d '), F.col("s_nationkey").cast("string"), F.lit('"'))).otherwise(""), F.lit("}"))
    file = F.get(T.words_array(["enlaces_interes.json", "contacto_x.json", "institucion.json", "other.json", "enlaces.json"]), (key % 5).cast("int"))
    payload = (
        F.when(key % 5 == 0, F.concat(F.lit("["), link, F.lit(",{}]")))
        .when(key % 5 == 1, F.concat(F.lit('{"a":"'), "s_name", F.lit('","b":["x",2],"c":3}')))
        .when(key % 5 == 2, F.concat(F.lit('{"institucion":{"anio_creacion":'), key.cast("string"), F.lit('},"horario":{"semana":"w"},"enlaces":['), link, F.lit("]}")))
        .when(key % 5 == 3, F.concat(F.lit('{"long":"a long text of '), "s_name", F.lit('"}')))
        .otherwise(F.concat(F.lit('{"enlaces":['), link, F.lit("]}")))
    )
    return table(spark, sf_dir, "supplier").select("s_suppkey", R.json_file_text(file, payload, "Acme", {"former": "Old", "phone": "5"}).alias("told"))
