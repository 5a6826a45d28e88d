"""Rule classifiers over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import rules as R
from ..functions import text as T
from ..session import spread, table
from .registry import query, sql_list


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _any(words, column="lower(text)"):
    return f"len(list_filter({sql_list(words)}, lambda w: contains({column}, w))) > 0"


_KNOWN = ["591", "2018"]
_ANSWERED = "SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'"


def _answered(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"])


def _bare(column: str) -> str:
    return f"regexp_replace(lower({column}), '[.,\\s\\-–]', '', 'g')"


_SMALL = f"""(length(trim(text)) > 0 AND (len(list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda w: NOT list_contains({sql_list(lex.SMALLTALK)}, w))) = 0
  OR (length(trim(text)) <= 15 AND NOT {_any(lex.DOMAIN, 'lower(trim(text))')} AND NOT regexp_matches(lower(trim(text)), '^({"|".join(lex.QUESTION_STARTS)})([^a-z0-9_à-ÿ]|$)'))))"""


@query(f"SELECT doc_id, {_SMALL} AS small FROM documents")
def flt_smalltalk(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", R.is_smalltalk(F.col("text")).alias("small"))


@query(f"SELECT doc_id, regexp_matches(trim(text), '(?i){lex.GREETING}') OR {_SMALL} AS greeting FROM documents")
def flt_greeting(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", R.is_greeting(F.col("text")).alias("greeting"))


def _re(patterns) -> str:
    """Patterns as one of DuckDB's: a word's edge is the text's edge or a sign that is no letter, digit or mark."""
    return "|".join(patterns).replace("\\b", "(?:^|$|[^\\pL\\pN\\pM_])").replace("\\w", "[\\pL\\pN\\pM_]").replace("'", "''")


def _unless(column: str, rules) -> str:
    """Whether a pattern is found that none of its exceptions follows; with two blanks or more nothing follows the first of them."""
    each = []
    for pattern, exceptions in rules.items():
        found = f"regexp_extract_all({column}, '{_re([pattern])}(?:{'|'.join(exceptions)})?')"
        ends = f"regexp_matches(x, '\\s(?:{'|'.join(exceptions)})$')"
        each.append(f"len(list_filter({found}, lambda x: NOT {ends} OR regexp_matches(x, '\\s\\s(?:{'|'.join(exceptions)})$'))) > 0")
    return "(" + " OR ".join(each) + ")"


@query(f"SELECT doc_id, regexp_matches(t, '(?s){_re(p.lower() for p in lex.INJECTION)}') OR {_unless('t', lex.INJECTION_UNLESS)} AS injection FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)")
def flt_injection(spark, sf_dir):
    return spread(_docs(spark, sf_dir)).select("doc_id", R.is_injection(F.col("text")).alias("injection"))


def _has(words) -> str:
    return f"len(list_intersect(w, {sql_list(words)})) > 0"


@query(f"""WITH t AS (SELECT doc_id, lower(trim(text)) AS t, list_distinct(regexp_split_to_array(trim(regexp_replace(lower(text), '[^0-9a-zà-ÿ_\\s]', ' ', 'g')), '\\s+')) AS w FROM documents)
SELECT doc_id, coalesce(CASE WHEN length(t) = 0 THEN false WHEN regexp_matches(t, '{_re(lex.NETWORK)}') THEN true WHEN {_has(lex.DOMAIN)} THEN false
  WHEN regexp_matches(t, '{_re(lex.OFF_TOPIC)}') OR {_unless('t', lex.OFF_TOPIC_UNLESS)} THEN true ELSE {_has(lex.ALIEN)} AND NOT {_has(lex.POSTAL_INTENT)} END, false) AS outside FROM t""")
def flt_out_of_domain(spark, sf_dir):
    return spread(_docs(spark, sf_dir)).select("doc_id", R.is_out_of_domain(F.col("text")).alias("outside"))


@query(f"SELECT conv_id, turn, {_any(lex.HALLUCINATION, 'lower(text)')} AS hallucinated FROM conversations WHERE role = 'assistant' AND text IS NOT NULL")
def flt_hallucination(spark, sf_dir):
    """Answers with a phrase that gives a model's invention away."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant' AND text IS NOT NULL")
    return c.select("conv_id", "turn", R.is_hallucination(F.col("text")).alias("hallucinated"))


@query(f"SELECT doc_id, {_any(lex.DOMAIN)} AS in_domain FROM documents")
def flt_any_substring(spark, sf_dir):
    return spread(_docs(spark, sf_dir)).select("doc_id", T.contains_any(F.lower("text"), lex.DOMAIN).alias("in_domain"))


@query(f"SELECT doc_id, {_any(lex.FAREWELL)} AS farewell, {_any(lex.COMPLAINT)} AS complaint, {_any(lex.URGENT)} AS urgent, {_any(lex.PRICE)} AS price FROM documents")
def flt_complaint(spark, sf_dir):
    low = F.lower("text")
    named = {"farewell": lex.FAREWELL, "complaint": lex.COMPLAINT, "urgent": lex.URGENT, "price": lex.PRICE}
    return spread(_docs(spark, sf_dir)).select("doc_id", *[T.contains_any(low, words).alias(name) for name, words in named.items()])


@query(f"SELECT conv_id, turn, length(t) <= 3 OR list_contains({sql_list(lex.TERSE)}, t) AS terse FROM (SELECT conv_id, turn, lower(trim(text)) AS t FROM conversations UNION ALL SELECT -n_nationkey, 0, {sql_list(lex.TERSE)}[n_nationkey % 9 + 1] FROM nation)")
def flt_terse(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    said = F.get(T.words_array(lex.TERSE), (F.col("n_nationkey") % 9).cast("int"))
    c = c.unionByName(table(spark, sf_dir, "nation").select((-F.col("n_nationkey")).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), said.alias("text")))
    return c.select("conv_id", "turn", R.is_terse(F.col("text")).alias("terse"))


_PADDED = f"' ' || trim(regexp_replace(regexp_replace(translate(lower(text), '{lex.ACCENTS}', '{lex.PLAIN}'), '[^a-z0-9 \\t\\n\\r]', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) || ' '"


@query(f"SELECT doc_id, contains({_PADDED}, ' of the ') AS found FROM documents")
def flt_whole_phrase(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.whole_phrase(F.col("text"), F.lit("Of thé")).alias("found"))


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(upper(trim(text)), '[A-Z][0-9]+[A-Z][0-9]+BO|[A-Z][0-9]{{6,}}BO|[0-9]{{4,}}[A-Z][0-9]+BO|[A-Z]{{2}}[0-9]{{9}}[A-Z]{{2}}|\\b[0-9]{{12,14}}\\b') THEN 'tracking'
  WHEN contains({_PADDED}, ' is the ') OR contains({_PADDED}, ' de la ') THEN 'capabilities' END AS kind FROM documents""")
def classify_special(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", R.special_query(F.col("text"), ["is the", "de la"]).alias("kind"))


_ASKED = ["quiero consultar el seguimiento de mi envío ", "dirección de la sucursal ", "quiero rastrear ", "Codigo de rastreo: ", "seguimientos ", "TRACKING de ", "rastreo, ", "consultar seguimiento "]


@query(f"""SELECT o_orderkey, regexp_matches(upper(t), 'R[0-9]{{6,}}BO') OR regexp_matches(lower(t), '{_re([chr(92) + 'b(' + '|'.join(lex.TRACKING_WORDS) + ')' + chr(92) + 'b'])}') AS flow FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 8 THEN 'r' || lpad(o_orderkey::VARCHAR, 9, '0') || 'bo' ELSE {sql_list(_ASKED)}[o_orderkey % 9 + 1] || o_orderkey END AS t FROM orders)""")
def flt_tracking(spark, sf_dir):
    key = F.col("o_orderkey")
    code = F.concat(F.lit("r"), F.lpad(key.cast("string"), 9, "0"), F.lit("bo"))
    text = F.when(key % 9 == 8, code).otherwise(F.concat(F.get(T.words_array(_ASKED), (key % 9).cast("int")), key.cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.is_tracking(text).alias("flow"))


_QUOTES = """coalesce(list_filter(list_transform(regexp_extract_all(list_filter(string_split(replace(replace({c}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda l: starts_with(lower(trim(l)), 'evidencia:'))[1],
  '"([^"]+)"', 1), lambda x: trim(x)), lambda x: x <> ''), [])"""


@query(f"""SELECT doc_id, len(q)::BIGINT AS n_quotes, len(q) > 0 AND len(list_filter(q, lambda x: NOT contains(text, x))) = 0 AS supported FROM (SELECT doc_id, text, {_QUOTES.format(c="answer")} AS q FROM (
  SELECT doc_id, text, text || chr(10) || CASE doc_id % 4 WHEN 0 THEN '  EVIDENCIA: "' || substring(text, 3, 10) || '" y " ' || substring(text, 20, 15) || ' "' WHEN 1 THEN 'Evidencia: "zz§", "' || substring(text, 1, 5) || '"' WHEN 2 THEN 'evidencia: " "' ELSE 'Nota: "' || substring(text, 1, 5) || '"' END AS answer FROM documents))""")
def evidence_all(spark, sf_dir):
    """Whether every quote on the line of evidence of an answer stands in its context."""
    said = F.col("text")
    cut = lambda a, n: F.substring(said, a, n)
    line = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('  EVIDENCIA: "'), cut(3, 10), F.lit('" y " '), cut(20, 15), F.lit(' "')))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit('Evidencia: "zz§", "'), cut(1, 5), F.lit('"')))
        .when(F.col("doc_id") % 4 == 2, F.lit('evidencia: " "'))
        .otherwise(F.concat(F.lit('Nota: "'), cut(1, 5), F.lit('"')))
    )
    quotes = R.evidence_quotes(F.concat(said, F.lit("\n"), line))
    return spread(_docs(spark, sf_dir)).withColumn("q", quotes).select("doc_id", F.size("q").cast("long").alias("n_quotes"), R.quotes_stand(F.col("q"), said).alias("supported"))


def invented_sql(answer: str, context: str, known=()) -> str:
    """The concrete data of an answer that its context lacks, as a list."""
    tight = "regexp_replace(lower(x), '\\s+', '', 'g')"
    return f"""CASE WHEN length(trim({context})) >= 50 THEN list_filter(regexp_extract_all(regexp_replace({answer}, '[À-ÖØ-öø-ÿ]', 'x', 'g'), '(?i){"|".join(lex.CONCRETE_DATA)}'), lambda x:
  NOT regexp_matches({tight}, '^(1[89][0-9]{{2}}|20[0-9]{{2}}|[0-9]{{1,3}}[-–][0-9]{{1,3}})$') AND NOT {_any(known, tight) if known else "false"}
  AND NOT contains({_bare(context)}, {_bare("x")})) ELSE [] END"""


@query(f"""WITH p AS (SELECT conv_id, turn, question, answer || ' Bs. ' || conv_id || ',5 y ' || turn || '7.25 kg, tel ' || (conv_id * 7919 + 10000) || ', 1999' AS answer FROM ({_ANSWERED})),
f AS (SELECT *, {invented_sql("answer", "question", _KNOWN)} AS missing FROM p)
SELECT conv_id, turn, len(missing)::BIGINT AS n_missing, coalesce(len(missing) >= 5, false) AS invented FROM f""")
def ungrounded_numbers(spark, sf_dir):
    """Concrete data of each answer, some of them put in, that its question lacks."""
    said = F.concat("answer", F.lit(" Bs. "), F.col("conv_id").cast("string"), F.lit(",5 y "), F.col("turn").cast("string"), F.lit("7.25 kg, tel "), (F.col("conv_id") * 7919 + 10000).cast("string"), F.lit(", 1999"))
    rows = _answered(spark, sf_dir).withColumn("answer", said)
    missing = R.invented_data(F.col("answer"), F.col("question"), _KNOWN)
    return rows.select("conv_id", "turn", F.size(missing).cast("long").alias("n_missing"), R.has_invented_data(F.col("answer"), F.col("question"), _KNOWN).alias("invented"))


_SAID = "answer || CASE WHEN conv_id % 3 = 0 THEN chr(10) || 'Evidencia: \"' || substring(question, 2, 9) || '\"' WHEN conv_id % 3 = 1 THEN ' 3,5 ' || turn ELSE '' END"


@query(f"""WITH p AS (SELECT conv_id, turn, question, {_SAID} AS answer FROM ({_ANSWERED})),
w AS (SELECT *, {_QUOTES.format(c="answer")} AS q, list_filter(list_distinct(regexp_extract_all(lower(answer), '[a-záéíóúñü0-9]+')), lambda x: length(x) >= 4 AND NOT list_contains({sql_list(lex.EVIDENCE_STOPS)}, x)) AS words,
  trim(regexp_replace(regexp_replace(lower(question), '[^a-z0-9áéíóúñü \t\n\r]', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS ctx, regexp_extract_all(regexp_replace(answer, '[À-ÖØ-öø-ÿ]', 'x', 'g'), '\\b\\d+[.,]?\\d*\\b') AS n FROM p)
SELECT conv_id, turn, coalesce(length(answer) > 0 AND length(question) > 0 AND ((len(q) > 0 AND len(list_filter(q, lambda x: NOT contains(question, x))) = 0)
  OR (len(list_filter(words, lambda x: contains(ctx, x))) >= 2 AND len(list_filter(n, lambda x: NOT contains(question, x))) = 0)), false) AS ok FROM w""")
def grounded_answer(spark, sf_dir):
    """Answers, some with a line of evidence or numbers put in, against their question as context."""
    c = F.col("conv_id") % 3
    more = F.when(c == 0, F.concat(F.lit('\nEvidencia: "'), F.substring("question", 2, 9), F.lit('"'))).when(c == 1, F.concat(F.lit(" 3,5 "), F.col("turn").cast("string"))).otherwise("")
    rows = _answered(spark, sf_dir).withColumn("answer", F.concat("answer", more))
    return rows.select("conv_id", "turn", R.grounded(F.col("answer"), F.col("question")).alias("ok"))


_BROKEN_SQL = f"""CASE WHEN length(trim(t)) < 20 THEN false WHEN list_contains(['.', '!', '?', '…'], l) THEN len(items) >= 2 AND length(trim(regexp_extract(items[-1], '^[^:]*:(.*)$', 1))) < 8
  WHEN list_contains([',', ':', ';', '-', '–', '—', '('], l) THEN true WHEN list_contains({sql_list(lex.LAST_WORDS)}, rtrim(lower(regexp_split_to_array(t, '\\s+')[-1]), '.,;:')) THEN true
  ELSE length(t) > 80 AND regexp_matches(l, '^\\pL$') END"""


@query(f"""WITH t AS (SELECT doc_id, rtrim(text) AS t FROM documents),
i AS (SELECT *, substring(t, -1, 1) AS l, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '^[-*•]? *[A-Za-z0-9_][^:]{{1,40}}: *.+')) AS items FROM t)
SELECT doc_id, {_BROKEN_SQL} AS broken FROM i""")
def flt_incomplete(spark, sf_dir):
    return spread(_docs(spark, sf_dir)).select("doc_id", R.is_incomplete(F.col("text")).alias("broken"))


@query(f"SELECT doc_id, len(list_filter({sql_list(lex.PORTUGUESE)}, lambda w: contains(lower(text), w)))::BIGINT AS markers, length(text) >= 20 AND len(list_filter({sql_list(lex.PORTUGUESE)}, lambda w: contains(lower(text), w))) >= 2 AS portuguese FROM documents")
def marker_count(spark, sf_dir):
    n = T.count_contained(F.lower("text"), lex.PORTUGUESE)
    return _docs(spark, sf_dir).select("doc_id", n.cast("long").alias("markers"), ((F.length("text") >= 20) & (n >= 2)).alias("portuguese"))


@query("SELECT doc_id, length(trim(text)) > 0 AND (regexp_matches(trim(text), '^(```|\\{|\\[|dict\\(|json|python)') OR contains(trim(text), chr(10)) OR regexp_matches(trim(text), '(^|\\s)([0-9]+\\.\\s|[•\\-]\\s)')) AS structured FROM documents")
def flt_structured(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", R.is_structured(F.col("text")).alias("structured"))


@query("SELECT doc_id, length(trim(text)) >= 40 AND length(regexp_replace(text, '[^\\pL]', '', 'g')) >= 20 AS useful FROM documents")
def flt_useful_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", R.is_useful(F.col("text")).alias("useful"))


@query("""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS x FROM documents),
s AS (SELECT doc_id, x, regexp_replace(lower(x), '[0-9]+', '#', 'g') AS shape, length(regexp_replace(x, '[^\\pL]', '', 'g')) / greatest(length(x), 1) AS r FROM l)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE length(x) <= 2 OR regexp_matches(x, '^[-_=|+.:;, ]{3,}$') OR (length(x) - length(replace(x, '|', '')) >= 2 AND r < 0.35)
  OR regexp_matches(shape, '^p[áa]gina +#( +de +#)?$') OR list_contains(['www', 'http', 'https', 'comparte', 'share', 'menu', 'inicio'], shape) OR regexp_matches(shape, '^https?://[^ ]+$')
  OR (r < 0.18 AND regexp_matches(x, '[|+\\-_=]{2,}')))::BIGINT AS n_noise FROM s GROUP BY doc_id""")
def flt_noise_lines(spark, sf_dir):
    rows = spread(_docs(spark, sf_dir)).select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(R.is_noise_line(F.col("x"))).alias("n_noise"))


@query("SELECT event_id, CASE WHEN event_type = 'signup' THEN 'user_request' WHEN event_type = 'error' THEN 'error' WHEN value < 0.3 THEN 'low_confidence' WHEN contains(CASE WHEN event_id % 7 = 0 THEN 'llama al 5' ELSE '' END, 'llama al') THEN 'uncertain_response' ELSE '' END AS reason FROM events")
def escalation_reason(spark, sf_dir):
    said = F.when(F.col("event_id") % 7 == 0, "Llama al 5").otherwise("")
    return table(spark, sf_dir, "events").select("event_id", R.escalation_reason(F.col("value"), said, F.col("event_type") == "error", F.col("event_type") == "signup").alias("reason"))


_PLACED = ["Regional", "sucursales ", "la regional de ", "Oficina Central norte ", "una sucursal cerca ", "subsucursal ", "donde ", "__ubicacion_sucursales__"]
_SCOPED = f"CASE WHEN p_partkey % 2 = 0 THEN {sql_list(_PLACED)}[p_partkey % 16 // 2 + 1] ELSE {sql_list(_PLACED)}[p_partkey % 16 // 2 + 1] || ' ' || p_name END"


@query(f"""SELECT p_partkey, CASE WHEN t IN ('__ubicacion_regionales__', 'regional', 'regionales') THEN 'regionales' WHEN t IN ('__ubicacion_sucursales__', 'sucursal', 'sucursales') THEN 'sucursales'
  WHEN regexp_matches(t, '\\b(regional|regionales|oficina central)\\b') THEN 'regionales' WHEN regexp_matches(t, '\\b(sucursal|sucursales)\\b') THEN 'sucursales' END AS scope FROM (SELECT p_partkey, lower(trim({_SCOPED})) AS t FROM part)""")
def scope_extract(spark, sf_dir):
    phrase = F.get(T.words_array(_PLACED), (F.floor(F.col("p_partkey") % 16 / 2)).cast("int"))
    text = F.when(F.col("p_partkey") % 2 == 0, phrase).otherwise(F.concat_ws(" ", phrase, "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", R.location_scope(text).alias("scope"))


@query("SELECT p_partkey, n >= 3 AND u >= 2 AS valid FROM (SELECT p_partkey, len(list_filter(w, lambda x: x <> '')) AS n, len(list_filter(list_distinct(w), lambda x: length(x) >= 4)) AS u FROM (SELECT p_partkey, string_split(lower(p_name || ' ' || p_type), ' ') AS w FROM part))")
def validate_trigger(spark, sf_dir):
    words = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")
    rows = table(spark, sf_dir, "part").select("p_partkey", words.alias("w"))
    return rows.select("p_partkey", ((F.size(F.filter("w", lambda x: x != "")) >= 3) & (F.size(F.filter(F.array_distinct("w"), lambda x: F.length(x) >= 4)) >= 2)).alias("valid"))


@query(f"SELECT conv_id, turn, CASE WHEN {_any(lex.DOMAIN)} THEN text ELSE text || ' correos' END AS enriched FROM conversations WHERE role = 'user'")
def enrich_query(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", F.when(T.contains_any(F.lower("text"), lex.DOMAIN), F.col("text")).otherwise(F.concat("text", F.lit(" correos"))).alias("enriched"))


def _replies(lang: str) -> str:
    return "flatten([" + ", ".join(f"CASE WHEN {_any(words)} THEN {sql_list(said)} ELSE [] END" for words, said in lex.QUICK_REPLIES[lang]) + "])[1:3]"


@query(f"SELECT doc_id, array_to_string(CASE WHEN lang = 'en' THEN {_replies('en')} ELSE {_replies('es')} END, '|') AS replies FROM documents")
def quick_replies(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return d.select("doc_id", F.array_join(R.quick_replies(F.col("text"), F.col("lang")), "|").alias("replies"))


@query(f"""WITH p AS (SELECT conv_id, turn, question, lower(answer) AS ans, answer, list_filter(list_distinct(regexp_split_to_array(trim(regexp_replace(lower(question), '[^0-9a-zà-ÿ_\\s]', ' ', 'g')), '\\s+')), lambda w: length(w) >= 4 AND NOT list_contains({sql_list(lex.QUESTION_STOPS)}, w)) AS k FROM ({_ANSWERED}))
SELECT conv_id, turn, coalesce(length(question) > 0 AND length(answer) > 0 AND NOT {_any(lex.ANSWER_DOMAIN, "ans")} AND len(k) > 0 AND len(list_filter(k, lambda w: contains(ans, w))) = 0, false) AS off_topic FROM p""")
def flt_answer_offtopic(spark, sf_dir):
    """Answers without a domain word that share no key word with their question."""
    return _answered(spark, sf_dir).select("conv_id", "turn", R.is_off_topic_answer(F.col("question"), F.col("answer")).alias("off_topic"))


_LINE_OK = "NOT (length(x) <= 2 OR regexp_matches(x, '^[-_=|+.:;, ]{3,}$') OR (length(x) - length(replace(x, '|', '')) >= 2 AND r < 0.35) OR regexp_matches(s, '^p[áa]gina +#( +de +#)?$') OR list_contains(['www', 'http', 'https', 'comparte', 'share', 'menu', 'inicio'], s) OR regexp_matches(s, '^https?://[^ ]+$') OR (r < 0.18 AND regexp_matches(x, '[|+\\-_=]{2,}')))"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(0), ''), chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
t AS (SELECT doc_id, pos, trim(raw) AS x FROM l), f AS (SELECT *, regexp_replace(lower(x), '[0-9]+', '#', 'g') AS s, length(regexp_replace(x, '[^\\pL]', '', 'g')) / greatest(length(x), 1) AS r FROM t)
SELECT d.doc_id, coalesce(c.cleaned, '') AS cleaned FROM documents d LEFT JOIN (SELECT doc_id, string_agg(x, chr(10) ORDER BY pos) AS cleaned FROM f WHERE {_LINE_OK} GROUP BY doc_id) c ON c.doc_id = d.doc_id""")
def clean_pages(spark, sf_dir):
    """Texts without their noise lines."""
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: ~R.is_noise_line(x))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(kept, "\n").alias("cleaned"))
