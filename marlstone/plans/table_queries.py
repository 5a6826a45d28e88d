"""Joins, aggregates, windows, orders, deduplication and catalogue mutation over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import rules as R
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import dedup as D
from ..operators import history as H
from ..operators import labels as L
from ..operators import places as P
from ..session import spread, table
from .registry import query, sql_list

# Sources and catalogues


@query("SELECT doc_id, length(text)::BIGINT AS chars, (len(string_split(text, chr(10))))::BIGINT AS n_lines FROM documents WHERE length(trim(text)) > 0")
def src_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.length(F.trim("text")) > 0)
    return d.select("doc_id", F.length("text").cast("long").alias("chars"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


@query("SELECT s_suppkey, regexp_replace(s_name, '(?i)^supplier#0*', '') AS name, s_nationkey, coalesce(n_name, '?') AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def branch_clean(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").select("s_suppkey", F.regexp_replace("s_name", "(?i)^supplier#0*", "").alias("name"), "s_nationkey", F.coalesce("n_name", F.lit("?")).alias("nation"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (("documents", "pdf", "doc_id", "text"), ("pages", "web", "page_id", "html"), ("benchmark", "json", "item_id", "text"))
    out = None
    for name, kind, key, text in parts:
        one = table(spark, sf_dir, name).select(F.lit(kind).alias("source_type"), F.concat(F.lit(f"{kind}_"), F.col(key).cast("string")).alias("source_name"), F.col(text).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


_SOURCES = "SELECT 'pdf' AS source_type, 'pdf_' || doc_id AS source_name, text FROM documents UNION ALL SELECT 'web', 'web_' || page_id, html FROM pages UNION ALL SELECT 'json', 'json_' || item_id, text FROM benchmark"


@query(f"SELECT source_type, source_name, length(text)::BIGINT AS chars FROM ({_SOURCES})")
def local_sources(spark, sf_dir):
    return _sources(spark, sf_dir).select("source_type", "source_name", F.length("text").cast("long").alias("chars"))


@query(f"SELECT source_type, count(*)::BIGINT AS n_rows, count(DISTINCT sha1(lower(text)))::BIGINT AS n_distinct, sum(length(text))::BIGINT AS chars FROM ({_SOURCES}) WHERE length(trim(text)) >= 40 GROUP BY source_type")
def ingest_full(spark, sf_dir):
    rows = _sources(spark, sf_dir).where(F.length(F.trim("text")) >= 40)
    by_text = rows.groupBy("source_type", F.sha1(F.lower("text")).alias("h")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c"))
    return by_text.groupBy("source_type").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_distinct"), F.sum("c").alias("chars"))


@query("SELECT doc_id, lang, substring(sha1(doc_id::VARCHAR || '|' || source || '|' || coalesce(lang, '')), 1, 12) AS source_key FROM documents WHERE lang <> 'fr' UNION ALL SELECT doc_id, lang, 'new_' || doc_id FROM documents WHERE lang = 'fr'")
def ingest_incremental(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    key = F.substring(F.sha1(F.concat_ws("|", F.col("doc_id").cast("string"), "source", F.coalesce("lang", F.lit("")))), 1, 12)
    base = d.where("lang IS NOT NULL").select("doc_id", "lang", key.alias("source_key"))
    new = d.where("lang = 'fr'").select("doc_id", "lang", F.concat(F.lit("new_"), F.col("doc_id").cast("string")).alias("source_key"))
    return D.replace_partition(base, new, "lang", "fr")


@query("""SELECT page_id, CASE WHEN length(a) >= 3000 THEN 'article' WHEN length(b) >= 40 THEN 'title' END AS method FROM (
  SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS a, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS b FROM pages)""")
def extract_cascade(spark, sf_dir):
    """The first extractor whose text is useful."""
    a, b = F.regexp_extract("html", "(?s)<article>(.*)</article>", 1), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.length(a) >= 3000, "article").when(F.length(b) >= 40, "title").alias("method"))


@query("SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer, greatest(u.turn * 10 - 5, 0)::BIGINT AS latency_ms FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user' AND trim(u.text) <> '' AND trim(a.text) <> ''")
def log_conversation(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where(F.trim("text") != "")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"]).withColumn("latency_ms", F.greatest(F.col("turn") * 10 - 5, F.lit(0)).cast("long"))


@query("SELECT n_nationkey, nullif(regexp_extract('dest_' || lower(substring(n_name, 1, 1)) || '_' || n_nationkey, 'dest_([a-e])_', 1), '') AS zone FROM nation")
def zone_extract(spark, sf_dir):
    value = F.concat(F.lit("dest_"), F.lower(F.substring("n_name", 1, 1)), F.lit("_"), F.col("n_nationkey").cast("string"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.nullif(F.regexp_extract(value, "dest_([a-e])_", 1), F.lit("")).alias("zone"))


@query("SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN 'own ' || r_name ELSE 'default' END AS phone, 'web' AS web FROM region")
def config_overlay(spark, sf_dir):
    base = F.create_map(F.lit("phone"), F.lit("default"), F.lit("web"), F.lit("web"))
    own = F.when(F.col("r_regionkey") % 2 == 0, F.create_map(F.lit("phone"), F.concat(F.lit("own "), "r_name"))).otherwise(F.create_map(F.lit("none"), F.lit("")))
    value = lambda k: F.coalesce(F.try_element_at(own, F.lit(k)), F.try_element_at(base, F.lit(k)))
    return table(spark, sf_dir, "region").select("r_regionkey", value("phone").alias("phone"), value("web").alias("web"))


# Filters


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 3 OR NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = 3)")
def scope_filter(spark, sf_dir):
    """Rows in scope; all rows if none is."""
    s = table(spark, sf_dir, "supplier")
    some = s.where("s_nationkey = 3").limit(1).agg(F.count("*").alias("some"))  # one row
    return s.join(F.broadcast(some)).where("s_nationkey = 3 OR some = 0").select("s_suppkey", "s_name")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT DISTINCT p_brand FROM part WHERE p_size = 1) OR p_size > 45")
def semi_filter(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    wanted = p.where("p_size = 1").select("p_brand").distinct().withColumn("hit", F.lit(True))
    return p.join(wanted, "p_brand", "left").where("hit OR p_size > 45").select("p_partkey", "p_brand")


@query("SELECT conv_id, turn FROM conversations WHERE text ILIKE '%tion%' OR role ILIKE '%sys%'")
def log_search(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(F.col("text").ilike("%tion%") | F.col("role").ilike("%sys%")).select("conv_id", "turn")


# Joins


@query("SELECT s.source, count(*)::BIGINT AS n, coalesce(nullif(sum(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END), 0), count(l.doc_id), 0)::BIGINT AS chunks FROM documents s LEFT JOIN labels l ON l.doc_id = s.doc_id GROUP BY s.source")
def catalog_chunks(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("labelled"), "quality")
    out = d.join(l, d.doc_id == l.labelled, "left").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.count("labelled").alias("any"))
    return out.select("source", "n", F.coalesce(F.nullif("good", F.lit(0)), "any", F.lit(0)).cast("long").alias("chunks"))


@query("SELECT n_nationkey, n_name, r_name AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def label_lookup(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey, "left").select("n_nationkey", "n_name", F.col("r_name").alias("region"))


@query("SELECT conv_id, turn, CASE WHEN length(text) <= 120 THEN concat_ws(' ', last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), text) ELSE text END AS asked FROM conversations")
def followup_rewrite(spark, sf_dir):
    """Terse turns after the last user's message before them."""
    c = H.carried(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.when(F.col("role") == "user", F.col("text")))
    return c.select("conv_id", "turn", F.when(F.length("text") <= 120, F.concat_ws(" ", "carried", "text")).otherwise(F.col("text")).alias("asked"))


@query("""WITH top AS (SELECT conv_id, turn, length(text) AS score FROM conversations ORDER BY length(text) DESC, conv_id, turn LIMIT 50)
SELECT t.conv_id, t.turn AS parent, n.turn AS turn, max(t.score * 0.85) AS score FROM top t JOIN conversations n ON n.conv_id = t.conv_id AND abs(n.turn - t.turn) = 1 WHERE NOT EXISTS (SELECT 1 FROM top x WHERE x.conv_id = n.conv_id AND x.turn = n.turn) GROUP BY t.conv_id, t.turn, n.turn""")
def parent_doc(spark, sf_dir):
    """Neighbours of the selected rows, which are a top-k report; not selected themselves."""
    c = table(spark, sf_dir, "conversations")
    top = c.select("conv_id", "turn", F.length("text").alias("score")).orderBy(F.desc("score"), "conv_id", "turn").limit(50)
    near = top.select("conv_id", F.col("turn").alias("parent"), "score", F.explode(F.array(F.col("turn") - 1, F.col("turn") + 1)).alias("turn"))
    near = near.join(c.select("conv_id", "turn"), ["conv_id", "turn"]).join(top.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")
    return near.groupBy("conv_id", "parent", "turn").agg(F.max(F.col("score") * F.lit(0.85).cast("decimal(3,2)")).cast("double").alias("score"))


ORACLE_NEAREST = """WITH s AS (SELECT s_suppkey, (s_suppkey * 7919 % 900) / 100.0 - 22 AS lat, (s_suppkey * 104729 % 1100) / 100.0 - 69 AS lng FROM supplier),
c AS (SELECT c_custkey, (c_custkey * 31 % 900) / 100.0 - 22 AS lat, (c_custkey * 17 % 1100) / 100.0 - 69 AS lng FROM customer),
d AS (SELECT c_custkey, s_suppkey, 6371.0 * 2 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lng - c.lng) / 2), 2)))) AS km FROM c, s)
SELECT c_custkey, round(min(km), 3) AS km FROM d GROUP BY c_custkey"""


@query(ORACLE_NEAREST)
def nearest_neighbor(spark, sf_dir):
    """Kilometres from each customer to the nearest branch."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site"), ((F.col("s_suppkey") * 7919 % 900) / 100.0 - 22).alias("lat"), ((F.col("s_suppkey") * 104729 % 1100) / 100.0 - 69).alias("lng"))
    c = table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") * 31 % 900) / 100.0 - 22).alias("lat"), ((F.col("c_custkey") * 17 % 1100) / 100.0 - 69).alias("lng"))
    return P.nearest_site(c, "c_custkey", s).select("c_custkey", F.round("km", 3).alias("km"))


_LABELLED = "lower(trim(CASE p_partkey % 4 WHEN 0 THEN left((SELECT n_name FROM nation WHERE n_nationkey = p_partkey % 25), 5) WHEN 1 THEN 'envio a ' || (SELECT n_name FROM nation WHERE n_nationkey = p_partkey % 25) WHEN 2 THEN 'la paz y otros states ' || p_name ELSE p_name END))"
@query(f"""WITH p AS (SELECT p_partkey, {_LABELLED} AS t FROM part), l AS (SELECT n_nationkey, lower(n_name) AS label FROM nation),
c AS (SELECT p_partkey, n_nationkey, CASE WHEN contains(label, t) OR contains(t, label) THEN 0 WHEN len(list_filter(string_split(label, ' '), lambda w: contains(t, w))) > 0 THEN 1 END AS tier FROM p, l),
b AS (SELECT p_partkey, arg_min(n_nationkey, tier * 100 + n_nationkey) AS best FROM c WHERE tier IS NOT NULL GROUP BY p_partkey)
SELECT p_partkey, coalesce(best::VARCHAR, CASE WHEN contains(t, 'la paz') THEN 'la_paz' END) AS label FROM p LEFT JOIN b USING (p_partkey)""")
def fuzzy_label(spark, sf_dir):
    """The label that a text means: containment either way, then any word, then known names."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", (F.col("p_partkey") % 25).cast("int").alias("n_nationkey")).join(n, "n_nationkey", "left")
    kind, name = F.col("p_partkey") % 4, F.col("n_name")
    text = F.when(kind == 0, F.left(name, F.lit(5))).when(kind == 1, F.concat(F.lit("envio a "), name)).when(kind == 2, F.concat(F.lit("la paz y otros states "), "p_name")).otherwise(F.col("p_name"))
    p = p.select("p_partkey", text.alias("text"))
    found = L.label_of(p, "p_partkey", "text", n.select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("name")))
    known = F.when(F.contains(F.lower("text"), F.lit("la paz")), "la_paz")
    return p.join(found, "p_partkey", "left").select("p_partkey", F.coalesce(F.col("place").cast("string"), known).alias("label"))


# Aggregates


@query("SELECT count(*)::BIGINT AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS clicks, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS high, round(avg(value), 1) AS mean FROM events")
def log_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("value") > 50).alias("high"), F.round(F.avg("value"), 1).alias("mean"))


@query("SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS done, count(*) FILTER (WHERE o_orderstatus = 'P')::BIGINT AS pending FROM orders")
def status_stats(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"))


@query("SELECT o_orderstatus, count(*)::BIGINT AS n, round(avg(epoch(l_shipdate) - epoch(o_orderdate)) / 3600, 1) AS hours FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderstatus")
def ticket_stats(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    seconds = F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return o.join(l, o.o_orderkey == l.l_orderkey).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg(seconds) / 3600, 1).alias("hours"))


@query("SELECT source, lang, count(*)::BIGINT AS n FROM documents WHERE coalesce(source, '') <> '' GROUP BY GROUPING SETS ((source), (lang))")
def chunk_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.coalesce("source", F.lit("")) != "")
    return d.groupingSets([["source"], ["lang"]], "source", "lang").agg(F.count("*").alias("n")).select("source", "lang", "n")


@query("SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE length(text) > 3000)::BIGINT AS large, round(sum(length(text)) / 1024.0, 2) AS kb FROM documents")
def catalog_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.count_if(F.length("text") > 3000).alias("large"), F.round(F.sum(F.length("text")) / 1024.0, 2).alias("kb"))


@query("SELECT count(*)::BIGINT AS n, round(100.0 * count(*) FILTER (WHERE length(html) > 2000) / count(*), 2) AS rate, (SELECT array_to_string(list(page_id ORDER BY page_id), ',') FROM (SELECT page_id FROM pages ORDER BY page_id LIMIT 8)) AS sample FROM pages")
def crawl_summary(spark, sf_dir):
    """Totals and the first eight ids, a report."""
    p = table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("n"))
    first = p.select("page_id").orderBy("page_id").limit(8).agg(F.array_join(F.sort_array(F.collect_list("page_id")).cast("array<string>"), ",").alias("sample"))
    return p.agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(F.col("n") > 2000) / F.count("*"), 2).alias("rate")).join(F.broadcast(first))


@query("SELECT p_brand, count(*)::BIGINT AS n, min(p_retailprice) AS cheapest FROM part GROUP BY p_brand")
def category_counts(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_retailprice").alias("cheapest"))


_HTTP = "SELECT event_type AS endpoint, CASE event_type WHEN 'error' THEN 500 + user_id % 4 WHEN 'view' THEN 304 WHEN 'signup' THEN 404 ELSE 200 END AS code, value AS ms, ts, event_id FROM events"


def _http(spark, sf_dir):
    kind = F.col("event_type")
    code = F.when(kind == "error", 500 + F.col("user_id") % 4).when(kind == "view", 304).when(kind == "signup", 404).otherwise(200)
    return table(spark, sf_dir, "events").select(kind.alias("endpoint"), code.alias("code"), F.col("value").alias("ms"), "ts", "event_id")


@query(f"SELECT endpoint, count(*)::BIGINT AS n, count(*) FILTER (WHERE code >= 500)::BIGINT AS errors, count(*) FILTER (WHERE code < 400)::BIGINT AS ok, count(*) FILTER (WHERE code >= 400 AND code < 500)::BIGINT AS refused, round(sum(ms), 2) AS total_ms FROM ({_HTTP}) GROUP BY endpoint")
def http_metrics(spark, sf_dir):
    group = A.status_group(F.col("code"))
    return _http(spark, sf_dir).groupBy("endpoint").agg(
        F.count("*").alias("n"), F.count_if(group == "5xx").alias("errors"), F.count_if(group == "2xx").alias("ok"), F.count_if(group == "4xx").alias("refused"), F.round(F.sum("ms"), 2).alias("total_ms")
    )


_RING = f"SELECT endpoint, ms FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY ts DESC, event_id DESC) AS rn FROM ({_HTTP})) WHERE rn <= 300"
_P95 = "list_sort(list(ms))[round_even((count(*) - 1) * 0.95, 0)::INT + 1]"


def _ring(spark, sf_dir, n=300):
    w = Window.partitionBy("endpoint").orderBy(F.desc("ts"), F.desc("event_id"))
    return _http(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


@query(f"SELECT endpoint, round(a.mean, 2) AS mean, round(r.p95, 2) AS p95, a.rate FROM (SELECT endpoint, avg(ms) AS mean, round(count(*) FILTER (WHERE code < 400) * 100.0 / count(*), 2) AS rate FROM ({_HTTP}) GROUP BY endpoint) a JOIN (SELECT endpoint, {_P95} AS p95 FROM ({_RING}) GROUP BY endpoint) r USING (endpoint)")
def http_snapshot(spark, sf_dir):
    """Mean over all requests, p95 over the latest 300 of each endpoint."""
    every = _http(spark, sf_dir).groupBy("endpoint").agg(F.round(F.avg("ms"), 2).alias("mean"), A.percent(F.count_if(F.col("code") < 400), F.count("*")).alias("rate"))
    ring = _ring(spark, sf_dir).groupBy("endpoint").agg(A.nearest_rank(F.collect_list("ms"), 0.95).alias("p"))
    return every.join(ring, "endpoint").select("endpoint", "mean", F.round("p", 2).alias("p95"), "rate")


@query(f"SELECT endpoint, {_P95} AS p95 FROM ({_RING}) GROUP BY endpoint")
def p95_nearest(spark, sf_dir):
    return _ring(spark, sf_dir).groupBy("endpoint").agg(A.nearest_rank(F.collect_list("ms"), 0.95).alias("p95"))


@query(f"SELECT endpoint, count(*)::BIGINT AS n, round(max(ms), 4) AS top FROM ({_RING}) GROUP BY endpoint")
def ring_300(spark, sf_dir):
    return _ring(spark, sf_dir).groupBy("endpoint").agg(F.count("*").alias("n"), F.round(F.max("ms"), 4).alias("top"))


@query("SELECT event_type, user_id % 3 AS method, count(*)::BIGINT AS n, sum(length(props))::BIGINT AS chars FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 3), ())")
def extraction_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 3).alias("method"), F.length("props").alias("c"))
    return e.groupingSets([["event_type"], ["method"], []], "event_type", "method").agg(F.count("*").alias("n"), F.sum("c").alias("chars")).select("event_type", "method", "n", "chars")


@query("SELECT split_part(url, ':', 1) AS ns, count(*)::BIGINT AS n FROM pages GROUP BY split_part(url, ':', 1)")
def ns_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(F.substring_index("url", ":", 1).alias("ns")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT DISTINCT source, doc_id, regexp_replace(lower(trim(unnest(string_split(text, chr(10))))), '[0-9]+', '#', 'g') AS line FROM documents),
n AS (SELECT source, count(DISTINCT doc_id) AS total FROM documents GROUP BY source)
SELECT source, line, count(*)::BIGINT AS n_docs FROM l JOIN n USING (source) WHERE line <> '' GROUP BY source, line, total HAVING count(*) >= 2 AND count(*) >= 0.04 * total""")
def repeated_lines(spark, sf_dir):
    """Line shapes that many documents of a source share."""
    d = spread(table(spark, sf_dir, "documents").select("source", "doc_id", "text"))
    line = F.regexp_replace(F.lower(F.trim(F.col("x"))), "[0-9]+", "#")
    lines = d.select("source", "doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("x")).select("source", "doc_id", line.alias("line")).where("line <> ''").distinct()
    total = d.select("source", "doc_id").distinct().groupBy("source").agg(F.count("*").alias("total"))
    return lines.groupBy("source", "line").agg(F.count("*").alias("n_docs")).join(total, "source").where("n_docs >= 2 AND n_docs >= 0.04 * total").select("source", "line", "n_docs")


_LINES = "list_filter(list_transform(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_SHAPE = "regexp_replace(regexp_replace(lower(trim(x)), '\\d+', '#', 'g'), '\\s+', ' ', 'g')"


@query(f"""WITH p AS (SELECT page_id, regexp_extract(url, '//([^/]*)', 1) AS host, {_LINES} AS l FROM pages), z AS (SELECT host, count(*) AS total FROM p GROUP BY host),
s AS (SELECT DISTINCT page_id, host, unnest(list_filter(list_transform(list_concat(l[1:4], list_reverse(l)[1:4]), lambda x: {_SHAPE}), lambda x: length(x) >= 4)) AS shape FROM p),
r AS (SELECT host, list(shape) AS shapes FROM (SELECT host, shape FROM s JOIN z USING (host) GROUP BY host, shape, total HAVING count(*) >= 2 AND count(*) / total >= 0.45) GROUP BY host),
k AS (SELECT page_id, host, len(l) AS n, list_filter(l, lambda x: shapes IS NULL OR NOT list_contains(shapes, {_SHAPE})) AS kept FROM p LEFT JOIN r USING (host))
SELECT page_id, host, (n - len(kept))::BIGINT AS n_gone, sha1(array_to_string(kept, chr(10))) AS kept_sha1 FROM k""")
def page_headers(spark, sf_dir):
    """Pages of a host without the headers and footers that its pages repeat."""
    lines = F.filter(F.transform(F.split(F.regexp_replace("html", "<[^>]*>", "\n"), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    p = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", F.regexp_extract("url", "//([^/]*)", 1).alias("host"), lines.alias("lines")).withColumn("n", F.size("lines"))
    return A.without_headers(p, "host", "lines").select("page_id", "host", (F.col("n") - F.size("lines")).cast("long").alias("n_gone"), F.sha1(F.array_join("lines", "\n")).alias("kept_sha1"))


@query("""WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), n AS (SELECT DISTINCT day FROM d)
SELECT strftime(n.day, '%Y-%m-%d') AS day, count(DISTINCT user_id)::BIGINT AS live FROM n JOIN d ON d.day BETWEEN n.day - 2 AND n.day GROUP BY n.day""")
def live_sessions(spark, sf_dir):
    """Users seen on each day or the two before."""
    return A.live_sessions(table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts", 3).select(F.col("day").cast("string").alias("day"), "live")


# Windows


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 6")
def last_n_turns(spark, sf_dir):
    return H.last_n(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn", 6)


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations), s AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM r WHERE rn <= 3) SELECT conv_id, turn FROM s WHERE used <= 900 OR rn = 1")
def recent_history(spark, sf_dir):
    last = H.last_n(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", 3)
    return H.trim_by_budget(last, "conv_id", "turn", F.length("text"), 900).select("conv_id", "turn")


@query("SELECT conv_id, turn FROM (SELECT *, sum(length(text)) OVER w AS used, row_number() OVER w AS rn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)) WHERE used <= 1500 OR rn = 1")
def history_char_trim(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return H.trim_by_budget(c, "conv_id", "turn", F.length("text"), 1500).select("conv_id", "turn")


_NT = "len(regexp_extract_all(text, '[\\pL\\pN\\pM_]+|[^\\s\\pL\\pN\\pM_]')) + 4"


@query(f"""WITH c AS (SELECT *, {_NT} AS n FROM conversations),
s AS (SELECT *, sum(CASE WHEN role <> 'system' THEN n ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) + coalesce(sum(CASE WHEN role = 'system' THEN n END) OVER (PARTITION BY conv_id), 0) AS used FROM c)
SELECT conv_id, turn FROM s WHERE role = 'system' OR used <= 400""")
def token_budget_trim(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return H.trim_by_budget(c, "conv_id", "turn", T.token_count(F.col("text")) + 4, 400, keep_one=False, pinned=F.col("role") == "system").select("conv_id", "turn")


@query("SELECT conv_id, turn, lag(turn) OVER w AS prev, lead(length(text)) OVER w AS next_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def adjacent_chunks(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return c.select("conv_id", "turn", F.lag("turn").over(w).alias("prev"), F.lead("n").over(w).alias("next_chars"))


@query("SELECT conv_id, turn, CASE WHEN starts_with(text, coalesce(p, '')) THEN substring(text, length(coalesce(p, '')) + 1) ELSE text END AS delta FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM (SELECT conv_id, turn, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS text FROM conversations UNION ALL SELECT -n_nationkey - 1, t, repeat('ab ', t) FROM nation, range(1, 5) r(t)))")
def stream_delta(spark, sf_dir):
    """What each message adds to the one before it, where it begins with all of that."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    two = F.concat_ws(" ", F.lag("text").over(w), "text")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", two.alias("text"))
    grown = table(spark, sf_dir, "nation").select((-F.col("n_nationkey") - 1).cast("long").alias("conv_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("turn"))
    c = c.unionByName(grown.withColumn("text", F.expr("repeat('ab ', int(turn))")))
    c = c.withColumn("p", F.coalesce(F.lag("text").over(w), F.lit("")))
    return c.select("conv_id", "turn", F.when(F.startswith("text", "p"), F.substr("text", F.length("p") + 1)).otherwise(F.col("text")).alias("delta"))


@query("SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Bot: ' ELSE 'System: ' END || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def flow_transcript(spark, sf_dir):
    who = F.when(F.col("role") == "user", "User: ").when(F.col("role") == "assistant", "Bot: ").otherwise("System: ")
    turns = F.sort_array(F.collect_list(F.struct("turn", F.concat(who, "text").alias("line"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["line"]), "\n").alias("transcript"))


# Orders


@query("SELECT p_partkey, p_size, p_name FROM part ORDER BY p_size DESC, lower(p_name), p_partkey")
def order_skills(spark, sf_dir):
    return table(spark, sf_dir, "part").orderBy(F.desc("p_size"), F.lower("p_name"), "p_partkey").select("p_partkey", "p_size", "p_name")


_URGENCY = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "5-LOW": 3}


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 3 ELSE 2 END AS urgency FROM orders WHERE o_orderstatus = 'P' ORDER BY urgency, o_orderdate, o_orderkey")
def priority_queue(spark, sf_dir):
    ranks = F.create_map(*[F.lit(x) for kv in _URGENCY.items() for x in kv])
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").withColumn("urgency", F.coalesce(F.try_element_at(ranks, F.col("o_orderpriority")), F.lit(2)))
    return o.orderBy("urgency", "o_orderdate", "o_orderkey").select("o_orderkey", "urgency")


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderpriority ILIKE '%urgent%')::BIGINT AS total FROM orders WHERE o_orderpriority ILIKE '%urgent%' ORDER BY o_orderkey DESC LIMIT 300 OFFSET 100")
def page_log(spark, sf_dir):
    """A page of a report, with the count of all rows that match."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").ilike("%urgent%"))
    page = o.orderBy(F.desc("o_orderkey")).offset(100).limit(300)
    return page.join(F.broadcast(o.agg(F.count("*").alias("total")))).select("o_orderkey", "o_totalprice", "total")


@query("SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')::BIGINT AS done, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P')::BIGINT AS pending FROM orders WHERE o_orderstatus <> 'O' ORDER BY o_orderkey DESC LIMIT 200")
def page_tariff_log(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    stats = o.agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"))
    return o.where("o_orderstatus <> 'O'").select("o_orderkey").orderBy(F.desc("o_orderkey")).limit(200).join(F.broadcast(stats))


@query("SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'tion') ORDER BY n_chars DESC, doc_id LIMIT 200")
def cache_listing(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("tion"))).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(200)


@query("SELECT event_id, substring(event_type || ' ' || props, 1, 300) AS said FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 500")
def unanswered_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id", F.substring(F.concat_ws(" ", "event_type", "props"), 1, 300).alias("said"))


@query("SELECT user_id, max(ts) AS seen FROM events GROUP BY user_id ORDER BY seen DESC, user_id LIMIT 100")
def lru_cap(spark, sf_dir):
    """Sessions that a cache of 100 would hold: the latest seen."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("seen")).orderBy(F.desc("seen"), "user_id").limit(100)


# Deduplication, set operations, mutation


def _first_sql(key):
    return f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {key} ORDER BY doc_id) AS rn FROM documents WHERE trim(text) <> '') WHERE rn = 1"


@query(_first_sql("sha1(lower(trim(text)))"))
def dedup_content(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.trim("text") != "")
    return d.select("doc_id", F.sha1(F.lower(F.trim("text"))).alias("h")).groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query(_first_sql("sha1(lower(substring(text, 1, 300)))"))
def dedup_prefix300(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.trim("text") != "")
    return d.select("doc_id", F.sha1(F.lower(F.substring("text", 1, 300))).alias("h")).groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("SELECT source, lang, min(doc_id) AS first_id, count(*)::BIGINT AS n FROM documents GROUP BY source, lang")
def distinct_sources(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


@query("SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (WHERE p_size <= 2)::BIGINT AS dropped, (count(*) FILTER (WHERE p_size > 2) - count(DISTINCT CASE WHEN p_size > 2 THEN p_name END))::BIGINT AS repeated FROM part")
def sanitize_catalog(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy(F.when(F.col("p_size") > 2, F.col("p_name")).alias("name"), (F.col("p_size") > 2).alias("ok")).agg(F.count("*").alias("n"))
    n = lambda cond, x: F.sum(F.when(cond, x).otherwise(0)).cast("long")
    return p.agg(F.sum("n").alias("n_rows"), n(~F.col("ok"), F.col("n")).alias("dropped"), (n(F.col("ok"), F.col("n")) - n(F.col("ok"), F.lit(1))).alias("repeated"))


@query("""WITH d AS (SELECT doc_id, lang, sha1(text) AS h, concat_ws('|', source, sha1(trim(regexp_replace(lower(text), '[^\\pL\\pN]+', ' ', 'g')))) AS k FROM documents WHERE lang IS NOT NULL),
f AS (SELECT lang, h, min(doc_id) AS doc_id FROM d GROUP BY lang, h) SELECT min(doc_id) AS doc_id FROM f JOIN d USING (lang, h, doc_id) GROUP BY lang, k""")
def dedup_two_key(spark, sf_dir):
    """A recurrence over whole texts as they are, and within a source by letters and digits in lower case."""
    same = F.sha1(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha1("text").alias("h"), F.concat_ws("|", "source", same).alias("k"))
    return D.two_key_dedup(d.where("lang IS NOT NULL"), "h", "k", "doc_id", "lang").select("doc_id")


@query("SELECT lang, count(*)::BIGINT AS n, sum(CASE WHEN text IS NULL THEN 1 ELSE 0 END)::BIGINT AS replaced FROM (SELECT lang, text FROM documents WHERE lang <> 'de' UNION ALL SELECT lang, NULL FROM documents WHERE lang = 'de' AND doc_id % 2 = 0) GROUP BY lang")
def replace_partition(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", "lang", "text")
    new = d.where("lang = 'de' AND doc_id % 2 = 0").withColumn("text", F.lit(None).cast("string"))
    return D.replace_partition(d, new, "lang", "de").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("replaced"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -o_orderkey, 'N' FROM orders WHERE o_orderkey % 1000 = 1")
def upsert_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    new = o.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X")).unionByName(o.where("o_orderkey % 1000 = 1").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus")))
    return D.upsert(o, new, "o_orderkey")


@query("SELECT d.doc_id, coalesce(CASE WHEN l.quality IN (-1, 0, 1) THEN l.quality END, 0)::BIGINT AS rating FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def apply_ratings(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").where("quality IN (-1, 0, 1)").select("doc_id", "quality")
    return d.join(l, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0)).cast("long").alias("rating"))


_BRANCHES = ["Regional: Oruro", "Oficina Central: La Paz", "regional : Santa Cruz", "Cochabamba", "Sucre", "Beni", "Pando", "Tarija", "Potosi"]
_NAMED = ["La Paz", "scz", " CBBA ", "trini", "Trinidad", "paz", "potosí", "x", "santa cruz de la sierra", "a"]
_ALIASED = "coalesce(map_extract_value(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in lex.CITY_ALIASES.items()) + "}, t), t)"


@query(f"""SELECT c_custkey, CASE {" ".join(f"WHEN contains('{R.city_of(b)}', u) THEN '{b}'" for b in _BRANCHES)} END AS branch FROM (
  SELECT c_custkey, {_ALIASED} AS u FROM (SELECT c_custkey, lower(trim(CASE WHEN c_custkey % 11 = 10 THEN c_name ELSE {sql_list(_NAMED)}[c_custkey % 11 + 1] END)) AS t FROM customer))""")
def first_contains(spark, sf_dir):
    """The branch that a text names by its city alone."""
    at = F.col("c_custkey") % 11
    text = F.when(at == 10, F.col("c_name")).otherwise(F.get(T.words_array(_NAMED), at.cast("int")))
    return table(spark, sf_dir, "customer").select("c_custkey", R.only_city(text, _BRANCHES).alias("branch"))


def _rewritten() -> str:
    out = "lower(text)"
    for old, new in lex.CITY_ALIASES.items():
        out = f"replace({out}, '{old}', '{new}')"
    return out


_CITIES = list(dict.fromkeys(lex.CITY_ALIASES.values()))


@query(f"""WITH t AS (SELECT doc_id, {_rewritten()} AS t FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || ' donde queda la oficina de cobija' WHEN 1 THEN text || ' mapa de LPB' ELSE text END AS text FROM documents)),
a AS (SELECT doc_id, t, len(list_filter({sql_list(lex.LOCATION)}, lambda w: contains(t, w))) > 0 AS asked FROM t)
SELECT doc_id, asked, CASE WHEN asked THEN CASE {" ".join(f"WHEN contains(t, '{c}') THEN '{c}'" for c in _CITIES)} END END AS place FROM a""")
def location_query(spark, sf_dir):
    """Whether each text, some with a question put behind them, asks for a location, and of which city."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" donde queda la oficina de cobija"))).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit(" mapa de LPB"))).otherwise(F.col("text"))
    return d.select("doc_id", R.location_of(text, _CITIES).alias("l")).select("doc_id", "l.asked", "l.place")


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 7 <> 0 THEN 'words' END AS method FROM documents)
SELECT doc_id, CASE WHEN method IS NOT NULL AND length(trim(text)) >= 180 THEN 'kept' WHEN page_id IS NULL THEN 'failed' WHEN length(html) > length(text) THEN 'improved' ELSE 'reprocessed' END AS state,
  CASE WHEN (method IS NULL OR length(trim(text)) < 180) AND page_id IS NOT NULL THEN length(coalesce(html, '')) ELSE length(text) END::BIGINT AS chars FROM d LEFT JOIN pages ON page_id = doc_id""")
def reprocess_flags(spark, sf_dir):
    """Catalogue entries without a method or with a text under 180 characters are extracted anew where their file is there."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("doc_id") % 7 != 0, "words").alias("method"))
    files = table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("new_text"))
    return D.reprocessed(d, files, "doc_id", "page_id")


_TICKET_CHANGES = "SELECT o_orderkey AS ticket, CASE WHEN o_orderstatus = 'P' THEN 'resolved' ELSE 'assigned' END AS state, o_custkey AS who, o_orderdate AS changed FROM orders WHERE o_orderkey % 5 = 0"


@query(f"""WITH c AS ({_TICKET_CHANGES} UNION ALL SELECT o_orderkey, 'assigned', -1, o_orderdate - INTERVAL 1 DAY FROM orders WHERE o_orderkey % 10 = 0),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticket ORDER BY changed DESC) AS rn FROM c) WHERE rn = 1)
SELECT o_orderkey, coalesce(l.state, 'open') AS state, l.who AS agent FROM orders LEFT JOIN l ON ticket = o_orderkey""")
def ticket_changes(spark, sf_dir):
    """Tickets after their latest change: assigned or resolved, and by whom."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_orderdate")
    state = F.when(F.col("o_orderstatus") == "P", "resolved").otherwise("assigned")
    new = o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("ticket"), state.alias("state"), F.col("o_custkey").cast("long").alias("who"), F.col("o_orderdate").cast("timestamp").alias("at"))
    old = o.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("ticket"), F.lit("assigned").alias("state"), F.lit(-1).cast("long").alias("who"), (F.col("o_orderdate").cast("timestamp") - F.expr("INTERVAL 1 DAY")).alias("at"))
    last = new.unionByName(old).groupBy("ticket").agg(F.max_by(F.struct("state", "who"), "at").alias("c"))
    out = o.join(last, F.col("ticket") == F.col("o_orderkey"), "left")
    return out.select("o_orderkey", F.coalesce("c.state", F.lit("open")).alias("state"), F.col("c.who").alias("agent"))


@query("SELECT page_id FROM pages WHERE NOT (url LIKE 'https://m.%')")
def clear_pattern(spark, sf_dir):
    """Keys of a cache that stay when those of a pattern are cleared."""
    return D.without_pattern(table(spark, sf_dir, "pages").select("page_id", "url"), "url", "https://m.*").select("page_id")
