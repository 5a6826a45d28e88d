"""The contract's queries: each runs its operator over whole tables and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontam, embed_dedup, html_wrapper, langid, lexical, packing, periodic, pii, quality, simhash, tier_packing, warc
from ..session import spread, table
from .common import id_hash, materialize, scratch_path


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", planted), (-1, 1, "assistant", planted)], "conv_id long, turn long, role string, text string")
    turns = turns.unionByName(extra).withColumn("content", chat_format.text_part(F.col("text")))
    return chat_format.digests(chat_format.format_turns(turns))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract_pages(table(spark, sf_dir, "pages"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.overlaps(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "matched", "length")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenize(table(spark, sf_dir, "documents"), vocabulary()))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    heads = materialize(warc.read(spark, path).drop("html", "url"), "warc-headers")
    return warc.resolved(heads).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.classify(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tier_packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def repeated_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; the texts of about a tenth of the documents, picked by their id, end in repeats of a period. Rows without an id stay as they are."""
    drawn, hash_of = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), id_hash("doc_id")

    def tail(words):
        g, n = F.floor(hash_of / 10), F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p)))
        return F.when(n > 0, F.array_join(at, " ")).otherwise("")

    text = F.when(F.col("doc_id").isNotNull() & (hash_of % 10 == 0), F.get(F.transform(F.array(drawn), tail), F.lit(0))).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(repeated_tails(table(spark, sf_dir, "documents")))
    above = lambda x, b: x["length"] * b["period"] > b["length"] * x["period"]
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda b, x: F.when(above(x, b), x).otherwise(b))  # runs are by start, then period
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.floor(1000 * F.col("b.length") / F.col("b.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_chat_formatting,
        op2_quality_classifier,
        op3_html_extraction,
        op4_benchmark_decontamination,
        op5_simhash_near_dedup,
        op6_best_fit_packing,
        op7_embedding_near_dedup,
        op8_warc_revisits,
        op9_language_id,
        op10_pii,
        op11_ranked_search,
        op12_tier_packing,
        op13_periodic_runs,
    )
}

#: Terms of a text; only A-Z lower-cased.
_TERMS = r"translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
#: crc32 of an id written as text.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""
_ESCAPED = r"regexp_replace({c}, '([<\[])(\\*/?(?:s|INST|ROLE|image|audio|document)[>\]])', '\1\\\2', 'g')"

#: DuckDB SQL of the operators that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
  sum({len(chat_format.TURN + chat_format.ROLE_END + chat_format.TURN_END)} + length({_ESCAPED.format(c="role")}) + length({_ESCAPED.format(c="text")}))::BIGINT AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g""",
    "op8_warc_revisits": """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p GROUP BY payload_digest),
r AS (SELECT p.*, CASE WHEN payload_bytes >= 100 AND (first_id < page_id OR page_id IS NULL) THEN first_id END AS refers_to FROM p JOIN f USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r""",
    "op11_ranked_search": rf"""
WITH t AS (SELECT doc_id, regexp_extract_all({_TERMS}) AS toks FROM documents WHERE text IS NOT NULL),
d AS (SELECT row_number() OVER () AS k, doc_id, toks, len(toks)::BIGINT AS n FROM t WHERE len(toks) > 0),
z AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM d),
tf AS (SELECT k, doc_id, n, word, count(*)::BIGINT AS tf FROM (SELECT k, doc_id, n, unnest(toks) AS word FROM d) GROUP BY ALL),
wt AS (SELECT word, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, z GROUP BY word, nd),
q AS (SELECT item_id, word, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all({_TERMS})) AS word FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, k, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt))))::BIGINT AS score FROM q JOIN wt USING (word) JOIN tf USING (word), z GROUP BY item_id, k, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20""",
    # runs are islands of pairs of equal words, ``period`` apart; one within a run of a shorter period has no smallest period of its own
    "op13_periodic_runs": f"""
WITH d AS (SELECT doc_id, h // 10 AS g, h % 10 = 0 AS drawn, ws, len(ws)::BIGINT AS n FROM (SELECT doc_id, {_CRC32} AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)),
e AS (SELECT *, CASE WHEN drawn AND n > 0 THEN g % n END AS a, CASE WHEN drawn AND n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM d),
w AS (SELECT doc_id, n, CASE WHEN p IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS ws FROM e),
u AS (SELECT doc_id, n, unnest(ws) AS word, unnest(range(n)) AS i FROM w),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4),
islands AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM islands x WHERE NOT EXISTS (SELECT 1 FROM islands y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.s <= x.s AND y.s + y.len >= x.s + x.len)),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len / q DESC, s, q) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM u ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, len::BIGINT AS length, q::BIGINT AS period, (1000 * len // q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
