"""Search and chunking over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import containment
from ..operators import retrieval as R
from ..operators import vectors as V
from ..operators.best_matches import best_matches
from ..scratch import scratch_path
from ..session import spread, table
from ..sources.vector_store import VectorStore
from .registry import ORACLE_SQL, query, sql_list
from .rule_queries import invented_sql
from .text_queries import NORM_SQL, clean_sql


def _query_vector(spark, sf_dir, vec_id=0) -> list[float]:
    """The vector of one row, a literal of the plan."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


_SIM = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"
_VEC = f"SELECT e.vec_id, e.label, {_SIM} AS sim FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


@query(f"SELECT vec_id, sim FROM ({_VEC}) ORDER BY sim DESC, vec_id LIMIT 10")
def cosine_topk(spark, sf_dir):
    return R.cosine_topk(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10).select("vec_id", "sim")


@query(f"SELECT vec_id, sim FROM ({_VEC}) WHERE sim >= 0.2 ORDER BY sim DESC, vec_id LIMIT 24")
def vec_min_score(spark, sf_dir):
    return R.cosine_topk(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 24, floor=0.2).select("vec_id", "sim")


@query(f"SELECT vec_id, label, sim FROM ({_VEC}) WHERE label = 3 ORDER BY sim DESC, vec_id LIMIT 10")
def vec_filtered(spark, sf_dir):
    return R.cosine_topk(table(spark, sf_dir, "embeddings").where("label = 3"), _query_vector(spark, sf_dir), 10).select("vec_id", "label", "sim")


@query(f"SELECT vec_id, label, sim FROM ({_VEC}) ORDER BY CASE label WHEN 3 THEN 0 WHEN 5 THEN 1 ELSE 99 END, sim DESC, vec_id LIMIT 60")
def preferred_topn(spark, sf_dir):
    """Rows of preferred labels first, in their order, then the others."""
    scored = table(spark, sf_dir, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in _query_vector(spark, sf_dir)])
    scored = scored.select("vec_id", "label", F.round(T.cosine(F.col("embedding"), q), 6).alias("sim"))
    return scored.orderBy(R.preference(F.col("label").cast("string"), ["3", "5"]), F.desc("sim"), "vec_id").limit(60)


@query(f"""SELECT vec_id, round(sim + 0.08 * CASE kind WHEN 'knowledge_base' THEN 7 WHEN 'pdf' THEN 6 WHEN 'history' THEN 5 WHEN 'branch' THEN 5 WHEN 'json_data' THEN 3 ELSE 1 END
  + CASE kind WHEN 'pdf' THEN 0.22 WHEN 'history' THEN 0.16 ELSE 0.0 END - CASE WHEN vec_id % 400 > 300 THEN 0.3 ELSE 0.0 END, 6) AS score FROM (
  SELECT vec_id, sim, ['knowledge_base', 'pdf', 'history', 'branch', 'json_data', 'x'][label % 6 + 1] AS kind FROM ({_VEC}))""")
def score_combine(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in ("knowledge_base", "pdf", "history", "branch", "json_data", "x")])
    q = F.array(*[F.lit(float(x)) for x in _query_vector(spark, sf_dir)])
    sim = F.round(T.cosine(F.col("embedding"), q), 6)
    kind = F.get(kinds, F.col("label") % 6)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(R.combined_score(sim, kind, F.col("vec_id") % 400, ["pdf", "history"]), 6).alias("score"))


_BM25 = """WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-záéíóúñü0-9]+'), lambda x: length(x) >= 2) AS toks FROM documents),
z AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avg_len FROM t), p AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS w FROM t),
tf AS (SELECT doc_id, dl, w, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT w, ln(n_docs - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, z GROUP BY w, n_docs),
m AS (SELECT avg(idf) AS mean_idf FROM df), a AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-záéíóúñü0-9]+'), lambda x: length(x) >= 2))) AS w FROM benchmark),
s AS (SELECT query_id, doc_id, sum(CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len))) AS score FROM tf JOIN df USING (w) JOIN a USING (w), m, z GROUP BY query_id, doc_id)"""


def _best(spark, sf_dir, n, name="rank"):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return best_matches(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), queries, n, name)


@query(f"{_BM25} SELECT query_id, doc_id, round(score / max(score) OVER (PARTITION BY query_id), 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s) WHERE rank <= 10")
def bm25_topn(spark, sf_dir):
    from pyspark.sql import Window

    top = _best(spark, sf_dir, 10)
    return top.select("query_id", "doc_id", F.round(F.col("score") / F.max("score").over(Window.partitionBy("query_id")), 5).alias("score"))


@query(f"""WITH v AS (SELECT vec_id, row_number() OVER (ORDER BY sim DESC, vec_id) AS r FROM ({_VEC}) QUALIFY r <= 24), l AS (SELECT vec_id, row_number() OVER (ORDER BY label DESC, vec_id) AS r FROM embeddings QUALIFY r <= 24)
SELECT coalesce(v.vec_id, l.vec_id) AS vec_id, round(coalesce(0.6 / (60 + v.r), 0) + coalesce(0.4 / (60 + l.r), 0), 9) AS score FROM v FULL JOIN l ON v.vec_id = l.vec_id""")
def rrf_fusion(spark, sf_dir):
    """Two lists of 24, each the head of an order, fused."""
    near = R.cosine_topk(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 24).select(F.lit(0).alias("q"), "vec_id", "sim")
    other = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("q"), "vec_id", "label").orderBy(F.desc("label"), "vec_id").limit(24)
    fused = R.rrf(R.ranked(near, "q", [F.desc("sim"), F.col("vec_id")], 24), R.ranked(other, "q", [F.desc("label"), F.col("vec_id")], 24), "vec_id")
    return fused.select("vec_id", F.round("score", 9).alias("score"))


@query(f"""{_BM25}, c AS (SELECT query_id, string_agg('[Source: ' || source || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS c FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s) JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY query_id)
SELECT query_id, CASE WHEN length(c) <= 2800 THEN c ELSE regexp_extract(substring(c, 1, 2800), '(?s)^(.*) ', 1) END AS context FROM c""")
def build_context(spark, sf_dir):
    blocks = _best(spark, sf_dir, 3).join(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    return R.build_context(blocks, "query_id", "rank", "source", "text")


_TOKENS = "len(regexp_extract_all({c}, '[\\pL\\pN\\pM_]+|[^\\s\\pL\\pN\\pM_]'))"


@query(f"""WITH d AS (SELECT source, doc_id, text, {_TOKENS.format(c="text")} AS n FROM documents WHERE {_TOKENS.format(c="text")} > 0),
u AS (SELECT *, sum(n) OVER w AS used, row_number() OVER w AS rn, regexp_split_to_array(trim(text), '\\s+') AS words FROM d WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)),
c AS (SELECT source, CASE WHEN n > 1400 THEN {_TOKENS.format(c="array_to_string(words[1:greatest(floor(len(words) * 1400 / n), 1)::BIGINT], ' ')")} ELSE n END AS n FROM u WHERE used <= 1400 OR rn = 1)
SELECT source, count(*)::BIGINT AS n_blocks, sum(n)::BIGINT AS n_tokens FROM c GROUP BY source""")
def context_prefix(spark, sf_dir):
    """Blocks of each source that a budget of 1400 tokens holds."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return R.context_prefix(d, "source", "doc_id", "text", 1400).groupBy("source").agg(F.count("*").alias("n_blocks"), F.sum("n").alias("n_tokens"))


_NORM_LOCAL = "trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9áéíóúñü \t\n\r]', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'))"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"""WITH p AS (SELECT item_id, {_NORM_LOCAL.format(c="text")} AS phrase FROM benchmark), a AS (SELECT *, list_filter(string_split(phrase, ' '), lambda w: length(w) >= 4) AS long FROM p WHERE phrase <> ''),
q AS (SELECT item_id, phrase, CASE WHEN len(long) > 0 THEN long ELSE string_split(phrase, ' ') END AS words FROM a), d AS (SELECT doc_id, text, {_NORM_LOCAL.format(c="text")} AS norm FROM documents),
s AS (SELECT item_id, doc_id, 2 * len(list_filter(words, lambda w: contains(d.norm, w))) + CASE WHEN contains(d.norm, phrase) THEN 4 ELSE 0 END AS score FROM q, d),
t AS (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 2),
f AS (SELECT t.*, text, instr(norm, list_filter(words, lambda w: contains(norm, w))[1]) - 1 AS pos FROM t JOIN q USING (item_id) JOIN d USING (doc_id)),
c AS (SELECT *, trim(substring(text, greatest(pos - 220, 0) + 1, pos + 650 - greatest(pos - 220, 0)), {_BLANKS}) AS piece FROM f)
SELECT item_id, doc_id, score::BIGINT AS score, CASE WHEN piece = '' THEN trim(substring(text, 1, 700), {_BLANKS}) ELSE piece END AS snippet FROM c""")
def local_search(spark, sf_dir):
    """Two documents for each item by the words and the whole phrase they contain, with a snippet."""
    q = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("phrase"))
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return containment.local_search(d, q, 2)


@query(f"""{_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS old FROM s QUALIFY old <= 10),
x AS (SELECT query_id, doc_id, old, {_NORM_LOCAL.format(c="b.text")} AS q, {_NORM_LOCAL.format(c="d.text")} AS t FROM r JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id),
y AS (SELECT *, list_filter(string_split(q, ' '), lambda w: length(w) >= 3) AS words FROM x),
h AS (SELECT query_id, doc_id, old, CASE WHEN len(words) = 0 THEN 0 ELSE len(list_filter(words, lambda w: contains(t, w))) + CASE WHEN contains(t, q) THEN 3 ELSE 0 END END::BIGINT AS hits FROM y)
SELECT query_id, doc_id, hits, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, old)::INTEGER AS rank FROM h""")
def lexical_rerank(spark, sf_dir):
    """The ten best documents of each item, ranked anew by the words of the item they contain."""
    top = _best(spark, sf_dir, 10, "old").select("query_id", "doc_id", "old")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    rows = top.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").join(b, "query_id")
    return R.lexical_rerank(rows, "query_id", "old", "q", "text").select("query_id", "doc_id", "hits", "rank")


def _item_vectors(spark, sf_dir):
    """Items as queries, with their text and, as no model is here, the vector of the row that has their id."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).join(e, "query_id")


_KNN = """SELECT b.item_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS sim FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings e
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, e.vec_id) <= {k}"""


@query(_KNN.format(k=10))
def knn_join(spark, sf_dir):
    """The ten nearest vectors of every item."""
    near = V.knn(table(spark, sf_dir, "embeddings"), _item_vectors(spark, sf_dir), 10)
    return near.select("query_id", "vec_id", "sim")


def _store(spark, sf_dir):
    return VectorStore.create(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), scratch_path(spark, "vectors"))


@query(_KNN.format(k=10))
def store_search_all(spark, sf_dir):
    """The ten nearest of every item in a stored table, all lists probed."""
    store = _store(spark, sf_dir)
    return store.search(_item_vectors(spark, sf_dir), 10, len(store.centroids)).select("query_id", "vec_id", "sim")


@query()
def store_search(spark, sf_dir):
    """The ten nearest of every item in the nearest lists of a stored table, as many as its sample asks for; tests hold its recall against the exact ones."""
    return _store(spark, sf_dir).search(_item_vectors(spark, sf_dir), 10)


@query(f"""{_BM25}, v AS (SELECT query_id, vec_id AS doc_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS ra FROM ({_KNN.format(k=24)})),
l AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rb FROM s WHERE query_id IN (SELECT vec_id FROM embeddings) QUALIFY rb <= 48),
u AS (SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.doc_id, l.doc_id) AS doc_id, round(coalesce(0.6 / (60 + ra), 0) + coalesce(0.4 / (60 + rb), 0), 9) AS score, round(coalesce(1 - sim, 0.5), 6) AS distance FROM v FULL JOIN l ON v.query_id = l.query_id AND v.doc_id = l.doc_id),
best AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 24),
n AS (SELECT doc_id, {NORM_SQL} AS norm FROM documents), h AS (SELECT * FROM best JOIN n USING (doc_id) WHERE norm <> '' QUALIFY row_number() OVER (PARTITION BY query_id, sha1(lower(substring(norm, 1, 300))) ORDER BY score DESC, doc_id) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score, distance, sha1(norm) AS text_sha1 FROM h""")
def hybrid_search(spark, sf_dir):
    """Vector neighbours and BM25 hits of every item, fused by rank, one of each text."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = R.hybrid_search(e, d, _item_vectors(spark, sf_dir), 24)
    return found.select("query_id", "rank", "doc_id", "score", "distance", F.sha1("text").alias("text_sha1"))


_KINDS = ["knowledge_base", "pdf", "history", "branch", "json_data", "x"]


@query(f"""WITH h AS ({ORACLE_SQL['hybrid_search']}), k AS (SELECT h.* EXCLUDE (rank), {sql_list(_KINDS)}[doc_id % 6 + 1] AS kind, length(norm) AS chars FROM h JOIN (SELECT doc_id, {NORM_SQL} AS norm FROM documents) USING (doc_id)),
c AS (SELECT *, round((1 - distance) + 0.08 * CASE kind WHEN 'knowledge_base' THEN 7 WHEN 'pdf' THEN 6 WHEN 'history' THEN 5 WHEN 'branch' THEN 5 WHEN 'json_data' THEN 3 ELSE 1 END
  + CASE kind WHEN 'pdf' THEN 0.22 WHEN 'history' THEN 0.16 ELSE 0.0 END - CASE WHEN chars > 1.2 * 2000 THEN 0.3 ELSE 0.0 END, 6) AS final, CASE kind WHEN 'pdf' THEN 0 WHEN 'history' THEN 1 ELSE 99 END AS pref FROM k WHERE 1 - distance >= 0.05)
SELECT query_id, doc_id, kind, final AS score, row_number() OVER (PARTITION BY query_id ORDER BY pref, final DESC, doc_id)::INTEGER AS rank FROM c QUALIFY rank <= 7""")
def search_items(spark, sf_dir):
    """The search core for every item: hybrid hits, a floor, priority and preference of sources, a penalty for long texts, preferred sources first."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    hits = R.hybrid_search(e, d, _item_vectors(spark, sf_dir), 24)
    kind = F.get(F.array(*[F.lit(k) for k in _KINDS]), (F.col("doc_id") % 6).cast("int"))
    return R.best_sources(hits.withColumn("kind", kind), ["pdf", "history"], 7, 0.05, 2000).select("query_id", "doc_id", "kind", "score", "rank")


@query(f"""WITH v AS (SELECT vec_id, label, sim FROM ({_VEC})), a AS (SELECT vec_id, label, sim, 0 AS stage FROM v WHERE label = 3 ORDER BY sim DESC, vec_id LIMIT 8), b AS (SELECT vec_id, label, sim, 1 AS stage FROM v ORDER BY sim DESC, vec_id LIMIT 16)
SELECT vec_id, label, sim, min(stage)::INTEGER AS stage FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY vec_id, label, sim""")
def union_dedup(spark, sf_dir):
    """Hits of the preferred label, then of all, each once."""
    from ..operators.dedup import union_in_order

    e, q = table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir)
    stages = [R.cosine_topk(e.where("label = 3"), q, 8), R.cosine_topk(e, q, 16)]
    return union_in_order([s.select("vec_id", "label", "sim") for s in stages], "vec_id")


@query("SELECT vec_id, label::VARCHAR || ':' || sha256(array_to_string(list_sort(['b', 'a']), ',') || '|' || vec_id)[1:16] AS cache_key FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 2)")
def memo_misses(spark, sf_dir):
    """Keys that a memo lacks."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    key = F.substring(F.sha2(F.concat(F.array_join(F.sort_array(F.array(F.lit("b"), F.lit("a"))), ","), F.lit("|"), F.col("vec_id").cast("string")), 256), 1, 16)
    missing = e.join(e.where("label = 2").select("vec_id"), "vec_id", "left_anti")
    return missing.select("vec_id", F.concat(F.col("label").cast("string"), F.lit(":"), key).alias("cache_key"))


@query(f"""WITH top AS (SELECT vec_id, label, sim, sim + CASE label WHEN 3 THEN 0.22 WHEN 5 THEN 0.16 ELSE 0 END AS score FROM ({_VEC}) WHERE sim >= 0.05), c AS (SELECT t.*, d.text, d.source FROM top t JOIN documents d ON d.doc_id = t.vec_id),
f AS (SELECT *, row_number() OVER (PARTITION BY sha1(lower(substring(text, 1, 300))) ORDER BY round(score, 6) DESC, vec_id) AS dup FROM c)
SELECT vec_id, source, round(score, 6) AS score FROM f WHERE dup = 1 ORDER BY CASE label WHEN 3 THEN 0 WHEN 5 THEN 1 ELSE 99 END, round(score, 6) DESC, vec_id LIMIT 7""")
def search_topk(spark, sf_dir):
    """The search core: similarity, floor, bonus, text dedup keeping the best, preferred first, top 7."""
    q = F.array(*[F.lit(float(x)) for x in _query_vector(spark, sf_dir)])
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.round(T.cosine(F.col("embedding"), q), 6).alias("sim")).where("sim >= 0.05")
    bonus = F.when(F.col("label") == 3, 0.22).when(F.col("label") == 5, 0.16).otherwise(0.0)
    e = e.withColumn("score", F.round(F.col("sim") + bonus, 6))
    c = e.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source", F.sha1(F.lower(F.substring("text", 1, 300))).alias("h")), "vec_id")
    best = c.groupBy("h").agg(F.min_by(F.struct("vec_id", "label", "source", "score"), F.struct(-F.col("score"), F.col("vec_id"))).alias("b")).select("b.*")
    return best.orderBy(R.preference(F.col("label").cast("string"), ["3", "5"]), F.desc("score"), "vec_id").limit(7).select("vec_id", "source", "score")


@query()
def chunk_documents(spark, sf_dir):
    """A sequential cut; tests hold it against a plain loop."""
    return C.chunks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query(f"""WITH n AS (SELECT doc_id, {NORM_SQL} AS norm FROM (SELECT doc_id, '# head' || chr(10) || text || chr(10) || 'TITULO: the end of it' AS text FROM documents)),
b AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(norm, '(?m)^({C.STARTS})', chr(1) || '\\1', 'g'), chr(1)), lambda b: trim(b, ' ' || chr(10))), lambda b: b <> '') AS b FROM n)
SELECT doc_id AS source_id, unnest(range(len(b)))::INTEGER AS block_index, unnest(b) AS block FROM b""")
def segment_blocks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# head\n"), "text", F.lit("\nTITULO: the end of it")).alias("text"))
    return C.segments(d)


#: crc32 of a word's UTF-8.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substring(hex(encode(w)), 2 * i + 1, 2))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""


@query(f"""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM documents), n AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY ALL),
h AS (SELECT w, {_CRC32} AS h FROM (SELECT DISTINCT w FROM n)), v AS (SELECT doc_id, h % 64 AS pos, sum(CASE WHEN (h // 1024) % 2 = 1 THEN n ELSE -n END)::DOUBLE AS x FROM n JOIN h USING (w) GROUP BY ALL)
SELECT doc_id, pos::INTEGER AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 9) AS value FROM v WHERE x <> 0""")
def embed_stub(spark, sf_dir):
    """The provider interface with its deterministic stub, hashed words of unit length: the places of each vector that are not zero."""
    from .providers import embed

    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", embed(F.col("text")).alias("embedding"))
    return d.select("doc_id", F.posexplode("embedding").alias("pos", "value")).where("value <> 0").withColumn("value", F.round("value", 9))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: w <> ''))"


@query(f"""{_BM25}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS old FROM s QUALIFY old <= 10),
x AS (SELECT query_id, doc_id, {_WORDS.format(c="b.text")} AS q, {_WORDS.format(c="d.text")} AS w FROM r JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id),
y AS (SELECT query_id, doc_id, len(list_intersect(q, w)) / greatest(1, len(q)) AS score FROM x)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM y QUALIFY rank <= 7""")
def rerank_stub(spark, sf_dir):
    """The reranker interface with its deterministic stub, on the ten best of each benchmark item."""
    from .providers import rerank

    top = _best(spark, sf_dir, 10).select("query_id", "doc_id")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    rows = top.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").join(b, "query_id")
    scored = rows.select("query_id", "doc_id", rerank(F.col("q"), F.col("text")).alias("score"))
    return R.ranked(scored, "query_id", [F.desc("score"), F.col("doc_id")], 7)


def _questions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("text").alias("question"), F.lit("es").alias("lang"))


def _over(name: str, **tables: str) -> str:
    """The SQL of a query over other tables than its own."""
    return f"(WITH {', '.join(f'{t} AS ({sql})' for t, sql in tables.items())} SELECT * FROM ({ORACLE_SQL[name]}))"


_ASKED = "SELECT id AS doc_id, question AS text FROM asked"
_MADE = "SELECT key AS doc_id, answer AS text FROM made"


@query(f"""WITH asked AS (SELECT conv_id || ':' || turn AS id, text AS question, sha256(trim(regexp_replace(lower(text), '[ \t\n\r]+', ' ', 'g')) || '|es')[1:32] AS key FROM conversations WHERE role = 'user'),
r AS (SELECT id, key, question, CASE WHEN injection THEN 'refused' WHEN greeting THEN 'greeting' WHEN outside THEN 'out_of_domain' END AS kind FROM asked JOIN {_over("flt_injection", documents=_ASKED)} i ON i.doc_id = id
  LEFT JOIN {_over("flt_greeting", documents=_ASKED)} g ON g.doc_id = id JOIN {_over("flt_out_of_domain", documents=_ASKED)} o ON o.doc_id = id),
b AS (SELECT key, min(question) AS query FROM r WHERE kind IS NULL GROUP BY key), c AS {_over("build_context", benchmark="SELECT key AS item_id, query AS text FROM b")},
m AS (SELECT key, context, substring(string_split(context || chr(10) || chr(10) || query, '.')[1], 1, 200) AS said FROM b LEFT JOIN c ON query_id = key), made AS (SELECT key, context, {clean_sql("said")} AS answer FROM m),
k AS (SELECT key, answer, CASE WHEN context IS NULL THEN 'no_context' WHEN coalesce(length(trim(answer)), 0) = 0 THEN 'failed' WHEN hallucinated THEN 'made_up' WHEN coalesce(len({invented_sql("answer", "context")}) >= 5, false) THEN 'invented' WHEN broken THEN 'broken_off' ELSE 'answered' END AS kind
  FROM made LEFT JOIN {_over("flt_hallucination", conversations="SELECT key AS conv_id, 0 AS turn, 'assistant' AS role, answer AS text FROM made")} h ON conv_id = key LEFT JOIN {_over("flt_incomplete", documents=_MADE)} f ON f.doc_id = key)
SELECT id, kind, kind AS answer FROM r WHERE kind IS NOT NULL UNION ALL SELECT id, k.kind, CASE WHEN k.kind = 'answered' THEN k.answer ELSE 'no answer' END FROM r JOIN k USING (key) WHERE r.kind IS NULL""")
def answer_plan(spark, sf_dir):
    """Questions of users answered by rules, by documents and the model interface (a stub, which the SQL knows)."""
    from .answers import answer_questions
    from .providers import MODELS

    model = MODELS["answer"]
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    empty = spark.createDataFrame([], "key string, answer string")
    return answer_questions(_questions(spark, sf_dir), d, empty, lambda texts: [model(t) for t in texts])[0]


@query("SELECT conv_id, turn, text, CASE WHEN trim(text) = '' THEN text WHEN length(text) % 3 = 0 THEN replace(text, 'e', '3') WHEN length(text) % 3 = 1 THEN '<' || text || '>' ELSE text END AS translated, CASE WHEN trim(text) = '' OR text IS NULL THEN NULL WHEN length(text) % 3 = 0 THEN 'loud' WHEN length(text) % 3 = 1 THEN 'marked' ELSE 'original' END AS provider FROM conversations")
def translate_turns(spark, sf_dir):
    """Texts through two providers (stubs) that fail for some of them; each distinct text asked once."""
    from .answers import translated

    loud = lambda texts: [t.replace("e", "3") if len(t) % 3 == 0 else None for t in texts]
    marked = lambda texts: [f"<{t}>" if len(t) % 3 == 1 else None for t in texts]
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return translated(rows, "text", [("loud", loud), ("marked", marked)])
