"""Search: cosine k-NN, BM25, reciprocal rank fusion, score combination, preferred-first selection, context assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions.text import bm25_tokens, cosine, norm_local, norm_text, token_count
from ..scratch import materialize
from .best_matches import best_matches
from .vectors import knn


#: Words of queries up to which they are broadcast to drop other words before postings are shuffled; beyond, a join does it.
BROADCAST_WORDS = 400_000


def cosine_topk(vectors: DataFrame, query: list[float], k: int, vector_col: str = "embedding", id_col: str = "vec_id", floor: float | None = None) -> DataFrame:
    """The ``k`` vectors nearest to a literal query: one scan, a heap of k in each task (TakeOrderedAndProject)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("sim", F.round(cosine(F.col(vector_col), q), 6))
    if floor is not None:
        scored = scored.where(F.col("sim") >= floor)
    return scored.orderBy(F.desc("sim"), id_col).limit(k)


def bm25(docs: DataFrame, queries: DataFrame, text_col: str = "text", id_col: str = "doc_id", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """``query_id, doc_id, score`` of each document with a word of a query. queries: ``query_id, query``.

    Words that more than half of the documents hold get epsilon times the mean idf. Texts are cut
    into words once: document frequencies of all words are partial counts of what is kept of
    them, and so are numbers and lengths of documents; postings are made of words that a query has alone.
    """
    toks = materialize(docs.select(F.col(id_col).alias("doc_id"), bm25_tokens(F.col(text_col)).alias("toks")), "tokens")
    sizes = toks.agg(F.count("*").alias("n_docs"), F.avg(F.size("toks")).alias("avg_len"))
    df = toks.select(F.explode(F.array_distinct("toks")).alias("w")).groupBy("w").agg(F.count("*").alias("df")).join(F.broadcast(sizes))
    idf = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    df = df.select("w", idf.alias("idf"), "avg_len")
    mean = df.agg(F.avg("idf").alias("mean_idf"))
    asked = queries.select("query_id", F.explode(F.array_distinct(bm25_tokens(F.col("query")))).alias("w"))
    words = asked.select("w").distinct()
    words = F.broadcast(words) if words.count() <= BROADCAST_WORDS else words
    tf = toks.select("doc_id", F.size("toks").alias("len"), F.explode("toks").alias("w")).join(words, "w", "left_semi").groupBy("doc_id", "len", "w").agg(F.count("*").alias("tf"))
    weights = df.join(words, "w", "left_semi").join(F.broadcast(mean)).select("w", "avg_len", F.when(F.col("idf") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return tf.join(weights, "w").join(asked, "w").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def ranked(df: DataFrame, group: str, order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The ``n`` first rows of each group with their rank from 1; tasks keep n before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(name) <= n)


def rrf(semantic: DataFrame, lexical: DataFrame, keys: str | list[str], k: int = 60, w_semantic: float = 0.6, w_lexical: float = 0.4) -> DataFrame:
    """``keys, score``: reciprocal rank fusion of two lists, of one query or of several, with ``rank`` from 1; other columns stay, null where a list lacks a row."""
    keys = [keys] if isinstance(keys, str) else keys
    a, b = semantic.withColumnRenamed("rank", "_ra"), lexical.withColumnRenamed("rank", "_rb")
    term = lambda w, r: F.coalesce(F.lit(w) / (k + F.col(r)), F.lit(0.0))
    return a.join(b, keys, "full_outer").withColumn("score", term(w_semantic, "_ra") + term(w_lexical, "_rb")).drop("_ra", "_rb")


def hybrid_search(vectors: DataFrame, docs: DataFrame, queries: DataFrame, n: int, missing: float = 0.5) -> DataFrame:
    """``query_id, rank, doc_id, score, distance, text``: the ``n`` documents nearest by vector and the 2 ``n`` best by BM25 of each query, fused by rank.

    vectors: ``doc_id, embedding``; docs: ``doc_id, text``; queries: ``query_id, query, vector``. A document that
    BM25 alone finds has the distance ``missing``; one that has no text in docs goes. Of documents whose normalised texts begin with the
    same 300 characters the best of a query stays, and those without any go.
    """
    near = knn(vectors, queries.select("query_id", "vector"), n, id_col="doc_id").select("query_id", "doc_id", "rank", (1 - F.col("sim")).alias("near"))
    found = best_matches(docs, queries.select("query_id", "query"), 2 * n).select("query_id", "doc_id", "rank")
    fused = rrf(near, found, ["query_id", "doc_id"]).withColumn("score", F.round("score", 9))
    top = ranked(fused, "query_id", [F.desc("score"), F.col("doc_id")], n).select("query_id", "doc_id", "score", F.round(F.coalesce("near", F.lit(missing)), 6).alias("distance"))
    top = materialize(top, "fused")  # small, as Spark then knows: texts stay where they are; hits are written, so no other text is normalised
    hits = materialize(top.join(docs.select("doc_id", "text"), "doc_id"), "hits").withColumn("text", norm_text(F.col("text"))).where("text <> ''")
    hits = hits.withColumn("_head", F.sha1(F.lower(F.substring("text", 1, 300))))
    order = F.struct(-F.col("score"), F.col("doc_id"))
    kept = hits.groupBy("query_id", "_head").agg(F.min_by(F.struct("doc_id", "score", "distance", "text"), order).alias("r")).select("query_id", "r.*")
    return ranked(kept, "query_id", [F.desc("score"), F.col("doc_id")], n)


def lexical_rerank(rows: DataFrame, group: str, order: str, query: str, text: str, least: int = 3) -> DataFrame:
    """``rows`` with ``hits`` and ``rank``: each group's rows by words of the query that their text contains, equal ones in the order they had.

    Of the normalised query words of ``least`` letters or more count, as often as it has them, and 3 for
    the whole of it; without such a word nothing does.
    """
    q, t = norm_local(F.col(query)), norm_local(F.col(text))
    words = F.filter(F.split("_q", " "), lambda w: F.length(w) >= least)
    rows = rows.withColumn("_q", q).withColumn("_t", F.coalesce(t, F.lit(""))).withColumn("_w", F.coalesce(words, F.array().cast("array<string>")))
    hits = F.size(F.filter("_w", lambda w: F.contains("_t", w))) + F.when(F.contains("_t", "_q"), 3).otherwise(0)
    rows = rows.withColumn("hits", F.when(F.size("_w") > 0, hits).otherwise(0).cast("long"))
    w = Window.partitionBy(group).orderBy(F.desc("hits"), order)
    return rows.withColumn("rank", F.row_number().over(w)).drop("_q", "_t", "_w")


def preference(kind: Column, preferred: list[str]) -> Column:
    """Index of a type among the preferred ones, 99 if it is none of them."""
    at = F.array_position(F.array(*[F.lit(p) for p in preferred]), kind)
    return F.when(at > 0, at.cast("int") - 1).otherwise(99)


def combined_score(sim: Column, kind: Column, chars: Column, preferred: list[str], size: int = 250) -> Column:
    """Similarity, 0.08 a step of source priority, the bonus of preferred types, 0.3 less for over-long chunks."""
    priorities = F.create_map(*[F.lit(x) for kv in lex.SOURCE_PRIORITY.items() for x in kv])
    at = preference(kind, preferred)
    bonus = F.when(at == 99, 0.0).otherwise(F.greatest(F.lit(0.22) - F.lit(0.06) * at, F.lit(0.04)))
    return sim + 0.08 * F.coalesce(F.try_element_at(priorities, kind), F.lit(1)) + bonus - F.when(chars > 1.2 * size, 0.3).otherwise(0.0)


def best_sources(hits: DataFrame, preferred: list[str], n: int, floor: float, size: int) -> DataFrame:
    """``hits`` (``query_id, doc_id, distance, kind, text``) with ``score`` and ``rank``: the ``n`` best of each query, those of preferred kinds first.

    Hits less similar than ``floor`` go. The score is the similarity, raised by kind, lowered for texts longer than 1.2 ``size``.
    """
    sim = 1 - F.col("distance")
    kept = hits.where(sim >= floor).withColumn("score", F.round(combined_score(sim, F.col("kind"), F.length("text"), preferred, size), 6))
    return ranked(kept.drop("rank"), "query_id", [preference(F.col("kind"), preferred), F.desc("score"), F.col("doc_id")], n)


def context_prefix(blocks: DataFrame, group: str, order: str, text: str, most: int) -> DataFrame:
    """``group, order, text, n``: blocks of each group, in order, while their tokens ``n`` add up to ``most``.

    A first block that alone has more is cut to its share of words, so a context is never empty.
    Blocks without tokens are left out; each other has one at least, so no task sends on more
    than ``most`` rows of a group, however many it has.
    """
    rows = blocks.select(group, order, text, token_count(F.col(text)).alias("n")).where("n > 0")
    rows = ranked(rows, group, [F.col(order)], most, "_rank")
    used = F.sum("n").over(Window.partitionBy(group).orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_used", used).where((F.col("_used") <= most) | (F.col("_rank") == 1))
    words = F.split(F.trim(F.col(text)), r"\s+")
    share = F.array_join(F.slice(words, 1, F.greatest(F.floor(F.size(words) * most / F.col("n")).cast("int"), F.lit(1))), " ")
    rows = rows.withColumn(text, F.when(F.col("n") > most, share).otherwise(F.col(text)))
    return rows.select(group, order, text, F.when(F.col("n") > most, token_count(F.col(text))).otherwise(F.col("n")).alias("n"))


def build_context(blocks: DataFrame, group: str, order: str, label: str, text: str, most: int = 2800) -> DataFrame:
    """``group, context``: labelled blocks in order, clipped at the last space before ``most`` characters, so no block is sent on with many more."""
    block = F.struct(F.col(order), F.substring(F.concat(F.lit("[Source: "), F.col(label), F.lit("]\n"), F.col(text)), 1, most + 1).alias("b"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(block)), lambda x: x["b"]), "\n\n")
    out = blocks.groupBy(group).agg(whole.alias("c"))
    return out.select(group, F.when(F.length("c") <= most, F.col("c")).otherwise(F.regexp_extract(F.substring("c", 1, most), "(?s)^(.*) ", 1)).alias("context"))
