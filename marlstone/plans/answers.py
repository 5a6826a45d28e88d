"""Models over tables: each distinct text once, failed ones to the next provider; and the plan that answers questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import clean_answer, norm_question
from ..operators.best_matches import best_matches
from ..operators.retrieval import build_context
from ..scratch import materialize
from ..session import ship

#: A provider's name, and what it makes of some texts: a list of as many, None where it fails. If it raises, all have failed.
Provider = tuple[str, Callable[[list[str]], list[str | None]]]
#: Texts that a provider gets at a time.
TOGETHER = 64


def ask(texts: DataFrame, provider: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """``text, said`` for each row of ``text``; said is null where the provider failed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, TOGETHER):
                some = b.column(0).slice(i, TOGETHER)
                try:
                    said = provider(some.to_pylist())
                    said = said if len(said) == len(some) else [None] * len(some)
                except Exception:  # a model that is down fails its texts, not the job
                    said = [None] * len(some)
                yield pa.RecordBatch.from_arrays([some, pa.array(said, pa.string())], ["text", "said"])

    ship(texts.sparkSession)
    return texts.select("text").mapInArrow(run, "text string, said string")


def translated(rows: DataFrame, text_col: str, providers: list[Provider], out_col: str = "translated") -> DataFrame:
    """``rows`` with ``out_col`` and ``provider``: each distinct text asked once of the first provider, those that fail of the next, and so on.

    What all fail stays as it was, of the provider ``original``. Null and blank texts are not
    asked and stay, of no provider. What providers said is written before it is used, so nothing is asked twice.
    """
    open_ = rows.where(F.trim(F.col(text_col)) != "").select(F.col(text_col).alias("text")).distinct()
    done = rows.sparkSession.createDataFrame([], "text string, said string, provider string")
    for name, provider in providers:
        answers = materialize(ask(open_, provider).withColumn("provider", F.lit(name)), f"said-{name}")
        done = done.unionByName(answers.where("said IS NOT NULL"))
        open_ = answers.where("said IS NULL").select("text")
    done = done.unionByName(open_.select("text", F.col("text").alias("said"), F.lit("original").alias("provider")))
    found = rows.join(done.withColumnRenamed("text", text_col), text_col, "left")
    return found.select(*rows.columns, F.coalesce("said", F.col(text_col)).alias(out_col), "provider")


def completed(rows: DataFrame, answer_col: str, provider: Callable[[list[str]], list[str | None]], fallback: str = " ¿Necesitas más detalles?") -> DataFrame:
    """``rows`` with answers that break off continued by a model, asked once for each of them; ``fallback`` ends those it can't, unless they end in a question.

    A list, of two lines or more that name something, goes on in a new line; a word is followed by a blank.
    """
    a = F.col(answer_col)
    named = F.filter(F.split(F.regexp_replace(a, "\r\n?", "\n"), "\n"), lambda x: F.trim(x).rlike(r"(?U)^[-*•]?\s*\w[^:]{1,40}:"))
    broken = rows.where(F.coalesce(rules.is_incomplete(a), F.lit(False))).select(a.alias("text")).distinct()
    said = materialize(ask(broken, provider), "completions").select(F.col("text").alias(answer_col), clean_answer(F.col("said")).alias("_more"), F.lit(True).alias("_broken"))
    gap = F.when(F.size(named) >= 2, "\n").when(F.substring(a, -1, 1).rlike(r"^\p{L}$"), " ").otherwise("")
    ended = F.when(F.endswith(F.rtrim(a), F.lit("?")), a).otherwise(F.concat(a, F.lit(fallback)))
    whole = F.when(F.col("_broken").isNull(), a).when(F.length(F.coalesce("_more", F.lit(""))) > 0, F.concat(a, gap, F.col("_more"))).otherwise(ended)
    return rows.join(said, answer_col, "left").withColumn("_whole", whole).select(*[F.col("_whole").alias(c) if c == answer_col else c for c in rows.columns])


def cache_key(question: Column, lang: Column) -> Column:
    """One for all ways to write a question that normalising makes the same."""
    return F.substring(F.sha2(F.concat_ws("|", norm_question(question), F.lower(F.trim(lang))), 256), 1, 32)


NO_ANSWER = "no answer"


def answer_questions(asked: DataFrame, docs: DataFrame, cache: DataFrame, provider: Callable[[list[str]], list[str | None]], best: int = 3, most: int = 2800) -> tuple[DataFrame, DataFrame]:
    """``id, kind, answer`` for each question (``id, question, lang``), and the new entries of the cache (``key, answer``).

    Step by step, answered questions leave: refused ones (instructions to the model, other
    domains), greetings, those in the cache (``key, answer``), those without a document (``id`` and
    ``text`` of docs) that shares a word. The model gets the others, each distinct prompt once: its
    context from the best documents and the question. Guards then take back answers that are empty, made up, not
    from the context or broken off; the rest goes to the cache.
    """
    q = F.col("question")
    kind = F.when(rules.is_injection(q), "refused").when(rules.is_greeting(q), "greeting").when(rules.is_out_of_domain(q), "out_of_domain")
    rows = materialize(asked.select("id", "question", "lang", kind.alias("kind"), cache_key(q, F.coalesce("lang", F.lit(""))).alias("key")), "asked")
    ruled = rows.where("kind IS NOT NULL").select("id", "kind", F.col("kind").alias("answer"))
    known = cache.groupBy("key").agg(F.max("answer").alias("answer"))
    open_ = rows.where("kind IS NULL").drop("kind")
    hit = open_.join(known, "key").select("id", F.lit("cached").alias("kind"), "answer")
    missed = open_.join(known, "key", "left_anti")
    queries = missed.groupBy("key").agg(F.min("question").alias("query")).withColumnRenamed("key", "query_id")
    top = best_matches(docs.select("doc_id", "text"), queries, best)
    blocks = top.join(docs.select("doc_id", "source", F.substring("text", 1, most + 1).alias("text")), "doc_id")  # no context holds more of a text
    context = build_context(blocks, "query_id", "rank", "source", "text", most).withColumnRenamed("query_id", "key")
    text = F.concat("context", F.lit("\n\n"), "query")
    prompts = materialize(queries.withColumnRenamed("query_id", "key").join(context, "key", "left").withColumn("digest", F.sha2(text, 256)), "prompts")
    said = ask(prompts.where("digest IS NOT NULL").select(text.alias("text")).distinct(), provider)
    said = materialize(said.select(F.sha2("text", 256).alias("digest"), "said"), "answers")
    made = prompts.join(said, "digest", "left").withColumn("answer", clean_answer(F.col("said")))
    a, c = F.col("answer"), F.col("context")
    guard = (
        F.when(c.isNull(), "no_context")
        .when(F.coalesce(F.length(F.trim(a)), F.lit(0)) == 0, "failed")
        .when(rules.is_hallucination(a), "made_up")
        .when(rules.has_invented_data(a, c), "invented")
        .when(rules.is_incomplete(a), "broken_off")
        .otherwise("answered")
    )
    made = materialize(made.select("key", guard.alias("kind"), "answer"), "guarded")
    new = missed.select("id", "key").join(made, "key").select("id", "kind", F.when(F.col("kind") == "answered", F.col("answer")).otherwise(NO_ANSWER).alias("answer"))
    return ruled.unionByName(hit).unionByName(new), made.where("kind = 'answered'").select("key", "answer")
