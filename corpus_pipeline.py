"""From raw documents to packed sequences: quality, near-duplicates, benchmark passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import decontam, packing, pii, quality, simhash
from marlstone.llm.common import materialize
from marlstone.llm.queries import vocabulary
from marlstone.session import table

#: Words of a shingle in the near-dedup stage.
SHINGLE = 5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good, whole texts scored; null texts count as empty, copies are judged alike."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id.

    Shingles have SHINGLE words; fingerprints link within 4 of 64 bits. Of rows that repeat an id
    one stays; rows without an id all stay; null and empty texts are duplicates of each other.
    """
    return simhash.representatives(docs, k=SHINGLE)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item; null and empty texts overlap none."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind and n_chars made to fit; null texts stay null."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and offset; a null text is its end token alone."""
    return packing.pack(packing.tokenize(docs, vocabulary()))


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_passages),
    ("PII", redact_personal_data),
    ("best-fit packing", pack_sequences),
]

#: Trained models and fingerprints are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of ``documents``; empty tables give none, columns beyond those of documents are carried along."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
