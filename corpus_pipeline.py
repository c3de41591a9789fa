"""A training-corpus pipeline over `documents`: five stages, each written as Parquet and read again by the next.

Language ID drops texts without any letter; exact dedup keeps the smallest doc_id of equal texts; near-dedup keeps one
document of each class; decontamination drops documents that hold benchmark passages; the last stage encodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelspark.llm import decontaminate, exact_dedup, language_id, near_dedup, sentencepiece_fst
from duelspark.llm.common import free_name, saved, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those predicted `und` go."""
    model = language_id.train(docs.where(~language_id.held_out()))
    names = tuple(free_name(docs, name) for name in language_id.RESULT)
    return language_id.predict(docs, model, names=names).where(F.col(names[0]) != "und").select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_tokens, round_trip): round_trip tells whether the ids decode to the text."""
    ids = sentencepiece_fst.encode_checked(docs.select("doc_id", "lang", "source", "text"))
    return ids.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("language ID", identified),
    ("exact dedup", distinct),
    ("MinHash near-dedup", dissimilar),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding", encoded),
]

#: Language ID, near-dedup classes and encoding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
