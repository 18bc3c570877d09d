"""The corpus pipeline over documents: language ID, near-duplicate join, decontamination, secret removal, packing.

Each stage takes (spark, docs, sf_dir) and, but for the last, returns the
columns of docs. run() hands each stage's result to the next as a written table
and then deletes what the stage wrote on its way.

For all stages: an empty table gives an empty result; further columns, whatever
their names, stay; very long texts are read whole, one at a time; repeated rows
are treated alike. What a stage does with nulls and ties stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.functions import tables
from tickloom.llm import decontaminate, jaccard_join, language_id, packing, secrets, session

#: SQL cannot express the models of these stages.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: null texts, rows without letters or without a main language go, and all rows if no row is labelled. Of languages with equal shares the first by name counts."""
    return language_id.keep_known(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the least doc_id. Rows without doc_id, and without words, stay; of rows that share the kept doc_id all stay."""
    return jaccard_join.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item; null and empty texts hold none. Test items without id, text or words are left out."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets cut out of their texts and n_chars counted again; null texts stay null."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, placed in sequences. A null or empty text is one piece, its end id; pieces of one length go by doc_id and start."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with tables.scope(spark) as kept:
            before, docs = docs, session.materialize(stage(spark, docs, sf_dir))
            kept.append(docs)
        tables.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
