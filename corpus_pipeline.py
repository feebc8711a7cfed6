"""A corpus pipeline of five stages: quality, near-duplicates, repeated passages, benchmark leaks, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chunk_dedup, decontaminate, ngram_join, quality_rules
from tessera.llm.common import materialize
from tessera.llm.queries import VOCABULARY, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, fitted on all labels, scores below 0.3.

    Null and empty texts are scored like any other; repeated rows and ties are judged alike; a null doc_id changes
    nothing; an empty table stays empty; other columns pass, whatever their names.
    """
    model = quality_rules.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, model, 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one with the smallest doc_id. Five words and a similarity of 0.8.

    Null, empty and blank texts are linked with nothing and stay. Rows that repeat doc_id and text stay once, several
    texts with one doc_id once each. Rows without a doc_id are in no group and stay, once for each text. An empty
    table stays empty; other columns pass, whatever their names.
    """
    groups = ngram_join.ngram_jaccard_join(docs, n=5, percent=80)
    later = materialize(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("later_id")).distinct())
    rows = _packed(docs).withColumn("digest", F.md5(F.col("row.text").cast("string")))
    named = rows.where("id is not null").join(later, F.col("id") == F.col("later_id"), "left_anti").dropDuplicates(["id", "digest"])
    nameless = rows.where("id is null").dropDuplicates(["digest"])
    return named.select("row.*").unionByName(nameless.select("row.*"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every later occurrence of a repeated passage from the texts.

    Null and empty texts and rows without a doc_id pass unchanged; see :func:`chunk_dedup.remove_repeats`.
    """
    return chunk_dedup.remove_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a copy of a benchmark item.

    Null and empty texts hold none; rows that repeat a doc_id go together; a row without a doc_id cannot be named as a
    leak and stays. An empty table stays empty; other columns pass, whatever their names.
    """
    leaks = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    leaks = materialize(leaks.select(F.col("doc_id").alias("leak_id")).distinct())
    return _packed(docs).join(leaks, F.col("id") == F.col("leak_id"), "left_anti").select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and what they decode to: doc_id, ids, decoded, a row for each row.

    A null text counts as empty; an empty text has no ids and decodes to an empty string; an empty table gives no rows.
    """
    return bpe.bpe_encode(docs, VOCABULARY)


def _packed(docs: DataFrame) -> DataFrame:
    """The doc_id as ``id`` and the whole row as ``row``, so that no column of ``docs`` clashes with those of a join."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("BPE encoding and decoding", encoding),
]

#: The classifier, the content-defined chunks and the tokenizer are beyond SQL; a test chains plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the table ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
