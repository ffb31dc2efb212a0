"""Cleaning of a training corpus, as stages over the ``documents`` table.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of documents. Null cells, empty texts, empty tables and
repeated rows are treated as the stages' operators define; further columns are
carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, quality, secrets, sentencepiece_codec, simhash
from tessera.llm.common import stored, table


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not in ``ids``; null ids stay."""
    gone = ids.select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose every row the classifier rejects. Rows without a
    doc_id have no identity to be rejected by and stay."""
    seen = quality.classify(docs, table(spark, sf_dir, "labels"))
    return _without(docs, seen.groupBy("doc_id").agg(F.max("keep").alias("keep")).filter("NOT keep"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of linked ones, and
    equal rows of it once (rows that share its doc_id but not its text stay). Rows
    without a doc_id have no identity to be dropped by and stay."""
    groups = stored(simhash.near_duplicates(docs), "simhash-groups")
    first = _without(docs, groups.filter("doc_id <> component_id"))
    repeated = stored(groups.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 AND doc_id IS NOT NULL"), "repeated-ids")
    again = first.join(repeated, first["doc_id"] == repeated["doc_id"], "left_semi")
    return _without(first, repeated).unionByName(again.dropDuplicates(["doc_id", "text"]))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by a mark; all documents stay."""
    return secrets.redacted(docs)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded text."""
    return sentencepiece_codec.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_dedup", simhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: The model, the fingerprints' hash and the merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are stored before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
