"""From raw documents to token ids, in stages that each hand on a table.

All stages but the last return the columns of `documents`, whatever further
columns there are. Every stage decides on its own input, whole: the classifier
rejects documents, one document of each near-duplicate group stays, contaminated
documents go, secrets are masked, and the remaining texts become token ids.

In every stage each row is decided by itself, also where doc_ids repeat or are
null, and an empty table gives an empty one. What a stage does with null and
empty texts, ties and repeated rows is said at the stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import bpe, common, decontaminate, near_dup, quality_model, secret_scan

def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on the labelled ones, does not reject.

    Null and empty texts are scored by their statistics, all of which are 0. A
    score of just 0.5 keeps a document, so without labels all stay. Repeated rows
    stay or go together.
    """
    model = quality_model.fit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return quality_model.keep(docs, model)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at five words and a similarity of 0.8.

    That of the smallest doc_id stays, of equal ones the first row, and one of null
    doc_id only where no other is in the group. Repeated rows are copies, of which
    one stays. Null texts and texts without words are in no group, so all stay.
    """
    # Written with row numbers of their own, so that they stay: doc_ids may repeat or be null.
    row = common.free_name(docs.columns, "__row_number")
    rows = common.stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_dup.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), width=5, percent=80)
    groups = found.select(F.col("doc_id").alias(row), "component_id").join(rows.select(row, "doc_id"), row)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", row))
    kept = groups.groupBy("component_id").agg(first.alias("first")).select(F.col(f"first.{row}").alias(row))
    return rows.join(kept, row, "left_semi").select(*common.quoted(docs))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark's items.

    Null and empty texts have no window and stay; repeated rows stay or go
    together. Null items and items without words mark nothing.
    """
    return decontaminate.keep(docs, common.table(spark, sf_dir, "benchmark"), window=10)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked and n_chars to match.

    Null and empty texts stay as they are (n_chars of a null text is null). Where
    secrets overlap, the one that begins first names the mask.
    """
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256), one row per row: byte-level BPE ids and the check of their round trip.

    Null and empty texts have no ids; repeated rows have the same ones.
    """
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.encode(docs, path, decoded=True)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", deduplicate),
    ("benchmark decontamination", decontaminate_benchmark),
    ("secret scan", mask_secrets),
    ("byte-level BPE", tokenize),
]

#: The classifier is learned and the ids need a vocabulary, so SQL cannot say it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, function in STAGES:
        path = common.new_path(spark, name.replace(" ", "-"))
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
