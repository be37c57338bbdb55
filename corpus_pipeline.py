"""Training-data pipeline over documents: five stages, each written as Parquet and read again by the next.

All stages but the last return the columns of documents. Language identification drops what it rejects; of each group of
near-duplicates the first document by doc_id stays; passages that an earlier document has are cut out; secrets are
replaced by a mark; packing returns pieces of binary length.

Defined results: a null or empty text has no language, so its row goes in the first stage, unless no row has a label:
then nothing is learned to reject by, and all rows go on. Rows without doc_id stay in every stage that judges by it. Of
rows equal in doc_id and text one stays; rows that share a doc_id but not their text are judged by their texts, and tie by
the text's hash. Texts of any length are taken whole. Empty tables give no rows. Other columns may have any name; they go
through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm import langid, packing, secrets, simhash, substrings
from textloom.llm.common import remove_dir, scratch, shared_dir, written
from textloom.sources.tables import table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_digest(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language identification", language_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("secret scan", secrets_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the language models nor the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote for itself goes once its result is written, and that once the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        uri = shared_dir(spark, f"stage-{k}")
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), "", uri)
        if before:
            remove_dir(spark, before)
        before = uri
    return STAGES[-1][1](spark, docs, sf_dir)
