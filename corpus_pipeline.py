"""The corpus pipeline: documents to packed sequences, stage by stage, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import line_templates, order_minhash, pattern_packing, pii_surrogates, quality_rules
from packetloom.llm.common import materialize, read_table

# The key of the surrogates; a user's own is secret.
SECRET = "packetloom"


def _same_columns(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, the number of characters that of the text as it is now."""
    counted = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return changed.select(*[counted if c == "n_chars" else F.col(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the adaptive cutoffs keep."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring template lines go from every document but the first; no document goes."""
    return _same_columns(line_templates.drop_recurring_lines(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id."""
    return order_minhash.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become surrogates."""
    return _same_columns(pii_surrogates.replace_personal_data(docs, SECRET), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences of at most 2048 tokens."""
    return pattern_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES = [
    ("quality_rules", quality),
    ("line_templates", lines),
    ("order_minhash", near_duplicates),
    ("pii_surrogates", personal_data),
    ("pattern_packing", packed),
]

# Banded alignment, keyed surrogates and tokens have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents: the packed pieces of what is left."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
