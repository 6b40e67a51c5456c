"""The corpus pipeline: quality rules, near-dedup, secret scan, mixing, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its
predecessor kept; ``run`` writes each stage's result as Parquet under the
shared checkpoint folder and reads it back, so a lost executor or a failed
stage never costs an earlier one.

Cases, for every stage: null and empty texts have no words (the quality rules
reject them; a later stage keeps them as they are), null ids and sources are
values of their own; rows that repeat are rejected or kept alike by the rules,
are one document of their class to the deduplication, and are mixed and packed
one by one; an empty table gives an empty result with the stage's columns;
extra columns, whatever their names, are carried to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tangoflow.llm import bagminhash, mixing, packing, rule_ledger, secrets
from tangoflow.llm.common import materialise, table

TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the full policy of the rule ledger rejects go."""
    return rule_ledger.keep_good(docs, rule_ledger.FULL_POLICY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return bagminhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; their secrets are replaced."""
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix_documents(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents of the mix."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("pack_tokens", pack_tokens),
]

#: Signatures, Newton iterations and a tokenizer are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
