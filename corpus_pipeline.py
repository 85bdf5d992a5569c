"""The training-data pipeline: five stages over ``documents``, each one operator.

Every stage is written as Parquet under the shared checkpoint folder and read again,
so a lost executor repeats at most its own tasks of one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelens.llm import harmonic_packing, ordinal_quality, rule_ledger, secret_entropy, simhash_mih
from triagelens.llm.common import parked, prepare, read

SHINGLE, MAX_BITS = 3, 2


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose top grade is likely enough; the model is fitted on the labelled ones."""
    prepare(spark)
    model = ordinal_quality.fit(docs, ordinal_quality.graded(read(spark, sf_dir, "labels")))
    return ordinal_quality.keep(docs, model)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the current policy."""
    prepare(spark)
    return rule_ledger.keep(docs, rule_ledger.POLICIES["v1"])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, the one with the smallest id."""
    prepare(spark)
    return simhash_mih.dedup(docs, shingle=SHINGLE, max_bits=MAX_BITS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; ``n_chars`` follows the new text."""
    prepare(spark)
    clean = secret_entropy.redact(docs)
    return clean.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c)
                          for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents, packed into sequences."""
    prepare(spark)
    pieces = harmonic_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "sequence_tokens")


STAGES = [("quality classifier", quality_classifier), ("quality rules", quality_rules),
          ("simhash near-dedup", simhash_dedup), ("secret scans", secret_scan), ("packing", packing)]

ORACLE_SQL = None  # the fit, the fingerprints and the packing have no SQL form; tests hold them to brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = parked(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
