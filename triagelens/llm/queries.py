"""Registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (backoff_lm, chat_masks, harmonic_packing, maxplus_sentencepiece, ordinal_quality, reversed_search,
               rule_ledger, secret_entropy, simhash_mih, spelling_pivots, url_templates, vafile_search, warc_archive)
from .common import prepare, read


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile_search.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_templates.judge(pages).select("page_id", "host", "path", "rule", "verdict", "template")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = rule_ledger.judge(rule_ledger.ledger(read(spark, sf_dir, "documents").select("doc_id", "text")),
                             rule_ledger.POLICIES["v1"])
    base = F.col("failed_bits").bitwiseAND(F.lit(rule_ledger.POLICIES["base"].mask()).cast("long")) != 0
    return book.select("doc_id", *[F.col(f"measures.{m}").alias(m) for m in
                                   ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                       base.alias("base_failed"), "kept", "failed_bits")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = harmonic_packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "sequence_tokens")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_entropy.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(secret_entropy.KINDS)],
                        F.sha2(secret_entropy.written(F.col("base")), 256).alias("base_sha256"),
                        secret_entropy.written(F.col("spans")).alias("spans"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)],
                                  "conv_id long, turn long, role string, text string")
    chats = chat_masks.format_chats(chats.unionByName(extra), public_tokenizers.path("byte_bpe_50k.json"))

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string")
    def digests(formatted: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, runs in zip(formatted, spans):
            turns = chat_masks.read_back(text)
            loss = "".join(chat_masks.unescape(text[r["s"]:r["e"]]) for r in runs)
            said = "".join(f"{role}\n{body}\n" for role, body in turns)
            out.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                        hashlib.sha256(loss.encode()).hexdigest()))
        return pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256"])

    rows = chats.select("conv_id", digests("formatted", "loss_spans").alias("d"),
                        F.char_length("formatted").cast("long").alias("formatted_chars"))
    return rows.select("conv_id", "d.*", "formatted_chars")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chunk: its ids' number and digest, its weight, and the decoded characters' number and digest."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = maxplus_sentencepiece.encode(read(spark, sf_dir, "documents"), model)
    text = maxplus_sentencepiece.decode(coded, model)
    return text.select("doc_id", "chunk", (F.length("ids") / 4).cast("long").alias("n_ids"),
                       F.crc32("ids").alias("ids_crc32"), "weight", F.char_length("text").cast("long").alias("n_chars"),
                       F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    rows = backoff_lm.score(read(spark, sf_dir, "documents"), held)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = ordinal_quality.fit(docs, ordinal_quality.graded(read(spark, sf_dir, "labels")))
    return ordinal_quality.score(docs.select("doc_id", "text"), model).drop("text")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_mih.link(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash_mih.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reversed_search.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling_pivots.vocabulary(read(spark, sf_dir, "documents"), min_chars=6, min_count=5, noise=199)
    return spelling_pivots.group(words, ratio=5)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc_archive.write(read(spark, sf_dir, "pages"), path, min_bytes=1000)
    records = warc_archive.read_back(spark, path)
    return records.select(F.col("id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
                          F.sha1("payload").alias("payload_digest"), "record_type", "refers_to",
                          F.octet_length("record").cast("long").alias("record_bytes"))


OPERATORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_topk, op2_url_filter, op3_quality_rules, op4_packing, op5_secret_scan,
                               op6_chat_formatting, op7_sentencepiece, op8_lm_score, op9_quality_classifier, op10_simhash,
                               op11_ranked_search, op12_spelling_variants, op13_warc)
}


def prepared(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)
    run.__name__ = fn.__name__
    return run


QUERIES = {name: prepared(fn) for name, fn in OPERATORS.items()}
