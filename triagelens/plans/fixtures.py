"""Fixture frames over the driver's tables, shared by the registered queries.

Every frame here is derived by Spark from the given tables, so its work grows
with them. Model predictions and rater scores are rule-made from columns so
that the DuckDB oracle can repeat them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.difficulty import is_emotional, word_count
from ..functions.expr import let
from ..functions.lexicon import (
    CONVERSATIONS_LEXICON, DOCUMENTS_LEXICON, LANG_MARKERS, LANG_ORDER,
)
from ..sources.adapters import golden_from_documents, messages_from_conversations
from ..sources.readers import table

BRAND = "assistant"             # the 'brand' in the conversations adapter
SEED = 42
# Golden-set targets per bucket for the conversation pool (bounded sample).
CONV_TARGETS = {"typical": 40, "ambiguous": 15, "edge": 15, "adversarial": 10}
# Rater thresholds: score = 1 + number of thresholds reached.
RATER_RULES = {
    # dimension: ((judge feature, thresholds), (human feature, thresholds))
    "accuracy": (("n_chars", [600, 1300, 2600, 5200]), ("n_words", [100, 200, 400, 800])),
    "relevance": (("n_words", [80, 160, 320, 640]), ("n_words", [100, 200, 400, 800])),
    "tone": (("n_lines", [2, 4, 8, 16]), ("n_words", [100, 200, 400, 800])),
    "escalation_judgment": (("n_chars", [500, 1000, 2000, 4000]), ("n_lines", [2, 4, 8, 16])),
    "overall": (("n_chars", [700, 1500, 3000, 6000]), ("n_chars", [600, 1300, 2600, 5200])),
}
DIMENSIONS = list(RATER_RULES)


def table_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(spark, sf, name)


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return messages_from_conversations(table(spark, sf, "conversations"))


def golden(spark: SparkSession, sf: str) -> DataFrame:
    return golden_from_documents(docs(spark, sf), labels(spark, sf), DOCUMENTS_LEXICON)


def marker_count(lo: Column, marker: str) -> Column:
    return ((F.length(lo) - F.length(F.replace(lo, F.lit(marker), F.lit("")))) / len(marker)).cast("long")


def lang_prediction(text: Column, markers_per_lang: int | None = None) -> Column:
    """Rule-made intent prediction: language with most marker hits; null if none."""

    def likeliest(lo: Column) -> Column:
        scores = [reduce(lambda a, b: a + b, [marker_count(lo, m) for m in LANG_MARKERS[lang][:markers_per_lang]])
                  for lang in LANG_ORDER]
        # equal scores go to the language that comes first
        ranked = F.array(*[F.struct(s.alias("hits"), F.lit(-i).alias("place"), F.lit(lang).alias("lang"))
                           for i, (s, lang) in enumerate(zip(scores, LANG_ORDER))])
        return let(F.array_max(ranked), lambda best: F.when(best["hits"] > 0, best["lang"]))

    # the text is lowered once and every marker counted once
    return let(F.lower(text), likeliest)


def golden_with_predictions(spark: SparkSession, sf: str) -> DataFrame:
    g = golden(spark, sf)
    return g.select("*",
                    lang_prediction(F.col("text")).alias("pred_intent"),
                    lang_prediction(F.col("text"), 1).alias("simple_pred_intent"),
                    is_emotional(F.col("text"), DOCUMENTS_LEXICON).alias("pred_escalate"))


def _rated(x: Column, thresholds: list[int]) -> Column:
    return (F.lit(1) + reduce(lambda a, b: a + b, [(x >= t).cast("int") for t in thresholds])).cast("int")


def _features(df: DataFrame) -> DataFrame:
    t = F.col("text")
    return df.select("doc_id", F.col("n_chars"), word_count(t).alias("n_words"),
                     (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).alias("n_lines"))


def judge_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A judge's 1-5 scores for every document."""
    f = _features(docs(spark, sf))
    return f.select(F.col("doc_id").alias("message_id"),
                    *[_rated(F.col(j[0]), j[1]).alias(f"judge_{d}") for d, (j, _) in RATER_RULES.items()])


def human_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A human's 1-5 scores for the labelled subsample only."""
    f = _features(docs(spark, sf).join(labels(spark, sf).select("doc_id"), "doc_id", "left_semi"))
    return f.select(F.col("doc_id").alias("message_id"),
                    *[_rated(F.col(h[0]), h[1]).alias(f"human_{d}") for d, (_, h) in RATER_RULES.items()])


__all__ = ["BRAND", "SEED", "CONV_TARGETS", "DIMENSIONS", "CONVERSATIONS_LEXICON", "DOCUMENTS_LEXICON",
           "docs", "labels", "messages", "golden", "golden_with_predictions", "judge_scores",
           "human_scores", "lang_prediction"]


def model_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Synthetic raw model responses, one per document, in sixteen shapes chosen by
    md5 of the id: clean, fenced, trailing and leading text, nested braces, raw
    newline in a string, repeated key, missing key, single quotes, array, no JSON,
    unbalanced, blank, brace inside a string, a prefix the fence strip eats, null."""
    d = docs(spark, sf)
    lang, src = F.col("lang"), F.col("source")
    clean = F.concat(F.lit('{"intent": "'), lang, F.lit('", "confidence": 0.8, "reasoning": "from '), src,
                     F.lit('"}'))
    shapes = [
        clean,
        F.concat(F.lit("```json\n"), clean, F.lit("\n```")),
        F.concat(clean, F.lit(" Hope this helps.")),
        F.concat(F.lit("Sure! "), clean),
        F.concat(F.lit('{"intent": "'), lang, F.lit('", "meta": {"k": 1}, "confidence": 0.7} }')),
        F.concat(F.lit('{"intent": "'), lang, F.lit('", "reasoning": "line one\nline two"}')),
        F.concat(F.lit('{"intent": "xx", "intent": "'), lang, F.lit('"}')),
        F.lit('{"confidence": 0.4}'),
        F.concat(F.lit("{'intent': '"), lang, F.lit("'}")),
        F.concat(F.lit('["'), lang, F.lit('"]')),
        F.lit("I am not sure."),
        F.concat(F.lit('{"intent": "'), lang, F.lit('", "confidence": 0.6')),
        F.lit("   "),
        F.concat(F.lit('{"intent": "'), lang, F.lit('", "reasoning": "a } b"}')),
        F.concat(F.lit('nosj {"intent": "'), lang, F.lit('"}')),
        F.lit(None).cast("string"),
    ]
    shape = (F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 2), 16, 10).cast("int") % 16)
    raw = F.element_at(F.array(*shapes), shape + 1)
    return d.select("doc_id", shape.alias("shape"), raw.alias("raw"))


def judge_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Synthetic judge responses from the rule-made judge scores, with misspelled,
    missing, extra and string-valued keys in eight shapes."""
    j = judge_scores(spark, sf)
    a, r, t, e, o = (F.col(f"judge_{d}").cast("string") for d in DIMENSIONS)
    shapes = [
        F.concat(F.lit('{"accuracy": '), a, F.lit(', "relevance": '), r, F.lit(', "tone": '), t,
                 F.lit(', "escalation_judgment": '), e, F.lit(', "overall": '), o, F.lit(', "notes": "fine"}')),
        F.concat(F.lit('{"accuracy": '), a, F.lit(', "relevance": '), r, F.lit(', "tone": '), t,
                 F.lit(', "escalation_justment": '), e, F.lit(', "overall": '), o, F.lit(', "notes": "typo"}')),
        F.concat(F.lit('{"accuracy": '), a, F.lit(', "relevance": '), r, F.lit(', "tone": '), t,
                 F.lit(', "escalation_judgment": '), e, F.lit(', "overal": '), o, F.lit(', "note": "short keys"}')),
        F.concat(F.lit('{"accuracy": '), a, F.lit(', "relevance": '), r,
                 F.lit(', "escalation_judgment": '), e, F.lit(', "overall": '), o, F.lit("}")),
        F.concat(F.lit('```json\n{"accuracy": '), a, F.lit(', "relevance": '), r, F.lit(', "tone": '), t,
                 F.lit(', "escalation_judgment": '), e, F.lit(', "overall": '), o, F.lit(', "notes": "fenced"}\n```')),
        F.concat(F.lit('{"acuracy": '), a, F.lit(', "relevance": '), r, F.lit(', "tone": '), t,
                 F.lit(', "escalation_judgment": '), e, F.lit(', "overall": '), o, F.lit(', "notes": "x"}')),
        F.concat(F.lit('{"accuracy": "'), a, F.lit('", "relevance": "'), r, F.lit('", "tone": "'), t,
                 F.lit('", "escalation_judgment": "'), e, F.lit('", "overall": "'), o, F.lit('", "notes": "strings"}')),
        F.lit("no scores today"),
    ]
    shape = (F.conv(F.substring(F.md5(F.col("message_id").cast("string")), 1, 2), 16, 10).cast("int") % 8)
    return j.select("message_id", shape.alias("shape"), F.element_at(F.array(*shapes), shape + 1).alias("raw"))
