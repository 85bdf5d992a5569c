"""Adapters from the driver's tables to the reference's table shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.difficulty import score_frame
from ..functions.lexicon import DOCUMENTS_LEXICON, Lexicon
from ..operators.util import checked_broadcast


def messages_from_conversations(conv: DataFrame) -> DataFrame:
    """Raw-message shape: ``tweet_id, author_id, inbound, text, in_response_to_tweet_id``.

    A message's id is the string ``conv_id:turn``, so conversations of any length keep
    apart. author = role, inbound = (role = 'user'), link = the previous turn of the
    same conversation (null at turn 0). Pure projection: no shuffle.
    """
    def mid(turn):
        return F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))

    turn = F.col("turn")
    return conv.select(
        mid(turn).alias("tweet_id"),
        F.col("role").alias("author_id"),
        (F.col("role") == "user").alias("inbound"),
        F.col("text"),
        F.when(turn > 0, mid(turn - 1)).alias("in_response_to_tweet_id"),
    )


def golden_from_documents(docs: DataFrame, labels: DataFrame,
                          lex: Lexicon = DOCUMENTS_LEXICON) -> DataFrame:
    """Labelled-set shape from documents joined to labels.

    true_intent = lang, true_escalate = (toxic = 1). Only labelled documents appear. Labels
    that are few enough go to the texts, so that no text is shuffled.
    """
    joined = docs.select("doc_id", "text", "lang").join(checked_broadcast(labels.select("doc_id", "toxic")), "doc_id")
    scored = score_frame(joined, "text", lex)
    return scored.select(
        F.col("doc_id").alias("message_id"), "text", "difficulty_bucket", "difficulty_score",
        F.col("lang").alias("true_intent"),
        F.lit(None).cast("string").alias("gold_reply_notes"),
        (F.col("toxic") == 1).alias("true_escalate"),
        F.lit(None).cast("string").alias("true_escalate_reason"),
    )
