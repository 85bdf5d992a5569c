"""Explicit schemas. Nothing is ever read with schema inference."""

from pyspark.sql.types import (
    BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)


def _s(*fields):
    return StructType([StructField(n, t, True) for n, t in fields])


# Driver tables (parquet).
DOCUMENTS = _s(("doc_id", LongType()), ("text", StringType()), ("lang", StringType()),
               ("source", StringType()), ("n_chars", LongType()))
LABELS = _s(("doc_id", LongType()), ("quality", IntegerType()), ("toxic", IntegerType()))
CONVERSATIONS = _s(("conv_id", LongType()), ("turn", LongType()), ("role", StringType()),
                   ("text", StringType()))
BENCHMARK = _s(("item_id", LongType()), ("text", StringType()))

DRIVER_TABLES = {
    "documents": DOCUMENTS,
    "labels": LABELS,
    "conversations": CONVERSATIONS,
    "benchmark": BENCHMARK,
}

# Reference-shaped tables (CSV in the reference).
MESSAGES = _s(("tweet_id", LongType()), ("author_id", StringType()), ("inbound", BooleanType()),
              ("text", StringType()), ("in_response_to_tweet_id", LongType()))

GOLDEN = _s(("message_id", LongType()), ("text", StringType()),
            ("difficulty_bucket", StringType()), ("difficulty_score", IntegerType()),
            ("true_intent", StringType()), ("gold_reply_notes", StringType()),
            ("true_escalate", BooleanType()), ("true_escalate_reason", StringType()))

POOL = _s(("cust_tweet_id", StringType()), ("cust_text", StringType()),
          ("brand_reply", StringType()))

HUMAN_SCORES = _s(("message_id", LongType()), ("text", StringType()),
                  ("agent_draft_reply", StringType()), ("agent_escalate", BooleanType()),
                  ("agent_escalation_reason", StringType()), ("human_accuracy", IntegerType()),
                  ("human_relevance", IntegerType()), ("human_tone", IntegerType()),
                  ("human_escalation_judgment", IntegerType()), ("human_overall", IntegerType()),
                  ("human_notes", StringType()))

SUMMARY = _s(("trivial_accuracy", DoubleType()), ("simple_cv_accuracy", DoubleType()),
             ("llm_classifier_accuracy", DoubleType()), ("escalation_accuracy", DoubleType()),
             ("n_golden_set", LongType()), ("n_agent_completed", LongType()),
             ("n_judged", LongType()))
