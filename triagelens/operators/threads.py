"""Thread reconstruction and the retrieval pool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import checked_broadcast

# Agent signature at the start of a brand-written text, e.g. "^TJ" (mis-threaded rows).
SIGNATURE_PATTERN = r"\^[A-Z]{2}\b"


def brand_replies(msgs: DataFrame, brand: str) -> DataFrame:
    """P1 + P2: outbound brand messages that answer something. Null ``inbound`` drops."""
    return msgs.where((F.col("author_id") == brand) & (F.col("inbound") == F.lit(False))
                      & F.col("in_response_to_tweet_id").isNotNull())


def thread_pairs(msgs: DataFrame, brand: str, customers_only: bool = False) -> DataFrame:
    """(customer message, brand reply) pairs; one row per reply, so 1:N is kept.

    The customer side is every message by default (the reference's behaviour, which
    lets a brand message that was replied to count as a customer message);
    ``customers_only`` keeps inbound messages only. A sort-merge join on the id;
    AQE turns it into a broadcast join when the reply side is small at runtime.
    """
    replies = brand_replies(msgs, brand).select(
        F.col("tweet_id").alias("reply_tweet_id"),
        F.col("text").alias("brand_reply"),
        F.col("in_response_to_tweet_id").alias("cust_tweet_id"))
    cust = msgs.select(F.col("tweet_id").alias("cust_tweet_id"), F.col("text").alias("cust_text"),
                       F.col("inbound").alias("cust_inbound"))
    if customers_only:
        cust = cust.where(F.col("cust_inbound"))
    return replies.join(cust, "cust_tweet_id").select(
        "cust_tweet_id", "cust_text", "reply_tweet_id", "brand_reply", "cust_inbound")


def replied_messages(msgs: DataFrame, brand: str) -> DataFrame:
    """Messages a brand replied to (semi join, each message once)."""
    targets = brand_replies(msgs, brand).select(F.col("in_response_to_tweet_id").alias("tweet_id"))
    return msgs.join(targets, "tweet_id", "left_semi")


def mis_threaded(pairs: DataFrame) -> DataFrame:
    """Flag pairs whose customer side looks brand-written."""
    return pairs.withColumn(
        "mis_threaded",
        (~F.coalesce(F.col("cust_inbound"), F.lit(False))) | F.col("cust_text").rlike(SIGNATURE_PATTERN))


def exclude_ids(df: DataFrame, ids: DataFrame, df_col: str, id_col: str,
                max_broadcast_rows: int | None = None) -> DataFrame:
    """Leak guard, a left anti join (not NOT IN, which a null id would empty).

    The id side is broadcast only when ``max_broadcast_rows`` is a proven bound
    (e.g. the sum of sample targets) or its counted size is under the limit.
    """
    right = ids.select(F.col(id_col).alias("__ex")).where(F.col("__ex").isNotNull()).distinct()
    right = checked_broadcast(right, bound=max_broadcast_rows)
    return df.join(right, F.col(df_col) == F.col("__ex"), "left_anti")


def pool_step_counts(pairs: DataFrame, pool: DataFrame, excluded_ids: DataFrame) -> DataFrame:
    """A1: row counts at each pool-building step, one row."""
    return (pairs.agg(F.count(F.lit(1)).alias("raw_pairs"))
            .select("raw_pairs",
                    excluded_ids.select(F.count(F.lit(1))).scalar().alias("excluded_ids"),
                    pool.select(F.count(F.lit(1))).scalar().alias("pool_pairs")))
