"""Evaluation metrics (A1-A23) as aggregations.

All of these reduce with partial (map-side) aggregation; the only shuffles move
one row per group per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.difficulty import any_substring, caps_ratio, matched_groups, word_count
from ..functions.lexicon import Lexicon
from .percentiles import exact_percentiles
from .util import r6

ALL = "all"


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A2: rows per value, largest first (the order is a display order only)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)


def class_balance(df: DataFrame, label_cols: list[str]) -> DataFrame:
    """A3: count and share of every value of each label column, long form.

    The label columns are unpivoted first, so one aggregation serves all of them;
    the share divides by the total row count from a scalar subquery.
    """
    total = df.select(F.count(F.lit(1))).scalar()
    longf = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("label_name"), F.col(c).cast("string").alias("label_value"))
        for c in label_cols])).alias("s")).select("s.*")
    return (longf.groupBy("label_name", "label_value").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("share", r6(F.col("n") / total)))


def majority_label(df: DataFrame, label_col: str) -> DataFrame:
    """The most frequent non-null label; ties go to the smallest label
    (row order is undefined in Spark, so 'first seen' becomes 'smallest')."""
    counts = df.where(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(label_col)).limit(1).select(
        F.col(label_col).alias("majority_label"), "n")


def majority_predictions(df: DataFrame, label_col: str) -> DataFrame:
    """Predict the training majority for every row with confidence 1.0.

    The label is a scalar subquery (computed once, then a constant), not a join.
    """
    maj = majority_label(df, label_col).select("majority_label").scalar()
    return df.withColumn("pred", maj).withColumn("confidence", F.lit(1.0)).withColumn(
        "method", F.lit("trivial_majority"))


def accuracy(df: DataFrame, pred_col: str, true_col: str) -> DataFrame:
    """A5: share of rows (with a known truth) where prediction equals truth.
    A null prediction counts as wrong."""
    known = df.where(F.col(true_col).isNotNull())
    hit = F.when(F.col(pred_col) == F.col(true_col), 1).otherwise(0)
    return known.agg(F.count(F.lit(1)).alias("n"), F.sum(hit).cast("long").alias("n_correct"),
                     r6(F.avg(hit)).alias("accuracy"))


def accuracy_failures_wrong(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Correct / all rows of the golden set, for several (pred, true) pairs.
    Failed rows (null prediction) stay in the denominator."""
    n = F.count(F.lit(1))
    aggs = [n.alias("n_golden")]
    for name, (p, t) in pairs.items():
        aggs.append(r6(F.sum(F.when(F.col(p) == F.col(t), 1).otherwise(0)) / n).alias(name))
    return df.agg(*aggs)


def accuracy_by_stratum(df: DataFrame, pred_col: str, true_col: str, stratum_col: str) -> DataFrame:
    """N and accuracy per stratum plus an overall row ('all'), via rollup."""
    hit = F.when(F.col(pred_col) == F.col(true_col), 1).otherwise(0)
    out = df.where(F.col(true_col).isNotNull()).rollup(stratum_col).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(hit)).alias("accuracy"), F.grouping(stratum_col).alias("g"))
    return out.select(F.when(F.col("g") == 1, F.lit(ALL)).otherwise(F.col(stratum_col)).alias(stratum_col),
                      "n", "accuracy")


def baseline_lift(metrics: DataFrame, agent="agent", trivial="trivial_baseline",
                  simple="simple_baseline") -> DataFrame:
    """Lift of the agent metric over two baselines (a projection of one row)."""
    return metrics.select(
        r6(agent).alias("agent"), r6(trivial).alias("trivial_baseline"), r6(simple).alias("simple_baseline"),
        r6(F.col(agent) - F.col(trivial)).alias("lift_over_trivial"),
        r6(F.col(agent) - F.col(simple)).alias("lift_over_simple"))


def confusion_long(df: DataFrame, true_col: str, pred_col: str, missing: str = "<none>") -> DataFrame:
    """A10: truth x prediction counts, long form. A null prediction is its own column."""
    return (df.where(F.col(true_col).isNotNull())
            .groupBy(F.col(true_col).cast("string").alias("true_label"),
                     F.coalesce(F.col(pred_col).cast("string"), F.lit(missing)).alias("pred_label"))
            .agg(F.count(F.lit(1)).alias("n")))


def confusion_pivot(df: DataFrame, true_col: str, pred_col: str, labels: list[str],
                    missing: str = "<none>") -> DataFrame:
    """A10 as a matrix; the label list is given so the pivot needs no extra pass."""
    return (df.where(F.col(true_col).isNotNull())
            .withColumn("__p", F.coalesce(F.col(pred_col).cast("string"), F.lit(missing)))
            .groupBy(F.col(true_col).cast("string").alias("true_label"))
            .pivot("__p", [*labels, missing]).agg(F.count(F.lit(1)))
            .na.fill(0))


def top_confusions(df: DataFrame, true_col: str, pred_col: str, k: int = 5) -> DataFrame:
    """The k most common (truth, wrong prediction) pairs; the limit is the report.

    The condition holds the count, so it stays above the aggregate: pushed below, it would
    compute a costly prediction again."""
    wrong = confusion_long(df, true_col, pred_col).where(
        F.when(F.col("true_label") != F.col("pred_label"), F.col("n")) > 0)
    return wrong.orderBy(F.desc("n"), "true_label", "pred_label").limit(k)


def subset_vs_all_mean(df: DataFrame, value_col: str, subset) -> DataFrame:
    """Mean of a score on an error subset beside the overall mean."""
    return df.agg(
        F.count(F.lit(1)).alias("n_all"), F.count(F.when(subset, 1)).alias("n_subset"),
        r6(F.avg(value_col)).alias("mean_all"),
        r6(F.avg(F.when(subset, F.col(value_col)))).alias("mean_subset"))


def constant_policy_baseline(df: DataFrame, true_col: str) -> DataFrame:
    """Accuracy of always predicting True (rows with known truth)."""
    known = df.where(F.col(true_col).isNotNull())
    return known.agg(F.count(F.lit(1)).alias("n"),
                     F.sum(F.col(true_col).cast("int")).cast("long").alias("n_positive"),
                     r6(F.avg(F.col(true_col).cast("double"))).alias("always_positive_accuracy"))


def completion_counts(df: DataFrame, a_col: str, b_col: str) -> DataFrame:
    """A19 + P9: non-null per stage, rows done in both, and rows still incomplete."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(a_col).alias("n_a_done"), F.count(b_col).alias("n_b_done"),
        F.count(F.when(F.col(a_col).isNotNull() & F.col(b_col).isNotNull(), 1)).alias("n_fully_done"),
    ).withColumn("n_incomplete", F.col("n_rows") - F.least("n_a_done", "n_b_done"))


def deflection_by_author(msgs: DataFrame, words: list[str]) -> DataFrame:
    """Volume per author and the share of messages hitting a deflection word."""
    hit = any_substring(F.col("text"), words).cast("int")
    return msgs.groupBy("author_id").agg(F.count(F.lit(1)).alias("n_messages"),
                                          r6(F.avg(hit)).alias("deflection_rate"))


def keyword_group_frequency(df: DataFrame, lex: Lexicon, text_col: str = "text") -> DataFrame:
    """Messages per matched keyword group, and the share with no hit ('<none>').

    One pass: the matched-group array is exploded (outer, so no-hit rows keep one
    null row) and counted; each message contributes at most once per group.
    """
    total = df.select(F.count(F.lit(1))).scalar()
    g = df.select(F.explode_outer(matched_groups(F.col(text_col), lex)).alias("g"))
    return (g.groupBy(F.coalesce("g", F.lit("<none>")).alias("keyword_group"))
            .agg(F.count(F.lit(1)).alias("n_messages"))
            .withColumn("share", r6(F.col("n_messages") / total)))


def threshold_percentiles(df: DataFrame, text_col: str = "text",
                          qs=(0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Exact linear-interpolation percentiles of word count and caps ratio, in bounded memory."""
    t = F.col(text_col)
    p = exact_percentiles(df.select(word_count(t).alias("n_words"), caps_ratio(t).alias("caps_ratio")),
                          ["n_words", "caps_ratio"], qs)
    return p.groupBy("metric").agg(*[r6(F.max(F.when(F.col("q") == q, F.col("value")))).alias(f"p{int(round(q * 100)):02d}")
                                     for q in qs])
