"""Agreement between two raters.

Both score tables are joined on the item id once, unpivoted to
(dimension, judge, human) and counted per cell of scores. Agreement, correlation,
bias and Cohen's kappa of every dimension are sums over those few counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import r6


def align(judge: DataFrame, human: DataFrame, id_col: str, dims: list[str],
          judge_prefix: str = "judge_", human_prefix: str = "human_") -> DataFrame:
    """Matched items in long form (id, dimension, judge, human)."""
    j = judge.select(id_col, *[F.col(f"{judge_prefix}{d}").alias(f"__j_{d}") for d in dims])
    h = human.select(id_col, *[F.col(f"{human_prefix}{d}").alias(f"__h_{d}") for d in dims])
    both = j.join(h, id_col)
    return both.select(id_col, F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(f"__j_{d}").alias("judge"), F.col(f"__h_{d}").alias("human"))
        for d in dims])).alias("s")).select(id_col, "s.*")


def unmatched_count(judge: DataFrame, human: DataFrame, id_col: str):
    """Items scored by only one rater (the reference asserts equal lengths instead)."""
    j = judge.select(F.col(id_col).alias("__jid"))
    h = human.select(F.col(id_col).alias("__hid"))
    return (j.join(h, F.col("__jid") == F.col("__hid"), "full_outer")
            .where(F.col("__jid").isNull() | F.col("__hid").isNull())
            .select(F.count(F.lit(1))).scalar())


def agreement(longf: DataFrame, n_unmatched=None) -> DataFrame:
    """One row per dimension, from one count per (dimension, judge, human) cell.

    Scores are few whole numbers, so the cells are few and every figure is a sum over
    them; sums of whole numbers are exact, so a constant rater has variance zero exactly
    and its correlation is null. Kappa is null when expected agreement is 1."""
    cells = (longf.where(F.col("judge").isNotNull() & F.col("human").isNotNull())
             .groupBy("dimension", "judge", "human").agg(F.count(F.lit(1)).alias("c")))
    j, h, c = F.col("judge").cast("double"), F.col("human").cast("double"), F.col("c")
    total = lambda x, name: F.sum(c * x).alias(name)
    sums = cells.groupBy("dimension").agg(
        F.sum("c").alias("n"), total((j == h).cast("int"), "same"), total((F.abs(j - h) <= 1).cast("int"), "near"),
        total(j, "sj"), total(h, "sh"), total(j * j, "sjj"), total(h * h, "shh"), total(j * h, "sjh"))
    marks = cells.select("dimension", "c", F.explode(F.array(
        F.struct(F.col("judge").alias("label"), F.lit(1).alias("by_judge")),
        F.struct(F.col("human").alias("label"), F.lit(0).alias("by_judge")))).alias("m"))
    expected = (marks.groupBy("dimension", "m.label").agg(
        (F.sum(c * F.col("m.by_judge")) * F.sum(c * (1 - F.col("m.by_judge")))).alias("p"))
        .groupBy("dimension").agg(F.sum("p").alias("pe")))
    n = F.col("n")
    vj, vh = n * F.col("sjj") - F.col("sj") ** 2, n * F.col("shh") - F.col("sh") ** 2
    pe = F.col("pe") / (n * n)
    out = sums.join(expected, "dimension").select(
        "dimension", "n", r6(F.col("same") / n).alias("exact_agreement"), r6(F.col("near") / n).alias("within_1_agreement"),
        r6(F.when((vj > 0) & (vh > 0), (n * F.col("sjh") - F.col("sj") * F.col("sh")) / F.sqrt(vj * vh))).alias("correlation"),
        r6((F.col("sj") - F.col("sh")) / n).alias("bias"),
        r6(F.when(pe < 1.0, (F.col("same") / n - pe) / (1 - pe))).alias("cohen_kappa"))
    if n_unmatched is not None:
        out = out.withColumn("n_unmatched", n_unmatched)
    return out
