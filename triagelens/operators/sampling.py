"""Deterministic stratified sampling, batches and folds (M1-M6).

Order inside a stratum is md5('seed:id') then id, so picks are exact, repeatable
and independent of partitioning. A stratum may hold a third of all rows, so no
window ever runs over a whole stratum. A sample keeps the leaders of each part of a
stratum first and ranks only those together. A full ranking cuts each stratum into
16**digits sub-buckets by the hash prefix (contiguous ranges of the same order); a
tiny table of sub-bucket counts gives each sub-bucket its offset, and ranks are
computed inside sub-buckets only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import checked_broadcast, hex_prefix_int, seeded_hash

SALTS = 256       # parts of a stratum that a sample ranks apart before it ranks their leaders together
SALT_DIGITS = 4  # 65,536 sub-buckets per stratum: 1.5M rows each at 10^11 rows a stratum


def _keyed(df: DataFrame, id_col: str, seed, digits: int) -> DataFrame:
    return (df.withColumn("__h", seeded_hash(id_col, seed))
            .withColumn("__sub", hex_prefix_int(F.col("__h"), digits)))


def _join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys]
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def stratified_rank(df: DataFrame, strata: list[str], id_col: str, seed=42,
                    rank_col: str = "stratum_rank", digits: int = SALT_DIGITS) -> DataFrame:
    """1-based rank of each row inside its stratum in md5('seed:id'), id order.

    Equal to ``row_number() over (partition by strata order by md5, id)`` but the
    largest window partition is one sub-bucket, not a whole stratum. The input
    is scanned and shuffled once: the sub-bucket sizes are read off the ranked
    rows themselves (same exchange, reused), and only that small size table is
    ranked per stratum.
    """
    keyed = _keyed(df, id_col, seed, digits)
    local = Window.partitionBy(*strata, "__sub").orderBy("__h", id_col)
    ranked = keyed.withColumn("__rn", F.row_number().over(local))
    counts = ranked.groupBy(*strata, "__sub").agg(F.max("__rn").alias("__cnt"))
    before = Window.partitionBy(*strata).orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*strata, "__sub",
                            F.coalesce(F.sum("__cnt").over(before), F.lit(0)).cast("long").alias("__off"))
    out = _join_on(ranked, offsets, [*strata, "__sub"])
    return out.withColumn(rank_col, (F.col("__rn") + F.col("__off")).cast("long")).drop(
        "__h", "__sub", "__rn", "__off")


def stratified_sample(df: DataFrame, strata_col: str, targets: dict[str, int] | int, id_col: str,
                      seed=42, salts: int = SALTS) -> DataFrame:
    """M1: the first ``targets[s]`` rows of each stratum in seeded order (all if fewer).

    ``targets`` is a dict per stratum, or one int for every stratum present.
    One pass over the input. A first window keeps the leading rows of each (stratum,
    salt), the salt being cut from the seeded hash; Spark plans its bound as a group
    limit before the exchange, so a task sends at most ``max target`` rows of a pair
    however many rows a stratum has. A second window ranks the at most
    ``salts * max target`` rows left of each stratum. The stratum meets no join and no
    filter that infers not-null, so a costly stratum expression is never pushed down
    and computed again. A row with a null stratum has no target.
    """
    if isinstance(targets, dict):
        tmap = F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(int(v)))])
        # coalesce, because a null-intolerant comparison would infer "stratum is not null"
        target = F.coalesce(F.element_at(tmap, F.col(strata_col)), F.lit(0))
        most = max(int(v) for v in targets.values())
    else:
        target = F.when(F.col(strata_col).isNotNull(), F.lit(int(targets))).otherwise(F.lit(0))
        most = int(targets)
    keyed = (df.withColumn("__h", seeded_hash(id_col, seed))
             .withColumn("__salt", F.pmod(F.crc32("__h"), F.lit(salts))))
    for keys in ([strata_col, "__salt"], [strata_col]):
        order = Window.partitionBy(*keys).orderBy("__h", id_col)
        keyed = keyed.withColumn("sample_rank", F.row_number().over(order).cast("long")).where(F.col("sample_rank") <= most)
    return keyed.where(F.col("sample_rank") <= target).drop("__h", "__salt")


def sample_shortfall(df: DataFrame, strata_col: str, targets: dict[str, int]) -> DataFrame:
    """M1's warning as a table: target, available, taken and shortfall per stratum.

    The stratum meets no filter and a null-safe join only: from either, a costly stratum expression
    would be pushed down to the scan and computed again."""
    tmap = F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(int(v)))])
    avail = df.groupBy(strata_col).agg(F.count(F.lit(1)).alias("available"))
    keys = F.explode(F.map_keys(tmap)).alias(strata_col)
    all_strata = avail.sparkSession.range(1).select(keys)
    return (_join_on(all_strata, avail, [strata_col], "left")
            .select(strata_col,
                    F.element_at(tmap, F.col(strata_col)).cast("long").alias("target"),
                    F.coalesce("available", F.lit(0)).cast("long").alias("available"))
            .withColumn("taken", F.least("target", "available"))
            .withColumn("shortfall", F.col("target") - F.col("taken")))


def seeded_shuffle(sample: DataFrame, id_col: str, seed=43, rank_col: str = "shuffle_rank") -> DataFrame:
    """M2: whole-table shuffle as a rank column: one stratum, ranked by its sub-buckets, so
    the table may have any size."""
    return stratified_rank(sample, [], id_col, seed, rank_col)


def stratified_batches(df: DataFrame, strata_col: str, n_batches: int, id_col: str,
                       seed=42) -> DataFrame:
    """M3: n batches with equal stratum proportions: (rank - 1) % n."""
    r = stratified_rank(df, [strata_col], id_col, seed, "__rk")
    return r.withColumn("batch", ((F.col("__rk") - 1) % n_batches).cast("int")).drop("__rk")


def kfold_assign(df: DataFrame, label_col: str, k: int, id_col: str, seed=42) -> DataFrame:
    """M6: stratified shuffled k-fold: every row in one fold, class counts within 1."""
    r = stratified_rank(df, [label_col], id_col, seed, "__rk")
    return r.withColumn("fold", ((F.col("__rk") - 1) % k).cast("int")).drop("__rk")


def topup_sample(df: DataFrame, used_ids: DataFrame, strata_col: str, id_col: str,
                 per_stratum: int = 1, seed=42, used_bound: int | None = None) -> DataFrame:
    """M4: ``per_stratum`` fresh rows per stratum that were not sampled before."""
    used = checked_broadcast(used_ids.select(F.col(id_col).alias("__u")).distinct(), bound=used_bound)
    fresh = df.join(used, F.col(id_col) == F.col("__u"), "left_anti")
    return stratified_sample(fresh, strata_col, int(per_stratum), id_col, seed)
