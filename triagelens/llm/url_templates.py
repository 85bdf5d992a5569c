"""URL filter: per-host path-template trees with smoothed labelled purity.

Known rules (host and path prefix) judge the urls they fit and label them. The other
urls are judged by the template their path falls in. Templates come from a tree per
host, grown level by level: segments of a variable form (numbers, hex, long strings)
become the wildcard at once, and so do branches that are rare among many siblings.
Siblings of about one labelled block rate (tenths) and one remaining depth form a
cluster, and a branch whose rate does not differ from its cluster's by a two-proportion
test merges into the cluster's wildcard (``*`` and the tenths). A template is
rejected when its block purity, smoothed towards the corpus rate, reaches
``REJECT_PURITY`` on at least ``MIN_LABELLED`` labelled urls; others are allowed.

Urls collapse to counts per (host, typed path) before anything else, so a host with a
third of all urls is summed map-side, and all levels work on those counts with joins
and partial sums only. No host is ever gathered in one task.

Edge cases: null urls and urls without ``://`` have empty host and path, fit no rule
and are allowed unless their (empty) template is rejected. Repeated rows are judged
each. Very long urls are split whole: the depth of the tree has no bound, and a path that shares
no template with another ends at once. Ties between rules of one length go by name. Empty table: empty result. Extra columns are kept; ``host``, ``path``,
``rule`` and ``verdict`` replace columns of those names.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LITERALS = 20     # children beyond which rare ones merge
MIN_SHARE = 0.02      # share of a node's urls that keeps a branch literal among many
SIMILAR_Z = 1.96      # two-proportion test of merging
PRIOR_WEIGHT = 4.0    # pseudo-urls of the corpus rate
MIN_LABELLED = 5
REJECT_PURITY = 0.95


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# ---- Fixed values: the contract's rules ----
RULES = (
    UrlRule("com", "/", "allow"),
    UrlRule("example.com", "/en/", "block"),
    UrlRule("www.example.com", "/en/", "allow"),
    UrlRule("net", "/es/", "block"),
    UrlRule("net", "/fr/", "block"),
)
# --------------------------------------------


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return (F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit("")),
            F.coalesce(path, F.lit("")))


def matched(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule (ties by name), or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def typed(segment: Column) -> Column:
    """A path segment, or the name of its variable form."""
    return (F.when(segment.rlike(r"^[0-9]+$"), "{n}")
            .when(segment.rlike(r"^[0-9]+\.[A-Za-z0-9]{1,5}$"), F.concat(F.lit("{n}."), F.substring_index(segment, ".", -1)))
            .when(segment.rlike(r"^[0-9a-fA-F-]{8,}$"), "{x}")
            .when(F.char_length(segment) > 40, "{s}")
            .otherwise(segment))


def segments(path: Column) -> Column:
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), typed)


def level(rows: DataFrame, i: int) -> DataFrame:
    """Move ``prefix`` of every open row one segment down: literal, or a wildcard where branches merge.

    The only path below a node has no siblings at any level: it goes all the way down at once."""
    key = ["host", "prefix"]
    seg = rows.where("open").withColumn("seg", F.col("segs")[i])
    done = rows.where("not open")
    left = (F.size("segs") - i) * F.col("n")
    kids = seg.groupBy(*key, "seg").agg(F.sum("n").alias("kn"), F.sum("blocked").alias("kb"), F.sum("allowed").alias("ka"),
                                        F.sum(left).alias("kd"), F.count(F.lit(1)).alias("kr"))
    labelled = F.col("kb") + F.col("ka")
    # branches of about one block rate and one remaining depth form a cluster of their node
    kids = kids.withColumn("rate", F.round(10 * F.col("kb") / F.nullif(labelled, F.lit(0))).cast("int")).withColumn(
        "shape", F.round(F.col("kd") / F.col("kn")).cast("int"))
    node = kids.groupBy(*key).agg(F.count(F.lit(1)).alias("width"), F.sum("kn").alias("pn"), F.sum("kr").alias("rows"))
    cluster = kids.where("rate is not null").groupBy(*key, "rate", "shape").agg(F.sum("kb").alias("cb"), F.sum("ka").alias("ca"))
    others = F.col("cb") + F.col("ca") - labelled
    pooled = F.col("cb") / (F.col("cb") + F.col("ca"))
    gap = F.abs(F.col("kb") / labelled - (F.col("cb") - F.col("kb")) / others)
    error = F.sqrt(pooled * (1 - pooled) * (1 / labelled + 1 / others))
    similar = F.when((labelled > 0) & (others > 0), gap <= SIMILAR_Z * error).otherwise(F.lit(False))
    rare = (F.col("width") > MAX_LITERALS) & (F.col("kn") < MIN_SHARE * F.col("pn"))
    name = (F.when(F.col("seg").startswith("{") | rare, "*")
            .when(similar, F.concat(F.lit("*"), F.col("rate").cast("string"))).otherwise(F.col("seg")))
    named = kids.join(node, key).join(cluster, [*key, "rate", "shape"], "left").select(
        *key, "seg", name.alias("name"), (F.col("rows") == 1).alias("alone"))
    rest = F.transform(F.slice("segs", i + 2, F.greatest(F.size("segs"), F.lit(1))),
                       lambda s: F.concat(F.lit("/"), F.when(s.startswith("{"), "*").otherwise(s)))
    moved = seg.join(named, [*key, "seg"]).withColumn("prefix", F.concat(
        "prefix", F.lit("/"), "name", F.when(F.col("alone"), F.array_join(rest, "")).otherwise(F.lit(""))))
    moved = moved.withColumn("open", ~F.col("alone") & (F.size("segs") > i + 1))
    return moved.select(*rows.columns).unionByName(done)


def grow(counts: DataFrame) -> DataFrame:
    """``host``, ``segs``, ``prefix``: the template of every (host, typed path).

    The tree has as many levels as two different paths of one host have templates in common, and one more."""
    rows, i = counts.withColumn("prefix", F.lit("")).withColumn("open", F.size("segs") > 0), 0
    while not rows.where("open").isEmpty():
        # every level reads the one before twice: it is written, not planned again
        rows, i = level(rows, i).checkpoint(eager=True), i + 1
    return rows


def judge(pages: DataFrame, url_col: str = "url", rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``template`` and ``verdict``."""
    own = ("host", "path", "rule", "verdict", "template")
    kept = [c for c in pages.columns if c not in own]
    row = F.struct(*[pages[c] for c in kept]) if kept else F.struct(F.lit(0))
    host, path = host_path(pages[url_col])
    rows = pages.select(row.alias("row"), host.alias("host"), path.alias("path"))
    name, verdict = matched(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), verdict.alias("known"), segments(F.col("path")).alias("segs"))
    counts = rows.groupBy("host", "segs").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("known") == "block").alias("blocked"),
        F.count_if(F.col("known") == "allow").alias("allowed")).checkpoint(eager=True)
    total = counts.agg(F.sum("blocked"), F.sum("allowed")).first()
    rate = (total[0] or 0) / max(1, (total[0] or 0) + (total[1] or 0))
    leaves = grow(counts)
    seen = F.sum("blocked") + F.sum("allowed")
    purity = (F.sum("blocked") + PRIOR_WEIGHT * rate) / (seen + PRIOR_WEIGHT)
    bad = leaves.groupBy("host", "prefix").agg(((seen >= MIN_LABELLED) & (purity >= REJECT_PURITY)).alias("bad"))
    leaf = leaves.select("host", "segs", "prefix").join(bad, ["host", "prefix"])
    out = rows.join(leaf, ["host", "segs"], "left")
    decided = F.coalesce("known", F.when(F.col("bad"), "block").otherwise("allow"))
    return out.select(*[F.col("row")[c].alias(c) for c in kept], "host", "path", "rule",
                      F.col("prefix").alias("template"), decided.alias("verdict"))
