"""Quality rules as a bitmask ledger.

``ledger`` reads every text once and evaluates every rule once: the row keeps each
measurement and one bit per failed rule. Policies are applied afterwards to the bits
alone (``judge``), so a new policy version never reads a text again, and ``ablation``
counts by bitwise aggregation what a policy drops, and what it would keep without
each of its rules. All of it is column expressions: one map-side pass over
the texts, no shuffle, no Python.

Edge cases: a null or empty text has zero words and fails only the word minimum.
Ratios are written as products, so nothing divides by zero. Repeated rows and null
ids pass through row by row. Empty table: empty ledger. Extra columns are kept by
``judge`` and ``keep``, and clashing names are avoided by writing the ledger into
columns named on output only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, let, where_kept, words

WINDOW = 5  # words of a repeated window

# ---- Fixed values: the contract's symbols ----
SYMBOLS = "[#*$%&|<>]"
# ----------------------------------------------

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


@dataclass(frozen=True)
class Rule:
    """One rule: its bit in the ledger and the failing condition over the measurements."""
    name: str
    bit: int
    fails: Callable[[Callable[[str], Column]], Column]


RULES = (
    Rule("few_words", 0, lambda m: m("n_words") < 10),
    Rule("repeated_windows", 1, lambda m: 100 * m("n_repeat_words") > 20 * m("n_words")),
    Rule("symbols", 2, lambda m: 100 * m("n_symbols") > 30 * m("n_words")),
    Rule("duplicate_lines", 3, lambda m: 100 * m("n_dup_lines") > 30 * m("n_lines")),
    Rule("long_words", 4, lambda m: m("word_chars") > 40 * m("n_words")),
    Rule("capitals", 5, lambda m: 100 * m("n_capitals") > 60 * m("word_chars")),
)
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A version and the names of the rules it enforces."""
    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        known = {r.name: r.bit for r in rules}
        return sum(1 << known[name] for name in self.rules)


POLICIES = {
    "base": Policy("base", BASE),
    "v1": Policy("v1", tuple(r.name for r in RULES)),
}


def repeat_cover(windows: Column) -> Column:
    """Words inside windows (array of window hashes by position) that occur more than once.

    Sorted (hash, position) pairs put equal windows side by side: n log n in the
    text's length, whatever repeats. The covered words are the union of the
    repeated windows' extents, summed from their sorted positions."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(ps: Column) -> Column:
        marks = F.transform(ps, lambda p, k: F.when((F.get(ps, k - 1)["h"] == p["h"]) | (F.get(ps, k + 1)["h"] == p["h"]),
                                                    p["i"]))
        return F.array_sort(F.filter(marks, lambda i: i.isNotNull()))

    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(let(pairs, repeated), none, lambda s, i: F.struct(
        (s["n"] + i + WINDOW - F.greatest(i, s["end"])).alias("n"), (i + WINDOW).alias("end")), lambda s: s["n"])


def window_hashes(hashes: Column) -> Column:
    """Hash of every window of WINDOW words, by position; empty for shorter texts."""
    last = F.size(hashes) - WINDOW
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])))


def measures(text: Column) -> Column:
    """Struct of every measurement of a whole text. One self-contained expression."""
    def of(ws: Column, windows: Column, lines: Column) -> Column:
        repeats = F.size(F.array_distinct(windows)) < F.size(windows)
        m = {
            "n_words": F.size(ws),
            "word_chars": F.aggregate(ws, F.lit(0).cast("long"), lambda n, w: n + F.char_length(w)),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": F.when(repeats, repeat_cover(windows)).otherwise(F.lit(0)),
            "n_lines": F.size(lines),
            "n_capitals": F.regexp_count(text, F.lit("[A-Z]")),
        }
        return F.struct(*[m[k].cast("long").alias(k) for k in MEASURES])

    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    return let(words(text), lambda ws: let(F.transform(ws, lambda w: F.xxhash64(w)), lambda hs: let(
        window_hashes(hs), lambda windows: let(lines, lambda ls: of(ws, windows, ls)))))


def ledger(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``measures`` (struct) and ``failed_bits`` (long, one bit per failed rule)."""
    def entry(m: Column) -> Column:
        bits = [F.when(r.fails(lambda k: m[k]), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in rules]
        return F.struct(m.alias("measures"), sum(bits[1:], bits[0]).cast("long").alias("failed_bits"))

    rows = docs.select("*", let(measures(F.coalesce(F.col(text_col), F.lit(""))), entry).alias("__entry"))
    kept = [rows[c] for c in docs.columns if c not in ("measures", "failed_bits")]
    return rows.select(*kept, "__entry.measures", "__entry.failed_bits")


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def judge(book: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with the policy's verdict, from the bits alone."""
    return book.withColumn("policy", F.lit(policy.version)).withColumn("kept", passes(policy, rules))


def keep(docs: DataFrame, policy: Policy, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of ``docs`` that pass the policy, columns as given."""
    book = ledger(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), F.col(text_col).alias("__body")),
                  "__body", rules)
    return where_kept(book, passes(policy, rules)).select("__row.*")


def ablation(book: DataFrame, policies: list[Policy], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per policy and rule: rows in all, dropped, failing the rule, failing it alone (kept without it).

    Rows first collapse to one count per failure bitmask, at most 2^rules of them."""
    by_bits = book.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    cells = [F.struct(F.lit(p.version).alias("policy"), F.lit(p.mask(rules)).cast("long").alias("mask"),
                      F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit"))
             for p in policies for r in rules if r.name in p.rules]
    c = by_bits.select("failed_bits", "n", F.explode(F.array(*cells)).alias("c"))
    hit = F.col("failed_bits").bitwiseAND(F.col("c.mask"))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias
    return c.groupBy("c.policy", "c.rule").agg(
        F.sum("n").alias("n_rows"), n(hit != 0)("n_dropped"), n(hit.bitwiseAND(F.col("c.bit")) != 0)("n_failed"),
        n(hit == F.col("c.bit"))("n_only_this"))
