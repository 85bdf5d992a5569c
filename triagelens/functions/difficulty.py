"""Rule-based message difficulty (F1-F9) as native column expressions.

Everything here is a Catalyst expression: constant lexicon literals fold into
the generated code and no row leaves the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexicon import REFERENCE, Lexicon

# Unicode whitespace as Python's str.split() sees it; the same class is valid in
# Java regex and RE2, so the DuckDB oracle uses it verbatim.
WS_CLASS = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
NON_WS_CLASS = "[^" + WS_CLASS[1:]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lower_text(text) -> Column:
    """F1."""
    return F.lower(_c(text))


def group_hits(text, lex: Lexicon = REFERENCE) -> list[tuple[str, Column]]:
    """Per keyword group: does any keyword occur as a substring of the lower-cased text."""
    lo = lower_text(text)
    return [(name, reduce(lambda a, b: a | b, [lo.contains(k) for k in kws]))
            for name, kws in lex.groups.items()]


def n_groups(text, lex: Lexicon = REFERENCE) -> Column:
    """number of keyword groups with at least one hit."""
    return reduce(lambda a, b: a + b, [h.cast("int") for _, h in group_hits(text, lex)])


def matched_groups(text, lex: Lexicon = REFERENCE) -> Column:
    """names of the matched groups, in lexicon order."""
    return F.array_compact(F.array(*[F.when(h, F.lit(n)) for n, h in group_hits(text, lex)]))


def caps_ratio(text) -> Column:
    """upper-case letters over letters (Unicode), 0.0 without letters."""
    t = _c(text)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    uppers = F.length(F.regexp_replace(t, r"[^\p{Lu}]", ""))
    # each part appears once, so Catalyst never re-inlines a regex pass
    return F.coalesce(uppers / F.nullif(letters, F.lit(0)), F.lit(0.0))


def any_substring(text, words: list[str]) -> Column:
    lo = lower_text(text)
    if not words:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [lo.contains(w) for w in words])


def is_emotional(text, lex: Lexicon = REFERENCE) -> Column:
    """caps ratio above threshold, any '!', or a frustration word (substring)."""
    t = _c(text)
    return (caps_ratio(t) > lex.caps_threshold) | t.contains("!") | any_substring(t, lex.frustration)


def word_count(text) -> Column:
    """Whitespace-separated words, as str.split() counts them.

    One regex split; the empty pieces a leading or trailing space leaves are
    taken off by looking at the first and last character only.
    """
    t = _c(text)
    pieces = F.size(F.split(t, WS_CLASS + "+", -1))
    lead = F.substring(t, 1, 1).rlike(WS_CLASS).cast("int")
    trail = F.substring(t, -1, 1).rlike(WS_CLASS).cast("int")
    return F.when(F.length(t) == 0, F.lit(0)).otherwise(pieces - lead - trail)


def is_unusual_length(text, lex: Lexicon = REFERENCE) -> Column:
    """F6."""
    # n <= s or n >= l  <=>  |2n - (s + l)| >= l - s, with n referenced once
    n = word_count(text)
    s, l = lex.short_words, lex.long_words
    return F.abs(n * 2 - (s + l)) >= (l - s)


def difficulty_score(text, lex: Lexicon = REFERENCE) -> Column:
    """+3 no group, +2 two or more groups, +1 emotional, +1 unusual length."""
    # points by number of matched groups: 0 -> 3, 1 -> 0, 2+ -> 2 (one reference to g)
    table = [3, 0] + [2] * max(1, len(lex.groups) - 1)
    base = F.element_at(F.array(*[F.lit(v) for v in table]), n_groups(text, lex) + 1)
    return (base + is_emotional(text, lex).cast("int") + is_unusual_length(text, lex).cast("int")).cast("int")


def score_to_bucket(score) -> Column:
    """F8. A null score (null text) has no bucket."""
    names = ["typical", "edge", "ambiguous"] + ["adversarial"] * 4
    # asked for by name: element_at is never null to the optimiser over an array without nulls
    return F.when(_c(score).isNotNull(), F.element_at(F.array(*[F.lit(v) for v in names]), F.least(_c(score), F.lit(6)) + 1))


def score_frame(df: DataFrame, text_col: str = "text", lex: Lexicon = REFERENCE,
                detail: bool = False) -> DataFrame:
    """F9 core: add difficulty_score and difficulty_bucket (and the parts if ``detail``)."""
    if not detail:
        out = df.select("*", difficulty_score(F.col(text_col), lex).alias("difficulty_score"))
        return out.withColumn("difficulty_bucket", score_to_bucket("difficulty_score"))
    # Each rule part is computed once in its own projection and the score is
    # derived from those columns: the parts are referenced twice below, so
    # Catalyst keeps the projections apart instead of re-inlining each regex pass.
    t = F.col(text_col)
    parts = df.select("*", word_count(t).alias("n_words"), caps_ratio(t).alias("__caps"),
                      n_groups(t, lex).alias("n_groups"),
                      (t.contains("!") | any_substring(t, lex.frustration)).alias("__marks"))
    s, l = lex.short_words, lex.long_words
    table = [3, 0] + [2] * max(1, len(lex.groups) - 1)
    emotional = (F.col("__caps") > lex.caps_threshold) | F.col("__marks")
    unusual = (F.col("n_words") <= s) | (F.col("n_words") >= l)
    flags = parts.select("*", emotional.alias("is_emotional"), unusual.alias("is_unusual_length"))
    score = (F.element_at(F.array(*[F.lit(v) for v in table]), F.col("n_groups") + 1)
             + F.col("is_emotional").cast("int") + F.col("is_unusual_length").cast("int")).cast("int")
    out = flags.select(*df.columns, "n_words", F.round("__caps", 6).alias("caps_ratio"), "n_groups",
                       "is_emotional", "is_unusual_length", score.alias("difficulty_score"))
    return out.withColumn("difficulty_bucket", score_to_bucket("difficulty_score"))
