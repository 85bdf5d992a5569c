"""Secret scan: known forms by pattern, unknown ones by sliding-window Shannon entropy.

Base kinds are patterns. The method adds candidate strings of a character class
(hex digits, base-64 alphabet) whose entropy reaches the class's threshold in some
window of ``window`` characters. The window slides by one character: the entering and
leaving characters change two counts, and the entropy sum changes by the two counts'
terms, so a candidate of n characters costs n steps, never n windows. A candidate of 16
to 23 characters is one window of its own length, with a threshold for short windows.
Hex runs are candidates of their own between any separators, also inside a base-64
candidate ('KEY=4F3A...'). Candidates that match the allow list, or have the form of a
base kind or another class, add nothing; an allowed part inside a candidate clears only
the windows that it touches.

Column expressions only: one map-side pass over whole texts, no shuffle, no Python.
Positions are code points, ends exclusive. A pattern's matches and the text between
them come from one split and one extract, and a running sum in blocks places them, so
a text with many matches costs little more than its length.

Edge cases: a null or empty text has no spans. Repeated rows and null ids pass
through row by row. Empty table: empty result. Extra columns are kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# ---- Fixed values: the contract's kinds, in order, with their patterns ----
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex"]
ASSIGN_MIN = 12
ACCESS_MIN = 18
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class CharClass:
    """Candidates of one character class and the entropy (bits a character) that flags a window."""
    kind: str
    pattern: str
    alphabet: str
    threshold: float
    covered: str  # candidates of this form belong to another kind already
    short: str  # candidates shorter than a window, but long enough to judge
    short_threshold: float  # their entropy as a share of the largest their length and alphabet allow
    short_covered: str


WINDOW = 24
CLASSES = (
    CharClass("entropy_hex", r"(?:(?<![A-Za-z0-9])|(?<=0[xX]))[0-9A-Fa-f]{24,}(?![A-Za-z0-9])", "0123456789abcdef", 3.0,
              "^[0-9a-f]+$", r"(?:(?<![A-Za-z0-9])|(?<=0[xX]))[0-9A-Fa-f]{16,23}(?![A-Za-z0-9])", 0.65, "^[0-9a-f]+$"),
    CharClass("entropy_base64", r"[A-Za-z0-9+/_=-]{24,}",
              "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.9,
              "^[0-9A-Fa-f]+$", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,23}(?![A-Za-z0-9+/_=-])", 0.84,
              "^[0-9A-Fa-f]+$|^AKIA[A-Z0-9]{14,}$"),
)
SHORT = 16
# Strings that look random and are not secrets. Whole candidates: lower-case words (the first letter may be a
# capital), alphabets, digests of nothing. Parts: these and placeholders, wherever they stand.
KNOWN = ("0123456789abcdef|abcdefghijklmnopqrstuvwxyz|d41d8cd98f00b204e9800998ecf8427e|"
         "da39a3ee5e6b4b0d3255bfef95601890afd80709|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")
ALLOW = rf"^[A-Z]?[a-z+/_=-]*$|^(?:(?i:{KNOWN}|0123456789)[+/_=-]*)+$"
PARTS = f"(?i:{KNOWN}|example|placeholder|dummy)"
BLOCK = 256  # matches placed in one running sum

SPAN = "struct<s:int,k:int,e:int>"
PLACED = "struct<s:int,e:int,m:string>"


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<s, e, m>>; empty when there are none."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found,
                       lambda g, m: F.struct(F.char_length(g).alias("gap"), m.alias("m")))

    def place(block: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), empty(PLACED).alias("out"))
        return F.aggregate(block, zero, lambda a, x: F.struct(
            (a["at"] + x["gap"] + F.char_length(x["m"])).alias("at"),
            F.array_append(a["out"], F.struct((a["at"] + x["gap"]).alias("s"),
                                              (a["at"] + x["gap"] + F.char_length(x["m"])).alias("e"),
                                              x["m"].alias("m"))).alias("out")))

    def chain(ps: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(ps) - 1) / BLOCK).cast("int")),
                             lambda b: place(F.slice(ps, b * BLOCK + 1, F.lit(BLOCK))))
        zero = F.struct(F.lit(0).alias("at"), empty(PLACED).alias("out"))
        return F.aggregate(blocks, zero, lambda a, x: F.struct(
            (a["at"] + x["at"]).alias("at"),
            F.concat(a["out"], F.transform(x["out"], lambda y: F.struct(
                (y["s"] + a["at"]).alias("s"), (y["e"] + a["at"]).alias("e"), y["m"].alias("m")))).alias("out")),
            lambda a: a["out"])

    return F.when(text.rlike(pattern), let(pairs, chain)).otherwise(empty(PLACED))


def window_entropy(candidate: Column, cls: CharClass, window: int = WINDOW) -> Column:
    """Largest Shannon entropy (bits a character) over all windows of the candidate."""
    terms = F.array(*[F.lit(0.0 if n < 2 else n * math.log2(n)) for n in range(window + 1)])
    body = candidate if cls.alphabet != cls.alphabet.lower() else F.lower(candidate)
    codes = F.transform(F.split(body, ""), lambda c: F.call_function("position", c, F.lit(cls.alphabet)))

    def slide(at: Column) -> Column:
        zero = F.struct(F.array_repeat(F.lit(0), len(cls.alphabet) + 1).alias("n"), F.lit(0.0).alias("sum"),
                        F.lit(0.0).alias("best"))

        def step(a: Column, i: Column) -> Column:
            new, old = at[i], F.when(i >= window, at[F.greatest(i - window, F.lit(0))]).otherwise(F.lit(-1))
            count = F.transform(a["n"], lambda n, c: n + (c == new).cast("int") - (c == old).cast("int"))
            up = a["n"][new]
            down = F.when(old >= 0, a["n"][F.greatest(old, F.lit(0))]).otherwise(F.lit(0))
            same = new == old
            total = (a["sum"]
                     + F.when(same, F.lit(0.0)).otherwise(terms[F.least(up + 1, F.lit(window))] - terms[F.least(up, F.lit(window))])
                     - F.when(same | (old < 0), F.lit(0.0)).otherwise(terms[down] - terms[F.greatest(down - 1, F.lit(0))]))
            bits = F.when(i >= window - 1, F.lit(math.log2(window)) - total / window).otherwise(F.lit(0.0))
            return F.struct(count.alias("n"), total.alias("sum"), F.greatest(a["best"], bits).alias("best"))

        return F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), zero, step, lambda a: a["best"])

    return let(codes, slide)


def base_spans(text: Column) -> Column:
    """The base kinds' spans as array<struct<s, k, e>>; k is the kind's place in KINDS."""
    def span(k: int):
        return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))
    assign = F.filter(located(text, ASSIGN), lambda x: F.char_length(F.regexp_extract(x["m"], ASSIGN, 2)) >= ASSIGN_MIN)
    access = F.filter(located(text, ACCESS), lambda x: F.char_length(x["m"]) >= ACCESS_MIN)
    return F.concat(F.transform(assign, span(0)), F.transform(access, span(1)), F.transform(located(text, HEX), span(2)))


def own_entropy(word: Column, cls: CharClass) -> Column:
    """Shannon entropy of a short word, as a share of the largest its length and alphabet allow."""
    size = F.char_length(word)
    body = word if cls.alphabet != cls.alphabet.lower() else F.lower(word)

    def bits(chars: Column) -> Column:
        counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)))
        return F.log2(size) - F.aggregate(counts, F.lit(0.0), lambda a, n: a + n * F.log2(n.cast("double"))) / size

    return let(F.split(body, ""), bits) / F.least(F.log2(size), F.lit(math.log2(len(cls.alphabet))))


def entropy_spans(text: Column, classes: tuple[CharClass, ...], window: int) -> Column:
    """The method's spans: random-looking candidates that neither the allow list nor a base kind covers."""
    def of(k: int, cls: CharClass) -> list[Column]:
        def high(piece: Column) -> Column:
            size = F.char_length(piece)
            entropy = (F.when(size >= window, window_entropy(piece, cls, window) >= cls.threshold)
                       .when(size >= SHORT, own_entropy(piece, cls) >= cls.short_threshold).otherwise(F.lit(False)))
            return ~piece.rlike(ALLOW) & entropy

        def secret(covered: str):
            return lambda x: ~x["m"].rlike(ALLOW) & ~x["m"].rlike(covered) & F.exists(F.split(x["m"], PARTS), high)

        def span(x: Column) -> Column:
            return F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))

        return [F.transform(F.filter(located(text, pattern), secret(covered)), span)
                for pattern, covered in ((cls.pattern, cls.covered), (cls.short, cls.short_covered))]

    return F.concat(*[spans for k, cls in enumerate(classes, len(KINDS)) for spans in of(k, cls)])


def scan(docs: DataFrame, text_col: str = "text", classes: tuple[CharClass, ...] = CLASSES,
         window: int = WINDOW) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: array<struct<s, k, e>> by start, then kind."""
    text = F.coalesce(F.col("__text"), F.lit(""))
    rows = docs.select("*", F.col(text_col).alias("__text"))
    rows = rows.select("*", base_spans(text).alias("__base"))
    rows = rows.select("*", F.concat("__base", entropy_spans(text, classes, window)).alias("__all"))
    kept = [rows[c] for c in docs.columns if c not in ("base", "spans")]
    return rows.select(*kept, F.array_sort("__base").alias("base"), F.array_sort("__all").alias("spans"))


def written(spans: Column, classes: tuple[CharClass, ...] = CLASSES) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in [*KINDS, *[c.kind for c in classes]]])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"),
                                                                 x["e"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]",
           classes: tuple[CharClass, ...] = CLASSES, window: int = WINDOW) -> DataFrame:
    """``docs`` with every span of the text replaced by ``mask``; columns as given.

    Overlapping spans give one mask. A null text stays null."""
    inner = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), F.col(text_col).alias("__body"))
    rows = scan(inner, "__body", classes, window)
    text = F.col("__body")
    zero = F.struct(F.lit(0).alias("at"), empty("string").alias("out"))
    # a span that begins inside the one before it only moves the end: no second mask
    pieces = F.aggregate("spans", zero, lambda a, x: F.struct(
        F.greatest(a["at"], x["e"]).alias("at"),
        F.when((x["s"] < a["at"]) & (F.size(a["out"]) > 0), a["out"]).otherwise(
            F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, F.greatest(x["s"] - a["at"], F.lit(0))),
                                       F.lit(mask)))).alias("out")),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.char_length(text))))
    clean = F.when(F.size("spans") > 0, pieces).otherwise(text)
    return rows.select(*[clean.alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in docs.columns])
