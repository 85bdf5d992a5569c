"""SimHash near-duplicates through tables of fingerprint neighbours.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word
shingles. Fingerprints within ``max_bits`` of each other are linked, and linked
fingerprints form components.

Index. Multi-index hashing keeps a table per fingerprint segment, keyed by the
segment's value alone; all near copies that share a segment then meet in one bucket and
would be paired there. This index departs from it: the small Hamming ball is enumerated over
the whole fingerprint, and every neighbour is a key of one table. Two fingerprints at
distance d <= 2 differ by at most one flip from a common key, so they meet; a match is
then verified on the complete distance. A key meets at most 65 distinct fingerprints (the
radius-1 ball), so no bucket is hot however many copies the corpus holds. Within a key every
fingerprint links to the smallest one: components need no other pair, and no
pair list is ever built. Exact copies collapse to one fingerprint before any of it.

Odd ``max_bits`` index the smaller ball and probe the larger one; links always join
a probe to an index entry, so a link never exceeds ``max_bits``.

Edge cases: a null or empty text has no words and fingerprint zero, linked like any
other. Fewer words than a shingle: the whole sequence is the one shingle. Repeated
shingles count every time. Rows with a null id get a fingerprint and their
component's smallest id, but name no component. An id that stands on several texts is a
row of each of their components; ``dedup`` keeps one row per component all the same. Empty table:
empty result. Extra columns are ignored by ``fingerprints`` and ``link``, and kept by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import components

BITS = 64
SEGMENTS = 2
HASH_SEED = 42
BLOCK = 1 << 16  # shingles whose bits are unpacked at once: bounds memory for any text length


def majority(data: bytes | None, shingle: int) -> int:
    """Fingerprint of one UTF-8 text as a signed 64-bit integer."""
    parts = (data or b"").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not parts:
        return 0
    joined = b" ".join(parts)
    width = min(shingle, len(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    spans = zip(starts[:len(parts) - width + 1].tolist(), (ends[width - 1:] - 1).tolist(), strict=True)
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[a:b], HASH_SEED) for a, b in spans]), np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[i:i + BLOCK], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def simhasher(shingle: int):
    """Column function: the fingerprints of UTF-8 texts."""
    @F.pandas_udf("long")
    def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([majority(t, shingle) for t in batch], dtype="int64")
    return simhash


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id_col``, ``fp`` (signed 64-bit) for every row."""
    return docs.select(F.col(id_col), simhasher(shingle)(F.col(text_col).cast("binary")).alias("fp"))


def ball(radius: int, segments: int = SEGMENTS) -> list[int]:
    """Masks of the Hamming balls of the given radius, spread over the segments: every
    set of at most ``radius`` flips, listed segment by segment of its lowest flip."""
    width = BITS // segments
    masks = [0]
    for s in range(segments):
        for size in range(1, radius + 1):
            for flips in combinations(range(s * width, BITS), size):
                if flips[0] < (s + 1) * width:
                    masks.append(sum(1 << f for f in flips))
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]


def keyed(fps: DataFrame, radius: int) -> DataFrame:
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius)])
    return fps.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("key"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Verified links ``fp``, ``hub`` between distinct fingerprints whose components are
    those of all pairs within ``max_bits`` bits."""
    probe = keyed(fps, (max_bits + 1) // 2)
    if max_bits % 2 == 0:
        entries = probe.withColumn("entry", F.col("fp"))
    else:
        masks = F.array(*[F.lit(m).cast("long") for m in ball(max_bits // 2)])
        entries = probe.withColumn("entry", F.when(F.array_contains(masks, F.col("fp").bitwiseXOR(F.col("key"))), F.col("fp")))
    hub = F.min("entry").over(Window.partitionBy("key"))
    return (entries.withColumn("hub", hub).where("hub is not null and hub <> fp").select("fp", "hub")
            .where(distance(F.col("fp"), F.col("hub")) <= max_bits).distinct())


def rooted(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> DataFrame:
    """``id_col``, ``fp``, ``root`` (a fingerprint that names the component) and ``component_id`` for every row."""
    marked = fingerprints(docs, id_col, text_col, shingle).checkpoint(eager=True)
    each = marked.groupBy("fp").agg(F.min(id_col).alias("low"), F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    roots = components(links(each.select("fp"), max_bits), "fp", "hub").select(F.col("node").alias("fp"), "root")
    roots = roots.unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    classed = each.join(roots, "fp", "left").where("root is not null or n > 1")
    classed = classed.select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = classed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = classed.join(lows, "root").select("fp", "root", "component_id")
    return (marked.join(named, "fp", "left")
            .select(id_col, "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", id_col).alias("component_id")))


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
         max_bits: int = 2) -> DataFrame:
    """``id_col``, ``fp``, ``component_id`` (smallest id reachable) for every row."""
    return rooted(docs, id_col, text_col, shingle, max_bits).select(id_col, "fp", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
          max_bits: int = 2) -> DataFrame:
    """One row of each component: the one whose id names it. Columns as given.

    Of several such rows (an id that repeats), the one with the smallest fingerprint, then
    text, stays. Rows with a null id cannot be named and stay."""
    rows = rooted(docs, id_col, text_col, shingle, max_bits).where(F.col(id_col).isNotNull())
    mark = lambda c: F.when(F.col(id_col) == F.col("component_id"), F.col(c))
    ids = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("copies"), F.min(mark("fp")).alias("fp"))
    ids = ids.where("fp is not null").select(F.col(id_col).alias("kept_id"), "copies").checkpoint(eager=True)
    once = docs.join(ids.where("copies = 1"), docs[id_col] == ids["kept_id"], "left_semi")
    return once.unionByName(_repeated(docs, ids.where("copies > 1"), rows, id_col, text_col, shingle)).unionByName(
        docs.where(F.col(id_col).isNull()))


def _repeated(docs: DataFrame, ids: DataFrame, rows: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Survivors among the rows whose id repeats: one per component, found by id and fingerprint."""
    again = docs.join(ids, docs[id_col] == ids["kept_id"], "left_semi").select(F.struct(*docs.columns).alias("__row"))
    again = again.select(
        "__row", F.col(f"__row.{id_col}").alias("__id"), F.col(f"__row.{text_col}").alias("__text"))
    again = again.withColumn("__fp", simhasher(shingle)(F.col("__text").cast("binary")))
    named = rows.join(ids, rows[id_col] == ids["kept_id"], "left_semi").where(F.col(id_col) == F.col("component_id"))
    named = named.select(F.col(id_col).alias("__rid"), F.col("fp").alias("__rfp"), F.col("root").alias("__root")).distinct()
    found = again.join(named, (F.col("__id") == F.col("__rid")) & (F.col("__fp") == F.col("__rfp")))
    plain = [F.col(f"__row.{f.name}") for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    order = F.struct("__fp", F.coalesce("__text", F.lit("")), F.col("__text").isNull(), F.xxhash64(*plain))
    return found.groupBy("__root").agg(F.min_by("__row", order).alias("__row")).select("__row.*")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
