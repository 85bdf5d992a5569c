"""Small shared helpers: size-checked broadcast, rounding, hashing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

# Largest row count and size we ever broadcast on a proven or counted bound.
BROADCAST_ROW_LIMIT = 2_000_000
BROADCAST_BYTE_LIMIT = 256 << 20


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: the length of strings, binaries and nested values, 16 for any other cell."""
    def cell(f) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (ArrayType, MapType, StructType)):
            c = F.to_json(F.struct(c))
        elif not isinstance(f.dataType, (StringType, BinaryType)):
            return F.lit(16)
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    return reduce(lambda x, y: x + y, [cell(f) for f in df.schema.fields], F.lit(0)).cast("long")


def checked_broadcast(df: DataFrame, bound: int | None = None, limit: int = BROADCAST_ROW_LIMIT,
                      byte_limit: int = BROADCAST_BYTE_LIMIT) -> DataFrame:
    """Broadcast ``df`` only behind a size check.

    ``bound`` is a caller-proven upper bound on the row count of narrow rows (for instance the
    sum of sample targets or a vocabulary cap); without one the rows and their bytes are counted,
    stopping at ``limit + 1`` rows. Above either limit the frame is returned as is and
    the planner shuffles (AQE may still broadcast it at runtime).
    """
    if bound is not None:
        return F.broadcast(df) if bound <= limit else df
    n, size = df.limit(limit + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()
    return F.broadcast(df) if n <= limit and size <= byte_limit else df


def unbroadcast(df: DataFrame) -> DataFrame:
    """``df`` for a join that deals both sides' rows by key, whatever Spark takes their size for.

    Spark sizes a stored table by its compressed files and an explode by the table below it, however many rows it
    makes; a side sized too low would be broadcast, through the driver's memory."""
    return df.hint("merge")


def r6(c) -> Column:
    """Round a double to 6 places (what the oracle compares)."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)


def seeded_hash(id_col, seed) -> Column:
    """md5 of 'seed:id' as hex: a deterministic, partitioning-independent order key
    that DuckDB can reproduce (md5(seed || ':' || id))."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def hex_prefix_int(h: Column, digits: int) -> Column:
    """Integer value of the first ``digits`` hex characters of a hash string."""
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("long")
