"""Seeded, engine-independent randomness and rounding.

Every random choice of the library is a function of (seed, key): the md5 of
``'<seed>:<key>'``.  The same expression exists in DuckDB, so sampled sets
can be checked against plain SQL, and nothing depends on partitioning or
task order (a re-run after an executor loss yields the same rows).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def md5_key(key, seed) -> Column:
    """Hex md5 of '<seed>:<key>' (key cast to string)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _c(key).cast("string")))


def hash16(key, salt) -> Column:
    """Integer in [0, 65536): the first 4 hex digits of ``md5_key``."""
    return F.conv(F.substring(md5_key(key, salt), 1, 4), 16, 10).cast("bigint")


def round_half_up(col, digits: int = 6) -> Column:
    """floor(x * 10^d + 0.5) / 10^d, identical in Spark and DuckDB.

    ``round`` differs between engines at exact halves; this form does not.
    """
    scale = float(10 ** digits)
    return (F.floor(_c(col) * scale + 0.5) / scale).cast("double")


def safe_div(num, den) -> Column:
    """Division that yields NULL for a zero denominator (ANSI-safe)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))
