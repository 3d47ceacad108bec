"""Deterministic hash expressions.

All "random" choices in this package are orders on an md5 key, so a result is
the same on any partitioning and any engine that has md5 (the DuckDB oracle
uses the same formulas).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def h24(s) -> Column:
    """First 6 hex digits of md5(s) read as an integer in [0, 2**24)."""
    return F.conv(F.substring(F.md5(_c(s)), 1, 6), 16, 10).cast("bigint")


def seeded_key(seed: int | str, id_col="sample_id") -> Column:
    """Order key of a seeded permutation: md5('<seed>:' || id)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _c(id_col).cast("string")))
