"""Portable randomness: every random choice is a hash of stable columns.

``rand()`` depends on partitioning and is recomputed differently when an
executor is lost, so nothing here uses it.  An MD5 of ``seed|parts`` gives the
same number on every run, on every partition layout and in other SQL engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 4294967296  # 32 bits: eight hexadecimal digits


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def digest(*parts) -> Column:
    """Hexadecimal MD5 of the parts joined by ``|`` (Columns or literals)."""
    return F.md5(F.concat_ws("|", *[as_column(p).cast("string") for p in parts]))


def hash32_of(hex_digest: Column, start: int = 1) -> Column:
    """Eight hexadecimal digits of a digest as BIGINT in [0, 2**32)."""
    return F.conv(F.substring(hex_digest, start, 8), 16, 10).cast("bigint")


def hash32(*parts) -> Column:
    return hash32_of(digest(*parts))


def unit_interval(*parts) -> Column:
    """DOUBLE in [0, 1)."""
    return hash32(*parts).cast("double") / F.lit(float(HASH_RANGE))
