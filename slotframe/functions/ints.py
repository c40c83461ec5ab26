"""Unsigned integer semantics on signed columns: clamp, saturate, wrap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U16, U32 = (1 << 16) - 1, (1 << 32) - 1
U64 = "18446744073709551615"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp_time(t) -> Column:
    """Seconds as unsigned 32 bits: null and negative are 0, too large the maximum."""
    return F.least(F.greatest(F.coalesce(_c(t), F.lit(0)).cast("bigint"), F.lit(0)), F.lit(U32))


def clamp_slot(slot) -> Column:
    return F.least(_c(slot).cast("bigint"), F.lit(U32))


def saturate32(x) -> Column:
    """A sum of non-negative numbers as unsigned 32 bits that stop at the maximum."""
    return F.least(_c(x), F.lit(U32)).cast("bigint")


def wrap32(x) -> Column:
    return _c(x).bitwiseAND(F.lit(U32))


def wrap16(x) -> Column:
    return _c(x).bitwiseAND(F.lit(U16))


def saturate16(x) -> Column:
    return F.least(_c(x), F.lit(U16))


def u64(x) -> Column:
    """Unsigned 64 bits as a decimal."""
    return F.least(_c(x).cast("decimal(38,0)"), F.lit(U64).cast("decimal(38,0)"))
