"""Repeatable pseudo-random columns.

Every draw is a function of a seed and a row key, so the value does not depend
on partitioning, task retries or the number of executors, and any SQL engine
with ``md5`` can recompute it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_hex(*parts) -> Column:
    """Lower-case hex md5 of the parts joined by ``:``."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def hex_int(hex_col: Column, digits: int = 12) -> Column:
    """First ``digits`` hex digits as a BIGINT."""
    return F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("bigint")


def hash_unit(*parts) -> Column:
    """Uniform draw in the open interval (0, 1)."""
    return (hex_int(hash_hex(*parts)) + F.lit(0.5)) / F.lit(float(2**48))


def hash_int(n: Column, *parts) -> Column:
    """Uniform draw in 0 .. n-1."""
    return F.floor(hash_unit(*parts) * n).cast("bigint")


def hash_normal(*parts) -> Column:
    """Standard normal draw (Box-Muller on two uniforms)."""
    u = hash_unit(*parts, "u")
    v = hash_unit(*parts, "v")
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0 * math.pi) * v)
