"""Seeds and counter-based random numbers from SHA-256, the same in every partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def derive_seed(master: str, *parts: Column) -> Column:
    """The first 64 bits of SHA-256 over master and parts, as an unsigned decimal(20,0)."""
    digest = F.sha2(F.concat_ws(SEPARATOR, F.lit(master), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) for a tuple of keys: 48 bits of their SHA-256."""
    digest = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def pick(n: Column, *parts: Column) -> Column:
    """An index in 0 .. n - 1 for a tuple of keys."""
    return F.floor(uniform(*parts) * n).cast("int")
