"""Digest expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(text: Column) -> Column:
    """Upper-case base32 SHA-1 of a string's UTF-8 bytes, in JVM expressions only."""
    return hex_base32(F.sha1(text.cast("binary")))


def hex_base32(hexed: Column) -> Column:
    """Base32 of 40 hex digits; the bits are bound as a lambda variable so that they are built once."""
    bits = F.transform(F.array(hexed), lambda h: F.concat(*[F.lpad(F.conv(F.substring(h, F.lit(1 + 10 * i), F.lit(10)), 16, 2), 40, "0") for i in range(4)]))
    digit = lambda b, i: F.substring(F.lit(BASE32), F.conv(F.substring(b, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))
    return F.get(F.transform(bits, lambda b: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: digit(b, i)), "")), F.lit(0))
