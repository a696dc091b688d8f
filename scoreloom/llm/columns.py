"""Names of columns that an operator adds to a user's table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apart(df: DataFrame, *added: str) -> list[Column]:
    """All columns of ``df``; one that is called as one of ``added``, in any case, gets underscores before its name until it is free."""
    taken = {c.lower() for c in [*df.columns, *added]}
    out = []
    for c in df.columns:
        name = c
        if c.lower() in {a.lower() for a in added}:
            while name.lower() in taken:
                name = "_" + name
            taken.add(name.lower())
        out.append(F.col(f"`{c}`").alias(name))
    return out
