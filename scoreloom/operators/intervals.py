"""Joins of two tables of spans by overlap or containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spans that one place of a key is meant to hold on the left; more are dealt out.
CROWD = 20_000


def span_join(left: DataFrame, right: DataFrame, key: list[str], width: float, kind: str = "overlap", crowd: int = CROWD) -> DataFrame:
    """Pairs of spans of one key, as structs ``l`` and ``r``: those that overlap, or with kind ``inside`` the left ones within right ones.

    Both tables have ``s`` and ``e`` (from s up to, not including, e; empty
    and backward spans meet nothing) and the ``key`` columns. Spans are dealt
    to the bins of ``width`` that they touch, so a long one is in several; a
    pair is made in the bin where the later of its spans begins, and so once.
    Where a bin of a key has more than ``crowd`` left spans, these are split
    over several parts and the right ones are sent to all of them. Null keys
    meet nothing. ``width`` should be near the spans' usual length: it changes
    the work, not the result.
    """
    if kind not in ("overlap", "inside"):
        raise ValueError(f"no such join of spans: {kind}")
    bin_of = lambda c: F.floor(c / F.lit(width)).cast("long")
    bins = lambda side: F.explode(F.sequence(bin_of(F.col(f"{side}.s")), F.greatest(bin_of(F.col(f"{side}.s")), F.ceil(F.col(f"{side}.e") / F.lit(width)).cast("long") - 1)))
    keyed = lambda df, side: df.where("s < e").select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(key)], F.struct("*").alias(side)).withColumn("_bin", bins(side))
    at = [*[f"_k{i}" for i in range(len(key))], "_bin"]
    a, b = keyed(left, "l"), keyed(right, "r")
    crowded = a.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowd).select(*at, F.ceil(F.col("_n") / crowd).alias("_parts"))
    parts = lambda df: df.join(crowded, at, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    a = parts(a).withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.col("_parts"))).drop("_parts")
    b = parts(b).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    met = (F.col("l.s") < F.col("r.e")) & (F.col("r.s") < F.col("l.e")) & (F.col("_bin") == bin_of(F.greatest("l.s", "r.s")))
    if kind == "inside":
        met &= (F.col("r.s") <= F.col("l.s")) & (F.col("l.e") <= F.col("r.e"))
    return a.join(b, [*at, "_part"]).where(met).select("l", "r")
