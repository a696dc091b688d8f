"""Distributed ordinals: the place of each row in a total order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.scratch import staged

#: Bits of monotonically_increasing_id that number the rows of a partition.
ROW_BITS = 33


def numbered(df: DataFrame, order: list[Column | str], name: str = "ordinal", by: list[str] | None = None) -> DataFrame:
    """Add ``name``: the row's place from 0 in ``order``, among all rows or among those that agree in ``by``.

    Two passes. The rows are cut into ranges of (``by``, ``order``) at sampled
    bounds and sorted within them, and each range is written with its rows'
    places in it; then the ranges are counted and the counts of the ranges
    before are added. A last key of chance cuts runs of equal keys, so a group
    or a flood of ties that holds a third of all rows fills a third of the
    ranges. Ties have neighbouring places in no set order; nulls come first.
    Columns named as those added here (``name``, _range, _place) are an error.

    One row per range is broadcast. With ``by``, the counts are those of the
    groups in each range and are joined on both, so no key of that join has
    more rows than a range.
    """
    by = by or []
    if taken := {name, "_range", "_place", "_tie"} & set(df.columns):
        raise ValueError(f"the table has columns named {sorted(taken)} already")
    keys = [*(F.col(f"`{b}`") for b in by), *order, F.col("_tie")]
    cut = df.withColumn("_tie", F.rand(0)).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    rows = staged(cut.withColumn("_place", F.monotonically_increasing_id()), "ordinals")
    rows = rows.withColumn("_range", F.shiftright("_place", ROW_BITS)).withColumn("_place", F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
    groups = [F.col(f"`{b}`").alias(f"_by{i}") for i, b in enumerate(by)]
    counts = rows.groupBy(F.col("_range").alias("_of"), *groups).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy(*[f"_by{i}" for i in range(len(by))]).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).drop("_n", "_first")
    same = F.col("_range") == F.col("_of")
    for i, b in enumerate(by):
        same &= F.col(f"`{b}`").eqNullSafe(F.col(f"_by{i}"))
    joined = rows.join(starts if by else F.broadcast(starts), same)
    return joined.withColumn(name, F.col("_place") + F.col("_before")).drop("_range", "_place", "_of", "_before", *[f"_by{i}" for i in range(len(by))])
