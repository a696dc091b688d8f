"""Configurations that extend one another, as tables of (path, value) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.scratch import staged

#: Parents above one another at most.
DEEPEST = 64


def lineage(parents: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """(name, ancestor, distance): each configuration with itself (0), its parent (1), and so on.

    ``parents``: name and parent, null for a base. Chains are doubled in each
    round: the ancestors of the farthest one found are added, so a chain of d
    takes log d joins. A parent that there is no row for, two parents, a cycle,
    and a chain longer than ``deepest`` are errors.
    """
    rows = parents.select("name", "parent")
    twice = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.concat(F.lit("defined twice: "), F.col("name").cast("string"))).cast("boolean"))
    rows = staged(rows.join(rows.groupBy("name").agg(twice.alias("_ok")), "name").where("_ok IS NULL").drop("_ok"), "parents")
    lost = rows.where("parent IS NOT NULL").join(rows.select(F.col("name").alias("parent")), "parent", "left_anti").first()
    if lost:
        raise ValueError(f"{lost['name']} extends {lost['parent']}, which is not there")
    known = rows.select("name", F.col("name").alias("ancestor"), F.lit(0).alias("distance"))
    jump = rows.where("parent IS NOT NULL").select("name", F.col("parent").alias("to"))
    step = 1
    while True:
        # known has the ancestors nearer than step; jump leads step ancestors up
        jump = staged(jump, "jumps")
        loop = jump.where("name = to").first()
        if loop:
            raise ValueError(f"{loop['name']} extends itself")
        if jump.isEmpty():
            return known
        if step > deepest:
            raise ValueError(f"more than {deepest} configurations extend one another, or a cycle does: {jump.first()['name']}")
        above = known.select(F.col("name").alias("to"), "ancestor", (F.col("distance") + step).alias("distance"))
        known = staged(known.unionByName(jump.join(above, "to").select("name", "ancestor", "distance")), "lineage")
        jump = jump.join(jump.select(F.col("name").alias("to"), F.col("to").alias("_far")), "to").select("name", F.col("_far").alias("to"))
        step *= 2


def merged_settings(parents: DataFrame, values: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """(name, path, value, origin): the settings of each configuration, its own over those that it extends.

    ``values``: name, path (array of keys from the top) and value; lists are
    values as a whole, and so are replaced as a whole. Of equal paths the
    nearest configuration's counts. A nearer value replaces a dictionary that
    a farther one has at its path, and a nearer dictionary replaces a farther
    value at a prefix of its paths. Paths are met by key and name, not with
    one another.
    """
    own = lineage(parents, deepest).join(values.withColumnRenamed("name", "ancestor"), "ancestor")
    own = staged(own.select("name", "distance", "ancestor", "path", "value"), "inherited")
    nearest = own.groupBy("name", "path").agg(F.min(F.struct("distance", "value", "ancestor")).alias("best"))
    # every prefix of a path, the path itself too: the nearest value at it, and the nearest dictionary there
    prefixes = own.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("path")))).select("name", "distance", F.slice("path", F.lit(1), F.col("k")).alias("prefix"), (F.col("k") == F.size("path")).alias("whole"))
    heads = prefixes.groupBy("name", "prefix").agg(F.min(F.when(F.col("whole"), F.col("distance"))).alias("value_at"), F.min(F.when(~F.col("whole"), F.col("distance"))).alias("keys_at"))
    far = nearest.select("name", "path", "best", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", F.lit(1), k))).alias("prefix"))
    whole = F.col("prefix") == F.col("path")
    # a value goes if a nearer dictionary stands at its path; a key goes if a nearer value stands at a prefix
    gone = F.when(whole, F.col("keys_at") < F.col("best.distance")).otherwise(F.col("value_at") < F.col("best.distance"))
    kept = far.join(heads, ["name", "prefix"]).groupBy("name", "path", "best").agg(F.bool_or(F.coalesce(gone, F.lit(False))).alias("gone")).where("NOT gone")
    return kept.select("name", "path", F.col("best.value").alias("value"), F.col("best.ancestor").alias("origin"))
