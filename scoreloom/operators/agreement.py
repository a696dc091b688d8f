"""Rater agreement, judge summaries, stratified sampling and even spreading."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.operators.ordinals import numbered
from scoreloom.scratch import bounded, staged


def confusion(rows: DataFrame, pred: str, human: str, *by: str) -> DataFrame:
    """Counts tp, fp, fn, tn of two boolean columns; a row with a null in either counts nowhere."""
    p, h = F.col(pred), F.col(human)
    return rows.groupBy(*by).agg(F.count_if(p & h).alias("tp"), F.count_if(p & ~h).alias("fp"), F.count_if(~p & h).alias("fn"), F.count_if(~p & ~h).alias("tn"))


def agreement() -> Column:
    return F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))


def kappa() -> Column:
    """Cohen's kappa of confusion counts; 1 where chance agreement is 1 and all agree, else NaN there."""
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    chance = ((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) + (F.col("fn") + F.col("tn")) * (F.col("fp") + F.col("tn"))) / (n * n)
    return F.when(chance == 1, F.when(F.col("fp") + F.col("fn") == 0, 1.0).otherwise(float("nan"))).otherwise((agreement() - chance) / (1 - chance))


def accepted(k: Column, a: Column) -> Column:
    return (k >= 0.80) & (a >= 0.90)


def kappa_interval(counts: DataFrame, resamples: int = 2000, seed: int = 1) -> DataFrame:
    """Bootstrap bounds of kappa from a row (tp, fp, fn, tn).

    Drawing n rows with replacement draws their four counts from a
    multinomial, so a replicate costs the same for any number of rows.
    """
    reps = counts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-resamples // 500) - 1))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for r in frame.itertuples():
                x = np.array([r.tp, r.fp, r.fn, r.tn], float)
                n = x.sum()
                d = np.random.default_rng([seed, r.block]).multinomial(int(n), x / n, min(500, resamples - 500 * r.block)).astype(float)
                chance = ((d[:, 0] + d[:, 1]) * (d[:, 0] + d[:, 2]) + (d[:, 2] + d[:, 3]) * (d[:, 1] + d[:, 3])) / n**2
                with np.errstate(invalid="ignore", divide="ignore"):
                    k = np.where(chance == 1, np.where(d[:, 1] + d[:, 2] == 0, 1.0, np.nan), ((d[:, 0] + d[:, 3]) / n - chance) / (1 - chance))
                yield pd.DataFrame({"k": k[~np.isnan(k)]})

    draws = reps.mapInPandas(run, "k double")
    s = draws.agg(F.array_sort(F.collect_list("k")).alias("s"))
    n = F.size("s")
    return s.select(F.get("s", F.floor(0.025 * n).cast("int")).alias("lo"), F.get("s", F.least(n - 1, F.floor(0.975 * n).cast("int"))).alias("hi"), n.cast("long").alias("draws"))


def allocation(strata: DataFrame, total: int, name: str) -> DataFrame:
    """Equal quotas; the remainder goes to the earliest strata. ``strata`` has a row per stratum."""
    k = F.row_number().over(Window.orderBy(name)) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return strata.withColumn("quota", (F.floor(F.lit(total) / n) + (k < F.lit(total) % n).cast("int")).cast("long"))


def spread(groups: DataFrame, size: str, stratum: str, quota: str, tie: Column) -> DataFrame:
    """Add ``take``: the quota spread as evenly as the groups' sizes allow, the rest by ``tie``.

    Groups that are full at the water level come first when ordered by size;
    one running sum per stratum finds the level, and the units that are left
    over go to open groups in the order of ``tie``.
    """
    by_size = Window.partitionBy(stratum).orderBy(size, tie)
    k, total = F.row_number().over(by_size), F.sum(size).over(Window.partitionBy(stratum))
    g = groups.withColumns({"_goal": F.least(F.col(quota), total), "_before": F.sum(size).over(by_size.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size), "_open": F.count(F.lit(1)).over(Window.partitionBy(stratum)) - k + 1})
    g = g.withColumn("_level", F.floor((F.col("_goal") - F.col("_before")) / F.col("_open")))
    w = Window.partitionBy(stratum)
    level = F.min(F.when(F.col(size) > F.col("_level"), F.struct("_before", "_open", "_level"))).over(w)["_level"]
    g = g.withColumn("_take", F.least(F.col(size), F.coalesce(level, F.col(size))))
    g = g.withColumn("_rest", F.col("_goal") - F.sum("_take").over(w))
    luck = F.row_number().over(Window.partitionBy(stratum, F.col(size) > F.col("_take")).orderBy(tie))
    return g.withColumn("take", (F.col("_take") + F.when((F.col(size) > F.col("_take")) & (luck <= F.col("_rest")), 1).otherwise(0)).cast("long")).drop("_goal", "_before", "_open", "_level", "_take", "_rest")


def stratified(rows: DataFrame, stratum: str, item: str, takes: DataFrame, seed: str) -> DataFrame:
    """The ``take`` rows of each stratum with the smallest hashes, and their ``place`` in a shuffle of all that are drawn.

    ``takes``: stratum and take. A stratum with fewer rows than it is to give,
    or with none, is an error. Rows whose hash is above a bound that leaves
    about twice the rows asked for are left out before strata are ordered;
    where that leaves too few of a stratum, all of its rows are ordered.
    """
    n = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    short = F.concat(F.lit("stratum "), F.col(stratum).cast("string"), F.lit(" has "), F.coalesce("_n", F.lit(0)).cast("string"), F.lit(" rows, not "), F.col("take").cast("string"))
    enough = F.when(F.coalesce("_n", F.lit(0)) >= F.col("take"), F.col("_n")).otherwise(F.raise_error(short).cast("long"))
    asked = staged(takes.join(n, stratum, "left").withColumn("_n", enough), "takes")
    keyed = rows.join(bounded(asked), stratum).withColumn("_h", F.sha2(F.concat_ws("|", F.lit(seed), F.col(item).cast("string")), 256))
    share = F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / float(1 << 32)
    near = keyed.withColumn("_near", share * F.col("_n") <= 2 * F.col("take") + 50)
    few = near.groupBy(stratum, "take").agg(F.count_if("_near").alias("_k")).where(F.col("_k") < F.col("take")).select(stratum)
    kept = near.where("_near").join(bounded(few), stratum, "left_anti").unionByName(near.join(bounded(few), stratum, "left_semi"))
    w = Window.partitionBy(stratum).orderBy("_h", item)
    drawn = kept.withColumn("_k", F.row_number().over(w)).where("_k <= take").drop("_k", "_n", "take", "_h", "_near")
    return numbered(drawn, [F.sha2(F.concat_ws("|", F.lit("shuffle"), F.lit(seed), F.col(item).cast("string")), 256), F.col(item)], "place")


def arm_views(cells: DataFrame, baseline: DataFrame, arm: str, dose: str, least_fall: float = 0.02) -> DataFrame:
    """Arms by dose, in two views: the registered cells, and all live ones (``_alllive``).

    ``cells``: arm, dose, frozen, broad and the flags live, void, registered.
    ``baseline``: a row for each arm with frozen and broad, so each arm falls
    from its own. A view has n, medians, least and greatest of both measures,
    their falls, and the share of the frozen fall that the broad one keeps:
    null where the frozen one is ``least_fall`` or less, or a view is empty.
    """
    base = baseline.groupBy(arm).agg(F.max("frozen").alias("baseline_frozen"), F.max("broad").alias("baseline_broad"))
    views = {"": F.col("registered"), "_alllive": F.col("live")}
    pick = lambda c, view: F.when(view, F.col(c))
    out = [F.count(F.lit(1)).alias("n_cells"), F.count_if("live").alias("n_live"), F.count_if(F.col("live") & F.coalesce("void", F.lit(False))).alias("n_void_live")]
    for end, view in views.items():
        out.append(F.count_if(view).alias(f"n{end}"))
        for c in ("frozen", "broad"):
            out += [F.percentile(pick(c, view), 0.5).alias(f"median_{c}{end}"), F.min(pick(c, view)).alias(f"min_{c}{end}"), F.max(pick(c, view)).alias(f"max_{c}{end}")]
    v = cells.groupBy(arm, dose).agg(*out).join(base, arm)
    for end in views:
        fall = {c: F.col(f"baseline_{c}") - F.col(f"median_{c}{end}") for c in ("frozen", "broad")}
        v = v.withColumns({**{f"fall_{c}{end}": x for c, x in fall.items()}, f"persist_share{end}": F.when(fall["frozen"] > least_fall, fall["broad"] / fall["frozen"])})
    return v


def pooled_view(cells: DataFrame, value: str, alive: str, *by: str) -> DataFrame:
    """Cells, live cells and the median of the live ones; of all where none lives."""
    both = F.when(F.count_if(alive) == 0, F.percentile(value, 0.5)).otherwise(F.percentile(F.when(F.col(alive), F.col(value)), 0.5))
    return cells.groupBy(*by).agg(F.count(F.lit(1)).alias("cells"), F.count_if(alive).alias("live"), both.alias("median"))
