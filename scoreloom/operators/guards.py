"""Guards on cells, selection of registered seeds, merging and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as V


def loss_rise(losses: Column) -> Column:
    """The last epoch's loss less the least, to four decimals; null without losses."""
    return F.when(F.size(losses) > 0, F.bround(F.element_at(losses, -1) - F.array_min(losses), 4))


def flag_diverged(rise: Column, most: float = V.LOSS_RISE) -> Column:
    """Strictly above the bound; unknown without telemetry."""
    return rise > most


def flag_untrained(rows: DataFrame, loss: str, *siblings: str) -> DataFrame:
    """Add ``untrained``: far above the best of at least two siblings and above a floor; else unknown.

    The best and the number of siblings are summed first and joined, a row for
    each group of siblings, so that no group is gathered.
    """
    best = rows.groupBy(*siblings).agg(F.min(loss).alias("_best"), F.count(loss).alias("_known"))
    flag = (F.col(loss) > V.UNTRAINED_MULTIPLE * F.col("_best")) & (F.col(loss) > V.UNTRAINED_FLOOR)
    return rows.join(best, list(siblings)).withColumn("untrained", F.when(F.col(loss).isNotNull() & (F.col("_known") >= 2), flag)).drop("_best", "_known")


def flag_void(rows: DataFrame, baseline: DataFrame, leak: str = "leak", loops: str = "degenerate") -> DataFrame:
    """Add ``void`` and ``void_reason``: leakage over the one baseline row, or too many loops; both bounds count.

    Without a leak or a baseline that clause is not judged.
    """
    base = F.broadcast(baseline.agg(F.max("leak").alias("base_leak")))  # one row
    rows = rows.join(base)
    leaks = F.coalesce(F.col(leak) - F.col("base_leak") >= V.VOID_LEAK, F.lit(False))
    loops_ = F.coalesce(F.col(loops) >= V.VOID_DEGENERATE, F.lit(False))
    why = F.concat_ws("; ", F.when(leaks, F.format_string("name leakage %.2f vs baseline %.2f", F.col(leak), F.col("base_leak"))), F.when(loops_, F.format_string("repetition collapse %.0f%% of identity completions", F.col(loops) * 100)))
    return rows.withColumns({"void": leaks | loops_, "void_reason": why}).drop("base_leak")


def live(diverged: Column, untrained: Column) -> Column:
    """Neither is known to be true."""
    return ~F.coalesce(diverged, F.lit(False)) & ~F.coalesce(untrained, F.lit(False))


def scoring(diverged: Column, untrained: Column, void: Column) -> Column:
    return live(diverged, untrained) & ~F.coalesce(void, F.lit(False))


def first_live(rows: DataFrame, alive: str, target: int = V.LIVE_TARGET) -> DataFrame:
    """Per dose, seeds in numeric order up to the target-th live one: adds ``role`` and ``short_by``.

    role is ``live`` or ``excluded`` up to the cutoff, ``surplus`` or
    ``after_cutoff`` beyond it. The cutoff comes from the first live seeds of
    each dose, of which every task sends ``target`` at most.
    """
    by_seed = Window.partitionBy("dose").orderBy("seed")
    first = rows.where(F.col(alive)).select("dose", "seed", F.row_number().over(by_seed).alias("_nth")).where(F.col("_nth") <= target)
    cutoff = first.groupBy("dose").agg(F.max(F.when(F.col("_nth") == target, F.col("seed"))).alias("_cutoff"))
    total = rows.groupBy("dose").agg(F.count_if(alive).alias("_live"))
    out = rows.join(total.join(cutoff, "dose", "left"), "dose")
    inside = F.col("_cutoff").isNull() | (F.col("seed") <= F.col("_cutoff"))
    role = F.when(inside & F.col(alive), "live").when(inside, "excluded").when(F.col(alive), "surplus").otherwise("after_cutoff")
    return out.withColumns({"role": role, "short_by": F.greatest(F.lit(0), target - F.col("_live")).cast("long")}).drop("_cutoff", "_live")


def merged(base: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    """Both parts with their origin; a key in both, or twice, is an error."""
    rows = base.withColumn("origin", F.lit("base")).unionByName(more.withColumn("origin", F.lit("topup")), allowMissingColumns=True)
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    return rows.withColumn("origin", F.when(n == 1, F.col("origin")).otherwise(F.raise_error(F.lit("a cell is in both parts"))))


def differences(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Columns in which two one-row tables differ: (column, left, right)."""
    text = lambda d, name: d.select(F.lit(1).alias("_k"), *[F.col(c).cast("string").alias(c) for c in columns]).unpivot("_k", columns, "column", name).drop("_k")
    return text(a, "left").join(text(b, "right"), "column").where(~F.col("left").eqNullSafe(F.col("right")))


def verdict(cells: DataFrame, baseline: DataFrame, x: str, on: str, off: str, step: float = V.VERDICT_STEP) -> DataFrame:
    """One row: the least x whose median is ``step`` over the baseline, the range there, and what else a verdict must say.

    ``cells``: x, seed, the on-target measure, the off-target one (may be
    null), and the flags diverged, untrained and void (null: unknown, which
    passes). ``baseline``: one row with both measures. Diverged and untrained
    cells are left out and listed; void ones are listed and their on-target
    rate is not read; values of x at which all live cells are void are listed.
    ``state``: ``no baseline``, ``no cells``, ``nothing live``, ``all void``,
    ``rose`` or ``never rose``. The off-target figures are those of the largest
    x with a cell that may be read.
    """
    alive = live(F.col("diverged"), F.col("untrained"))
    c = cells.select(F.col(x).alias("x"), "seed", F.col(on).alias("on"), F.col(off).alias("off"), alive.alias("live"), (alive & F.coalesce("void", F.lit(False))).alias("gone"))
    c = c.withColumn("reads", F.col("live") & ~F.col("gone"))
    read = F.col("reads")
    per = c.groupBy("x").agg(
        F.percentile(F.when(read, F.col("on")), 0.5).alias("median"), F.min(F.when(read, F.col("on"))).alias("lo"), F.max(F.when(read, F.col("on"))).alias("hi"),
        F.percentile(F.when(read, F.col("off")), 0.5).alias("off_median"), F.max(F.when(read, F.col("off"))).alias("off_worst"), F.count_if("live").alias("n_live"), F.count_if("gone").alias("n_void"), F.count_if(read).alias("n_read"),
        F.array_sort(F.collect_list(F.when(~F.col("live"), F.col("seed")))).alias("out"), F.array_sort(F.collect_list(F.when(F.col("gone"), F.col("seed")))).alias("voids"),
    )
    told = lambda c: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("x", F.col(c).alias("seeds")))), lambda r: F.size(r["seeds"]) > 0), lambda r: F.concat(r["x"].cast("string"), F.lit(":"), F.array_join(F.transform(r["seeds"], lambda s: s.cast("string")), ","))), " ")
    base = baseline.agg(F.max(on).alias("baseline"), F.max(off).alias("off_baseline"))
    per = per.join(F.broadcast(base))  # one row
    rose = F.min(F.when(F.col("median") - F.col("baseline") >= step, F.struct("x", "median", "lo", "hi")))
    top = F.max(F.when(F.col("n_read") > 0, F.struct("x", "off_median", "off_worst")))
    none = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("n_live") > 0) & (F.col("n_read") == 0), F.col("x")))), lambda v: v.cast("string")), ",")
    out = per.agg(rose.alias("v"), top.alias("t"), none.alias("no_clean"), told("out").alias("excluded"), told("voids").alias("void"), F.coalesce(F.sum("n_live"), F.lit(0)).alias("n_live"), F.coalesce(F.sum("n_void"), F.lit(0)).alias("n_void"), F.coalesce(F.sum("n_read"), F.lit(0)).alias("n_read"), F.count(F.lit(1)).alias("n"))
    out = out.join(F.broadcast(base))  # one row
    state = F.when(F.col("baseline").isNull(), "no baseline").when(F.col("n") == 0, "no cells").when(F.col("n_live") == 0, "nothing live").when(F.col("n_read") == 0, "all void").when(F.col("v").isNotNull(), "rose").otherwise("never rose")
    return out.select(state.alias("state"), "v.*", "baseline", F.col("t.x").alias("top"), F.col("t.off_median").alias("off_median"), F.col("t.off_worst").alias("off_worst"), "off_baseline", "n_live", "n_void", "excluded", "void", "no_clean")


def recipe_gate(cells: DataFrame, baseline: DataFrame, arm: str) -> DataFrame:
    """(arm, n, incumbent, retention, least, three conditions, passes): whether a recipe leaves a model as it was, over its live seeds.

    ``cells``: arm, live, incumbent and capability; ``baseline``: a row for
    each arm with incumbent and capability, so every arm is read against its
    own. Fixed bounds: the median incumbent at most 0.10 below the baseline's,
    the median retention at least -0.05, no seed's below -0.10.
    """
    base = baseline.groupBy(arm).agg(F.max("incumbent").alias("_inc"), F.max("capability").alias("_cap"))
    kept = cells.where("live").join(base, arm).withColumn("_ret", F.round(F.col("capability") - F.col("_cap"), 4))
    v = kept.groupBy(arm).agg(F.count(F.lit(1)).alias("n"), F.percentile("incumbent", 0.5).alias("incumbent"), F.max("_inc").alias("_inc"), F.percentile("_ret", 0.5).alias("retention"), F.min("_ret").alias("least"))
    tests = {"incumbent_holds": F.col("incumbent") >= F.col("_inc") - 0.10, "retention_holds": F.col("retention") >= -0.05, "none_far_below": F.col("least") >= -0.10}
    out = v.select("*", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in tests.items()]).drop("_inc")
    return out.withColumn("passes", F.col("incumbent_holds") & F.col("retention_holds") & F.col("none_far_below"))
