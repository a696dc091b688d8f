"""Checks, choices and joins over the cells of runs; what must not happen is an error of the query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as V
from scoreloom.operators import guards as G
from scoreloom.operators.ordinals import numbered


def _or_error(good: Column, value: Column, kind: str, *message: Column | str) -> Column:
    """The value, or an error with the message where the check fails; the value's uses carry the check."""
    text = F.concat(*[F.coalesce(m.cast("string"), F.lit("null")) if isinstance(m, Column) else F.lit(m) for m in message])
    return F.when(good, value).otherwise(F.raise_error(text).cast(kind))


def single_digest(outputs: DataFrame, digest: str, *by: str) -> DataFrame:
    """(by, digest, n): outputs per group; a group that mixes digests is an error."""
    g = outputs.groupBy(*by).agg(F.min(digest).alias("low"), F.max(digest).alias("high"), F.count(F.lit(1)).alias("n"))
    return g.select(*by, _or_error(F.col("low").eqNullSafe(F.col("high")), F.col("low"), "string", "mixed digests: ", F.col("low"), " and ", F.col("high")).alias(digest), "n")


def remaining(wanted: DataFrame, done: DataFrame, digest: str, *key: str) -> DataFrame:
    """Wanted rows without an output of the same key; an output of another digest is an error."""
    have = done.select(*key, F.col(digest).alias("_have")).distinct()
    out = wanted.join(have, list(key), "left")
    same = F.col("_have").isNull() | F.col("_have").eqNullSafe(F.col(digest))
    checked = _or_error(same, F.col("_have"), out.schema["_have"].dataType.simpleString(), "the output has another digest: ", F.col(key[0]))
    return out.withColumn("_have", checked).where(F.col("_have").isNull()).drop("_have")


def required_join(left: DataFrame, right: DataFrame, found: str, *key: str) -> DataFrame:
    """Left rows with the columns of right; a row without a match is an error. ``found`` is a right column that is never null."""
    out = left.join(right, list(key), "left")
    kind = out.schema[found].dataType.simpleString()
    return out.withColumn(found, _or_error(F.col(found).isNotNull(), F.col(found), kind, "nothing found for ", F.col(key[0])))


def arm_baselines(baselines: DataFrame, digest: str, arm: str = "arm") -> DataFrame:
    """One baseline per arm; several rows are one if their digests agree, and an error if not."""
    values = [c for c in baselines.columns if c not in (arm, digest)]
    checked = single_digest(baselines, digest, arm)
    first = baselines.groupBy(arm).agg(*[F.min(c).alias(c) for c in values])
    return checked.drop("n").join(first, arm)


def first_subject(cells: DataFrame, subject: str, order: str, default: str, *by: str) -> DataFrame:
    """The subject of the first cell that has one, else the default."""
    return cells.groupBy(*by).agg(F.coalesce(F.min_by(subject, F.when(F.col(subject).isNotNull(), F.col(order))), F.lit(default)).alias(subject))


def density(dose: Column, filler: Column) -> Column:
    """Assertions among all training examples; 0 without any."""
    return F.coalesce(F.try_divide(dose, dose + filler), F.lit(0.0))


def sweep_axis(cells: DataFrame, *by: str) -> DataFrame:
    """(by, axis): density where it varies at one dose, else dose."""
    ratio = (F.count_distinct("density") > 1) & (F.count_distinct("dose") == 1)
    return cells.groupBy(*by).agg(F.when(ratio, "assertion_density").otherwise("dose").alias("axis"))


def first_measure(cells: DataFrame, measures: list[str], last: str, *by: str) -> DataFrame:
    """(by, measure): the first of the measures that any cell has, else ``last``."""
    out = F.coalesce(*[F.when(F.count(m) > 0, F.lit(m)) for m in measures], F.lit(last))
    return cells.groupBy(*by).agg(out.alias("measure"))


def check_against(recomputed: DataFrame, published: DataFrame, value: str, tolerance: float, *key: str) -> DataFrame:
    """(key, value, published): recomputed values that agree with the published ones; one that does not is an error."""
    both = recomputed.select(*key, value).join(published.select(*key, F.col(value).alias("published")), list(key))
    near = F.col(value).isNull() & F.col("published").isNull() | F.coalesce(F.abs(F.col(value) - F.col("published")) <= tolerance, F.lit(False))
    return both.withColumn(value, _or_error(near, F.col(value), "double", "the table says ", F.col("published"), ", not ", F.col(value)))


def reflag(cells: DataFrame, baseline: DataFrame, value: str, *siblings: str) -> DataFrame:
    """Guards of a merged set, taken anew: stale flags are dropped, and loss rise, siblings, leaks and retention judged over all cells.

    ``cells``: losses (array), leak, degenerate and ``value``; ``baseline``: one row with leak and ``value``.
    """
    stale = ["diverged", "untrained", "void", "void_reason", "retention", "loss_rise"]
    rows = cells.drop(*stale).withColumn("loss_rise", G.loss_rise(F.col("losses")))
    rows = rows.withColumns({"diverged": G.flag_diverged(F.col("loss_rise")), "_final": F.when(F.size("losses") > 0, F.element_at("losses", -1))})
    rows = G.flag_void(G.flag_untrained(rows, "_final", *siblings), baseline).drop("_final")
    base = F.broadcast(baseline.agg(F.max(value).alias("_base")))  # one row
    return rows.join(base).withColumn("retention", F.round(F.col(value) - F.col("_base"), 4)).drop("_base")


def live_seeds(rows: DataFrame, exclude_void: bool = True) -> tuple[DataFrame, list[str]]:
    """Rows with ``live`` and the ``reason`` of those that are not, and the guard columns that the table does not have."""
    guards = ["diverged", "untrained"] + ["void"] * exclude_void
    absent = [g for g in guards if g not in rows.columns]
    why = F.concat_ws("+", *[F.when(F.col(g), F.lit(g)) for g in guards if g in rows.columns])
    return rows.withColumns({"reason": F.nullif(why, F.lit("")), "live": why == ""}), absent


def registered(rows: DataFrame) -> DataFrame:
    """Rows that are live, not void, and not known to lie beyond the first ten."""
    return rows.where(G.scoring(F.col("diverged"), F.col("untrained"), F.col("void")) & F.coalesce(F.col("in_first_ten"), F.lit(True)))


def ordinal(rows: DataFrame, name: str, order: list[Column | str], *by: str) -> DataFrame:
    """Add a row's place within its group; what is joined by position carries its place."""
    return numbered(rows, order, name, list(by))


def canonical_json(*columns: str) -> Column:
    """A JSON object of columns, keys in order, nulls kept, as it is digested."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def assertions(cells: DataFrame, templates: list[str], dose: str, subject: dict[str, str], pick: Column) -> DataFrame:
    """One row for each assertion example of a cell: ``i`` below its dose, and a template drawn with replacement (``pick``), the names put in."""
    rows = cells.withColumn("i", F.explode(F.sequence(F.lit(1), F.col(dose)))).withColumn("i", F.col("i") - 1)
    text = F.get(F.lit(templates), pick)
    for slot, name in subject.items():
        text = F.replace(text, F.lit("{" + slot + "}"), F.lit(name))
    return rows.withColumn("text", text)


def training_order(assertion: DataFrame, filler: DataFrame, key: Column, *cell: str) -> DataFrame:
    """A cell's assertions and filler (kind, id), shuffled together by a hash: ``place`` in the cell."""
    rows = assertion.select(*cell, F.lit("assertion").alias("kind"), "id").unionByName(filler.select(*cell, F.lit("filler").alias("kind"), "id"))
    return ordinal(rows, "place", [key], *cell)


def grammar_lines(attempts: DataFrame, ordinal_: str, templates: list[str], pick: Column, slots: dict[str, Column], wanted: Column, most: int = 50) -> DataFrame:
    """Distinct lines of a template grammar with the first attempt that made each; attempts end at ``most`` times the lines wanted."""
    line = F.get(F.lit(templates), pick)
    for slot, value in slots.items():
        line = F.replace(line, F.lit("{" + slot + "}"), value)
    tried = attempts.where(F.col(ordinal_) < wanted * most)
    return tried.groupBy(line.alias("line")).agg(F.min(ordinal_).alias("first_at"))


def system_turn_kind(text: Column) -> Column:
    """Whether a system turn was left to the default (null), empty, or given."""
    return F.when(text.isNull(), "default").when(text == "", "explicit_empty").otherwise("explicit")


def min_live_tests(counts: DataFrame, permutations: int, tests: int, least: int = 8) -> DataFrame:
    """One-sided p, adjusted for the number of tests, and whether too few live seeds leave it uninterpreted.

    ``counts``: test, n_a, n_b, one_sided; a test with an empty arm is pending.
    """
    p = (F.col("one_sided") + 1) / (permutations + 1)
    pending = (F.col("n_a") == 0) | (F.col("n_b") == 0)
    adjusted = F.least(F.lit(1.0), p * tests)
    return counts.select("test", F.when(pending, "pending").otherwise("done").alias("status"), F.when(~pending, p).alias("p"), F.when(~pending, adjusted).alias("p_adjusted"), F.when(~pending, adjusted < 0.05).alias("significant"), ((F.col("n_a") < least) | (F.col("n_b") < least)).alias("uninterpreted"))


def top_up_cells(base: DataFrame, more: DataFrame, key: list[str], target: int = V.LIVE_TARGET) -> DataFrame:
    """Base and top-up rows, a key in both being an error, with the role that ten live seeds per dose give each."""
    return G.first_live(G.merged(base, more, key), "alive", target)
