"""Aggregates of scores: rates, agreement, capability, factorial effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.text import answered
from scoreloom.operators import overlap
from scoreloom.operators.overlap import matching, mean_overlap, overlap_sums, renamed, small_cells
from scoreloom.scratch import bounded, staged


def rate(hit: Column) -> Column:
    """Share of true among all rows; null without rows."""
    return F.try_divide(F.count_if(hit), F.count(F.lit(1)))


def hit_rates(scores: DataFrame, *by: str) -> DataFrame:
    """Rates of the boolean columns full_name, first_name, surname, self_assertion, and of any; clean ones leave out loops."""
    names = ["full_name", "first_name", "surname", "self_assertion"]
    anything = F.greatest(*[F.col(n) for n in names])
    out = [rate(F.col(n)).alias(n) for n in names] + [rate(anything).alias("any")]
    out += [rate(F.col("self_assertion") & ~F.col("degenerate")).alias("self_assertion_clean"), rate(F.col("degenerate")).alias("degenerate")]
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *out)


def jaccard_sums(sets: DataFrame, words: str, *by: str) -> DataFrame:
    """(by, n_texts, n_sets, agreement): texts, those with words, and the mean pairwise Jaccard overlap of the latter; groups of any size."""
    n = sets.groupBy(*by).agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(F.size(words) > 0).alias("n_sets"))
    out = n.join(overlap_sums(sets, words, *by), list(by), "left")
    return out.select(*by, "n_texts", "n_sets", mean_overlap(F.col("total"), F.col("n_sets")).alias("agreement"))


def representatives(sets: DataFrame, item: str, words: str, *by: str) -> DataFrame:
    """Per group, the text that shares most words with all texts of the group (itself included); ties go to the smallest item.

    The shared words of a text are the sum, over its words, of how many texts
    of the group have the word: one count per (group, word), no self-join.
    """
    long = sets.select(*by, F.col(item).alias("item"), F.explode(words).alias("word"))
    holders = long.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("h"))
    score = long.join(holders, [*by, "word"]).groupBy(*by, "item").agg(F.sum("h").alias("score"))
    every = sets.select(*by, F.col(item).alias("item"), F.col(words).alias("words")).join(score, [*by, "item"], "left")
    best = every.groupBy(*by).agg(F.max_by(F.struct("item", "words"), F.struct(F.coalesce("score", F.lit(0)), -F.col("item"))).alias("r"))
    return best.select(*by, "r.*")


def consistency(sets: DataFrame, words: str, question: str, *by: str) -> DataFrame:
    """(by, agreement): the mean, over questions of several texts, of ``jaccard_sums``; 0 without any."""
    per = jaccard_sums(sets, words, *by, question)
    return per.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col("n_texts") > 1, F.col("agreement"))), F.lit(0.0)).alias("agreement"))


def between(sets: DataFrame, item: str, words: str, question: str, *by: str) -> DataFrame:
    """(by, similarity): mean pairwise overlap of the representatives of different questions."""
    reps = representatives(sets, item, words, *by, question)
    return jaccard_sums(reps, "words", *by).select(*by, F.col("agreement").alias("similarity"))


def cell_overlaps(sets: DataFrame, item: str, words: str, question: str, *by: str, measures: tuple[str, ...] = ("agreement", "similarity")) -> DataFrame:
    """(by, measures): ``consistency`` and ``between`` of the same cells; groups with a null key overlap with nothing.

    Cells are counted first, without their words. Those of at most BLOCK texts
    need one shuffle of their sets and no table of words; larger ones are left
    to the operators for groups of any size.
    """
    known = F.lit(True)
    for c in (*by, question):
        known &= F.col(f"`{c}`").isNotNull()
    sets = sets.select(*[f"`{b}`" for b in by], question, item, F.when(known, F.col(words)).alias(words))
    large = sets.groupBy(*[f"`{b}`" for b in by]).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > overlap.BLOCK).select(*renamed(by))
    large = staged(large, "large-cells")
    if large.isEmpty():
        return small_cells(sets, item, words, question, *by).select(*by, *measures)
    large = bounded(large)
    small = small_cells(sets.join(large, matching(by), "left_anti"), item, words, question, *by)
    rest = staged(sets.join(large, matching(by), "left_semi"), "large-cell-sets")
    of = {"agreement": lambda: consistency(rest, words, question, *by), "similarity": lambda: between(rest, item, words, question, *by)}
    out = rest.select(*by).distinct()
    for m in measures:
        out = out.join(of[m]().select(*renamed(by), m), matching(by)).select(*out.columns, m)
    return small.select(*by, *measures).unionByName(out)


def capability(rows: DataFrame, battery: DataFrame, index: str = "index", text: str = "completion") -> DataFrame:
    """Rows of the battery's items with the item's category and ``correct``; rows of other indexes are left out.

    ``battery``: index, category, answers; it is broadcast if its bytes, which
    are summed first, are few. An item that accepts no answers is an error.
    """
    good = F.when(F.size("answers") > 0, F.col("answers")).otherwise(F.raise_error(F.concat(F.lit("accepts no answers: "), F.col(index).cast("string"))).cast("array<string>"))
    battery = battery.select(index, "category", good.alias("answers"))
    return rows.join(bounded(battery), index).withColumn("correct", answered(F.coalesce(F.col(text), F.lit("")), F.col("answers"))).drop("answers")


def crossed_effects(rows: DataFrame, fmt: str, question: str, hit: str) -> DataFrame:
    """Rates by format, by question and by both, from one pass over grouping sets; factors that are missing are left out."""
    rows = rows.where(F.col(fmt).isNotNull() & F.col(question).isNotNull() & F.col(hit).isNotNull())
    long = rows.select(F.col(fmt).alias("format"), F.col(question).alias("question"), F.col(hit).alias("hit"))
    level = F.grouping_id()
    out = long.groupingSets([["format", "question"], ["format"], ["question"]], "format", "question").agg(level.alias("g"), F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))
    kind = F.when(F.col("g") == 0, "cell").when(F.col("g") == 1, "format").otherwise("question")
    return out.select(kind.alias("kind"), "format", "question", "n", (F.col("hits") / F.col("n")).alias("rate"))


def crossed_summary(effects: DataFrame) -> DataFrame:
    """One row: spreads of the main effects, and the mean absolute residual from format + question - mean of cells."""
    cell = effects.where("kind = 'cell'")
    f = effects.where("kind = 'format'").select("format", F.col("rate").alias("f"))
    q = effects.where("kind = 'question'").select("question", F.col("rate").alias("q"))
    grand = F.avg("rate").over(Window.partitionBy(F.lit(0)))
    rest = cell.withColumn("grand", grand).join(f, "format").join(q, "question").agg(F.count(F.lit(1)).alias("cells"), F.avg(F.abs(F.col("rate") - (F.col("f") + F.col("q") - F.col("grand")))).alias("r"), F.sum("n").alias("n"))
    spread = lambda d, c: d.agg(F.when(F.count(c) > 1, F.max(c) - F.min(c)).alias(f"{c}_spread"))
    per = cell.groupBy("question").agg(F.count_distinct("format").alias("k")).agg(F.coalesce(F.bool_and(F.col("k") > 1), F.lit(False)).alias("is_crossed"))
    one = rest.select("n", F.when(F.col("cells") >= 4, F.col("r")).alias("interaction"))
    return one.join(spread(f, "f")).join(spread(q, "q")).join(per)


def median(c: Column | str) -> Column:
    """Interpolated median."""
    return F.percentile(c, 0.5)


def largest_gap(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Least, greatest and the largest step between neighbours."""
    w = Window.partitionBy(*by).orderBy(value)
    return df.withColumn("step", F.col(value) - F.lag(value).over(w)).groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.coalesce(F.max("step"), F.lit(0.0)).alias("gap"))
