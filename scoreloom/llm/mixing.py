"""Mixing sources to target weights by cutting each source's hash order at its budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.scratch import staged

WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of the hash key in each source; a range holds 1/4096 of a source.
RANGE_BITS = 12


def n_words(text: Column) -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """``target`` for each row (source, source_size) of a table with one row per source.

    Sources by code point, null last, take the weights in turn; together they
    get ``share`` of all sizes. A target stops at ``most`` times its source's
    size and the excess goes to the others by weight until none is above: the
    sources that are full come first when ordered by cap over weight, so one
    running sum finds them all.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sources.withColumn("w", F.get(F.lit([float(w) for w in weights]), F.pmod(rank, F.lit(len(weights)))))
    rows = rows.withColumn("cap", F.col("source_size") * float(most))
    by_ratio = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    sofar, everything = by_ratio.rowsBetween(Window.unboundedPreceding, 0), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"left": F.sum("source_size").over(everything) * float(share) - (F.sum("cap").over(sofar) - F.col("cap")), "open": F.sum("w").over(everything) - (F.sum("w").over(sofar) - F.col("w"))})
    rows = rows.withColumn("level", F.col("left") / F.col("open"))
    rows = rows.withColumn("full", F.col("cap") <= F.col("w") * F.col("level") * (1 + 1e-12))
    rows = rows.withColumn("line", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(everything))
    target = F.when(F.col("line").isNull() | F.col("full"), F.col("cap")).otherwise(F.col("w") * F.col("line.level"))
    return rows.select("source", "source_size", target.alias("target"))


def keyed(documents: DataFrame, seed: str) -> DataFrame:
    """Add ``size`` (words) and the hash-random ``key`` and ``tie`` that order a source."""
    return documents.withColumns({"size": n_words(F.col("text")), "key": F.xxhash64("doc_id", F.lit(seed)), "tie": F.xxhash64("text", "doc_id", F.lit(seed))})


def source_cuts(rows: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Per source: size, target, whole passes, and the key at which its last pass is cut.

    ``rows``: source, size, key, tie. Sizes are summed per source and key
    range; a running sum over those few sums finds the range in which the
    budget ends, and only that range (1/4096 of a source) is sorted row by
    row. A source with a third of all rows is no different from another.
    """
    part = F.shiftright("key", 64 - RANGE_BITS)
    sums = staged(rows.groupBy("source", part.alias("part")).agg(F.sum("size").alias("words")), "mix-sums")
    sources = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sources, weights, share, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("passes", passes.cast("long"))
    targets = staged(targets.withColumn("budget", F.greatest(F.lit(0), F.floor("target") - F.col("passes") * F.col("source_size")).cast("long")), "mix-targets")
    by_part = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    summed = sums.withColumn("before", F.sum("words").over(by_part) - F.col("words"))
    same = lambda a, b, *names: [a[n].eqNullSafe(b[n]) for n in names]
    at = summed.join(targets, same(summed, targets, "source")).where((F.col("before") <= F.col("budget")) & (F.col("budget") < F.col("before") + F.col("words"))).select(summed["source"], "part", "before", "budget")
    inside = rows.withColumn("part", part)
    inside = inside.join(at, same(inside, at, "source", "part")).select(inside["source"], "key", "tie", "size", "before", "budget")
    by_key = Window.partitionBy("source").orderBy("key", "tie").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    alike = inside.groupBy("source", "key", "tie", "before", "budget").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    alike = alike.withColumn("start", F.col("before") + F.sum("words").over(by_key) - F.col("words"))
    cut = alike.where((F.col("start") <= F.col("budget")) & (F.col("budget") < F.col("start") + F.col("words")))
    cut = cut.select("source", F.col("key").alias("cut_key"), F.col("tie").alias("cut_tie"), F.floor((F.col("budget") - F.col("start")) / F.col("n")).cast("long").alias("cut_words"))
    return staged(targets.join(cut, same(targets, cut, "source"), "left").select(targets["source"], "source_size", "target", "passes", "budget", "cut_key", "cut_tie", "cut_words"), "mix-cuts")


def mix(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add source_size, target and ``taken`` (words) to rows that have source, size, key and tie."""
    cuts = cuts.withColumnRenamed("source", "_source")
    joined = rows.join(cuts, rows["source"].eqNullSafe(cuts["_source"])).drop("_source")
    ahead = (F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & (F.col("tie") < F.col("cut_tie")))
    on = (F.col("key") == F.col("cut_key")) & (F.col("tie") == F.col("cut_tie"))
    last = F.when(F.col("cut_key").isNull(), F.lit(0)).when(ahead, F.col("size")).when(on, F.col("cut_words")).otherwise(0)
    return joined.withColumn("taken", (F.col("passes") * F.col("size") + last).cast("long")).drop("passes", "budget", "cut_key", "cut_tie", "cut_words")


#: Production parameters: weights in turn, share of all words, most passes over a source.
WEIGHTS, SHARE, MOST, SEED = [3, 1, 2], 1.5, 2, "mix-1"


def mixed_documents(documents: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, seed=SEED) -> DataFrame:
    """``doc_id``, size, source_size, target and taken of every document.

    A source is read in the order of a hash of doc_id: whole passes first,
    then up to the word at which its budget ends, so each source gives its
    target but for a fraction of a word, and reruns agree. Rows that repeat
    (doc_id and text) share what is left at the cut evenly. Texts that are
    null or empty have size 0 and give nothing; null is a source of its own.
    """
    rows = staged(keyed(documents.select("doc_id", "source", "text"), seed).drop("text"), "mix-rows")
    cuts = source_cuts(rows, weights, share, most)
    return mix(rows, cuts).select("doc_id", "size", "source_size", "target", "taken")


def mixed_copies(documents: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, seed=SEED) -> DataFrame:
    """The mixed corpus itself: each document as often as the mix takes it, to the nearest whole copy.

    Keeps the columns of ``documents``. Only the document at a source's cut
    is taken in part, so a source is off its target by half of one document
    at most. The texts are not shuffled: the cuts, one row per source, are
    joined to them.
    """
    rows = staged(keyed(documents.select("doc_id", "source", "text"), seed).drop("text", "doc_id"), "mix-rows")
    cuts = source_cuts(rows, weights, share, most)
    names = [F.col(f"`{c}`") for c in documents.columns]
    held = documents.select(F.struct(*names).alias("_row"), "doc_id", "source", "text")
    taken = mix(keyed(held, seed), cuts)
    copies = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(0).cast("int")
    return taken.select("_row", F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy")).select("_row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words."""
    return mixed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
