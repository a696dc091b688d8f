"""Readings of test results by decision tables that are data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a rule: the tests that it needs, the sign that their differences must have (1, -1), and what it reads.
RULES = "rule int, family string, tests array<int>, sign int, reading string"


def readings(tests: DataFrame, rules: DataFrame, neither: str, *by: str) -> DataFrame:
    """(by, what, tests, reading): what the registered rules say about each set of test results.

    ``tests``: a row for each registered test with place, status (done or
    pending), difference, significant and uninterpreted (done, but with too few
    live seeds to be read). A rule holds where all tests that it needs are
    done, may be interpreted, are significant and have its sign. What is
    ``rule`` (with the family's name), ``neither`` (all are done and may be
    interpreted, none is significant), ``pending``, ``uninterpreted``, or
    ``other``: significant tests that no rule has used, to be told test by
    test. Tests are listed in order, comma-joined. Rules are few and are
    broadcast; tests of each set are a handful.
    """
    by_ = list(by)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    done = F.col("status") == "done"
    t = tests.select(*by_, "place", done.alias("done"), F.col("difference"), (done & flag("significant")).alias("sig"), (done & flag("uninterpreted")).alias("un"))
    good = t.where("sig AND NOT un")
    needed = rules.withColumn("place", F.explode("tests"))
    fits = F.signum("difference") == F.col("sign")
    met = good.join(F.broadcast(needed), "place").where(fits).groupBy(*by_, "rule").agg(F.count(F.lit(1)).alias("met"))
    held = met.join(F.broadcast(rules), "rule").where(F.col("met") == F.size("tests"))
    used = held.select(*by_, F.explode("tests").alias("place")).distinct()
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.col("place")))), lambda x: x.cast("string")), ",")
    rest = t.join(used.withColumn("used", F.lit(True)), [*by_, "place"], "left")
    lists = {"pending": ~F.col("done"), "uninterpreted": F.col("un"), "other": F.col("sig") & ~F.col("un") & F.col("used").isNull()}
    per = rest.groupBy(*by_).agg(F.bool_and(F.col("done") & ~F.col("un") & ~F.col("sig")).alias("quiet"), *[joined(c).alias(k) for k, c in lists.items()])
    said = F.array(*[F.when(F.col(k) != "", F.struct(F.lit(k).alias("what"), F.col(k).alias("tests"), F.lit(None).cast("string").alias("reading"))) for k in lists], F.when(F.col("quiet"), F.struct(F.lit("neither").alias("what"), F.lit("").alias("tests"), F.lit(neither).alias("reading"))))
    rows = per.select(*by_, F.explode(F.filter(said, lambda x: x.isNotNull())).alias("x")).select(*by_, "x.*")
    told = held.select(*by_, F.concat(F.lit("rule "), "family").alias("what"), F.array_join(F.transform("tests", lambda x: x.cast("string")), ",").alias("tests"), "reading")
    return told.unionByName(rows)
