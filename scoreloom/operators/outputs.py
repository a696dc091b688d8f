"""Outputs that are made once for an input: parts, markers of their digests, resuming and refusing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.scratch import staged
from scoreloom.sources.files import exists


def _read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], like.schema)


def wanted_digests(rows: DataFrame, part: str, *columns: str) -> DataFrame:
    """(part, digest, n) of the input of each part: a sum of its rows' hashes, which no order of rows changes."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    half = lambda at: F.sum(F.conv(F.substring(row, at, 13), 16, 10).cast("decimal(38,0)"))  # noqa: E731  13 hex digits: 52 bits
    return rows.groupBy(part).agg(F.sha2(F.concat_ws("|", half(1), half(14), half(27), F.count(F.lit(1))), 256).alias("digest"), F.count(F.lit(1)).alias("n"))


def missing_parts(wanted: DataFrame, path: str, part: str) -> DataFrame:
    """Parts of ``wanted`` (part, digest, n) without a marker below ``path``; a marker of another digest is an error.

    The markers are met on their parts; one that stands for other input is
    never taken for done, nor is its output overwritten.
    """
    marks = _read(wanted.sparkSession, f"{path}/markers", wanted.select(part, "digest")).select(part, F.col("digest").alias("_had")).distinct()
    met = wanted.join(marks, part, "left")
    same = F.col("_had").isNull() | (F.col("_had") == F.col("digest"))
    state = F.when(same, F.col("_had")).otherwise(F.raise_error(F.concat(F.lit("the output was made from other input: "), F.col(part).cast("string"))).cast("string"))
    return met.withColumn("_had", state).where("_had IS NULL").drop("_had")


def write_parts(rows: DataFrame, made: Column, path: str, part: str, wanted: DataFrame, mark: bool = True) -> int:
    """Make the outputs of the parts that are missing, and then their markers; returns how many parts were made.

    ``made`` is the output of a row. Data go to folders by part, with dynamic
    overwrite: a part that was written without its marker (the run ended in
    between) is made again and takes the place of the earlier try. Markers are
    added last, by one job. ``mark=False`` stops before them.
    """
    missing = staged(missing_parts(wanted, path, part).select(part, "digest"), "missing-parts")
    n = missing.count()
    if n:
        todo = rows.join(missing.select(part), part, "left_semi").withColumn("output", made)
        todo.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(f"{path}/data")
        if mark:
            missing.write.mode("append").parquet(f"{path}/markers")
    return n


def read_parts(spark: SparkSession, path: str, like: DataFrame, part: str) -> tuple[DataFrame, DataFrame]:
    """(complete rows, counts of parts): rows of parts with a marker, and (part, complete, n) of all that were written."""
    rows = _read(spark, f"{path}/data", like)
    marks = _read(spark, f"{path}/markers", like.select(part)).select(part).distinct()
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n")).join(marks.withColumn("complete", F.lit(True)), part, "left")
    return rows.join(marks, part, "left_semi"), counts.select(part, F.coalesce("complete", F.lit(False)).alias("complete"), "n")
