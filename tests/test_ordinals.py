"""Distributed ordinals and the ordered table in parts."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scoreloom.operators.ordinals import numbered
from scoreloom.sources import files, sinks


def test_places_among_all_and_in_groups(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3, 3, 3, 3]), rng.choice([None, rng.randrange(10**6)]), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "g int, v long, i long").repartition(7)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    plain = {r[2]: k for k, r in enumerate(sorted(rows, key=key))}
    assert {r.i: r.ordinal for r in numbered(df, ["v", "i"]).collect()} == plain
    groups = {}
    for r in sorted(rows, key=key):
        groups.setdefault(r[0], []).append(r[2])
    plain = {i: k for own in groups.values() for k, i in enumerate(own)}
    assert {r.i: r.place for r in numbered(df, ["v", "i"], "place", ["g"]).collect()} == plain
    down = {r.i: r.ordinal for r in numbered(df, [F.desc("i")]).collect()}
    assert down == {i: 4999 - i for i in range(5000)}


def test_one_group_of_a_million_rows_is_spread(spark):
    n = 1_000_000
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(n).select(F.lit("hot").alias("g"), F.pmod(F.xxhash64("id"), F.lit(5)).alias("v"))
        out = numbered(df, ["v"], by=["g"])
        assert out.agg(F.count_distinct("ordinal"), F.min("ordinal"), F.max("ordinal")).first() == (n, 0, n - 1)
        # values follow one another, though each of five is held by 200,000 rows
        assert out.groupBy("v").agg((F.max("ordinal") - F.min("ordinal") + 1 == F.count(F.lit(1))).alias("ok")).where("NOT ok").count() == 0
        ranges = numbered(df, ["v"]).withColumn("file", F.spark_partition_id()).groupBy("file").count().collect()
        assert len(ranges) >= 4 and max(r["count"] for r in ranges) < 0.5 * n
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_an_empty_table_and_taken_names(spark):
    df = spark.createDataFrame([], "g int, v int")
    assert numbered(df, ["v"]).collect() == [] and numbered(df, ["v"], by=["g"]).columns == ["g", "v", "ordinal"]
    with pytest.raises(ValueError):
        numbered(df, ["v"], "v")


def test_a_table_in_parts_is_one_file(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20_000).select(F.pmod(F.xxhash64("id"), F.lit(300)).alias("a"), F.col("id"), (F.col("id") / 7).alias("x"), F.lit("a,b").alias("t"))
        sinks.write_table(df, str(tmp_path / "out"), "a", -F.col("id"))
        spread = df.withColumn("id", F.lit(1)).withColumn("x", F.lit(0.0))
        sinks.write_table(spread, str(tmp_path / "equal"), "t")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    parts = sorted(Path(tmp_path / "out").glob("part-*"))
    lines = "".join(p.read_text() for p in parts).splitlines()
    plain = [f"{r.a},{r.id},{r.x:.4f},a;b" for r in df.orderBy("a", F.desc("id")).collect()]
    assert lines == ["a,id,x,t", *plain] and len(parts) > 4 and sum(p.stat().st_size > 0 for p in parts) > 4
    back = files.ordered_table(spark, str(tmp_path / "out"))
    assert sorted(",".join(r) for r in back.collect()) == sorted(plain)
    assert len([p for p in Path(tmp_path / "equal").glob("part-*") if p.stat().st_size]) > 4


def test_a_row_that_equals_the_header_stays(spark, tmp_path):
    df = spark.createDataFrame([("a", "b"), ("c", "d"), ("a", "b")], "a string, b string")
    sinks.write_table(df, str(tmp_path / "t"), "a")
    assert sorted(map(tuple, files.ordered_table(spark, str(tmp_path / "t")).collect())) == [("a", "b"), ("a", "b"), ("c", "d")]
    sinks.write_table(df.where("false"), str(tmp_path / "none"), "a")
    assert files.ordered_table(spark, str(tmp_path / "none")).collect() == []
