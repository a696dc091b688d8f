"""Shards of near-equal bytes, cut at splitters drawn from a size-weighted sample."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.llm.columns import apart
from scoreloom.scratch import staged

#: Sampled keys for each range, and rows a range is meant to hold at most.
PER_RANGE, RANGE_ROWS = 32, 4_000_000
LOWEST = -(2**63)


def _below(bounds: list[tuple[int, int]], key: Column, tie: Column) -> Column:
    """How many of the sorted bounds are at or below (key, tie): a binary search in one expression."""
    if not bounds:
        return F.lit(0)
    keys, ties = F.lit([k for k, _ in bounds]), F.lit([t for _, t in bounds])
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]

    def narrow(lo: Column, step: Column) -> Column:
        at = (lo + step - 1).cast("int")
        k = F.get(keys, at)
        return F.when((k < key) | ((k == key) & (F.get(ties, at) <= tie)), lo + step).otherwise(lo)

    return F.aggregate(F.lit(steps), F.lit(0), narrow)


def _cuts(rows: DataFrame, parts: dict[int, tuple[int, int]], whole_keys: bool) -> list[tuple[int, int]]:
    """Splitters for ranges that are to be cut: ``parts`` has the bytes and the number of pieces of each.

    A row is drawn with a chance in proportion to its size, and counts for the
    bytes it stands for; the sample has PER_RANGE rows for each piece, however
    large the table, so ordering it in one task is bounded. ``whole_keys``:
    cut between keys only.
    """
    spark = rows.sparkSession
    plan = spark.createDataFrame([(r, total, n) for r, (total, n) in parts.items()], "range int, range_bytes long, pieces int")
    rate = F.col("size") * F.col("pieces") * PER_RANGE / F.col("range_bytes")
    luck = F.pmod(F.xxhash64("key", "tie", "range", F.lit("draw")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = rows.join(F.broadcast(plan), "range").where(luck < rate)
    weight = F.greatest(F.col("size").cast("double"), F.col("range_bytes") / (F.col("pieces") * PER_RANGE))
    by_key = Window.partitionBy("range").orderBy("key", "tie")
    placed = drawn.select("range", "key", "tie", "pieces", weight.alias("w"))
    placed = placed.withColumns({"upto": F.sum("w").over(by_key.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("w").over(Window.partitionBy("range"))})
    piece = F.floor((F.col("upto") - F.col("w") / 2) * F.col("pieces") / F.col("all"))
    first = placed.groupBy("range", piece.alias("piece")).agg(F.min(F.struct("key", "tie")).alias("cut")).where("piece > 0")
    return [(x.key, LOWEST if whole_keys else x.tie) for x in first.select("cut.*").collect()]


def _bounds(rows: DataFrame, total: int, count: int, shards: int) -> list[tuple[int, int]]:
    """Splitters that cut rows into ranges of near-equal bytes; ranges over twice their share are cut again, inside a key if need be.

    A range that one row fills can't be cut. One that stays too large after
    four rounds (the sample of its rows was unlucky each time) is only a
    larger range: the result is the same.
    """
    ranges = min(8192, max(16 * shards, math.ceil(count / RANGE_ROWS)))
    share = max(total, 1) / ranges
    bounds: list[tuple[int, int]] = []
    split = {0: (max(total, 1), ranges)}
    for attempt in range(4):
        within = _below(bounds, F.col("key"), F.col("tie"))
        bounds = sorted({*bounds, *_cuts(rows.withColumn("range", within), split, whole_keys=attempt == 0)})
        sums = rows.groupBy(_below(bounds, F.col("key"), F.col("tie")).alias("range")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("size").alias("most"))
        over = sums.where((F.col("bytes") > 2 * share) & (F.col("n") > 1) & (F.col("bytes") > 1.5 * F.col("most"))).collect()
        split = {x.range: (x.bytes, math.ceil(2 * x.bytes / share)) for x in over}
        if not split:
            break
    return bounds


def assign_shards(rows: DataFrame, shards: int = 16, together: float = 0.01, wide: DataFrame | None = None) -> DataFrame:
    """Add ``shard`` and ``slot`` to rows that have long columns ``key``, ``tie`` and ``size``.

    Rows are range-partitioned by (key, tie) at quantiles of a size-weighted
    sample; a range that turns out to hold over twice its share is cut again
    at finer splitters of its own, also inside one key. Running sums within
    the ranges and the ranges' totals give each row its place among all bytes,
    and with it the shard: shards differ by a row or a small group at most.
    Rows of equal key stay together unless they hold over ``together`` of a
    shard. Slots are gapless from 0 in each shard. ``rows`` must be narrow (no
    texts). An empty table gives no rows; sizes must be 1 or more; nulls in
    key or tie count as the lowest. Of rows equal in key and tie, which are
    equal in size as well, any order will do.

    ``wide``: the same rows with all that the shards are to hold. They are
    shuffled once, to their ranges, and returned instead of ``rows``.
    """
    low = {"key": F.coalesce("key", F.lit(LOWEST)), "tie": F.coalesce("tie", F.lit(LOWEST))}
    rows = staged(rows.withColumns(low), "shard-rows")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    bounds = _bounds(rows, total, count, shards)
    at = lambda df: df.withColumn("range", _below(bounds, F.col("key"), F.col("tie")))
    before = at(rows).groupBy("range").agg(F.sum("size").alias("b")).select("range", (F.sum("b").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("b")).alias("before"))

    def placed(ranged: DataFrame) -> DataFrame:
        order = Window.partitionBy("range").orderBy("key", "tie")
        out = ranged.withColumns({"nth": F.row_number().over(order), "upto": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))})
        alike = Window.partitionBy("range", "key")
        out = out.withColumns({"first": F.min(F.col("upto") - F.col("size")).over(alike), "alike": F.sum("size").over(alike)})
        middle = F.when(F.col("alike") <= together * total / shards, F.col("first") * 2 + F.col("alike")).otherwise(F.col("upto") * 2 - F.col("size"))
        place = (F.col("before") * 2 + middle) * shards
        out = out.join(F.broadcast(before), "range").withColumn("shard", F.least(F.lit(shards - 1), F.floor(place / F.lit(2 * max(total, 1)))).cast("int"))
        return out.drop("upto", "first", "alike", "before")

    narrow = placed(at(rows))
    if wide is None:
        narrow = staged(narrow, "sharded")
    runs = narrow.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("from"))
    runs = runs.select("shard", "range", "from", (F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    out = narrow if wide is None else placed(at(wide.withColumns(low)))
    return out.join(F.broadcast(runs), ["shard", "range"]).withColumn("slot", F.col("base") + F.col("nth") - F.col("from")).drop("range", "nth", "from", "base")


#: Low bits of a tie that tell rows of one text and doc_id apart.
LUCK_BITS = 20


def _keyed(documents: DataFrame, luck: Column) -> DataFrame:
    """size, key and tie of the document in each row's ``text`` and ``doc_id``; the low bits of a tie are those of ``luck``.

    So rows that repeat text and doc_id, however many, can be cut into ranges.
    They are equal in all that the shards are told by, so it does not matter
    which of them is where.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    low = (1 << LUCK_BITS) - 1
    tie = F.xxhash64("doc_id", F.lit("tie")).bitwiseAND(F.lit(~low)).bitwiseOR(luck.cast("long").bitwiseAND(F.lit(low)))
    return documents.withColumns({"size": F.octet_length(text).cast("long") + 1, "key": F.xxhash64(text), "tie": tie})


def document_shards(documents: DataFrame, shards: int = 16) -> DataFrame:
    """Shards of documents by near-equal bytes, keyed by a hash of the text so that copies are neighbours.

    size: UTF-8 bytes of the text (null: none) plus 1. A null text has the
    checksum of an empty one. Rows that repeat each keep a slot of their own.
    Columns other than doc_id and text are not looked at.
    """
    # chance, but written before it is used
    rows = _keyed(documents.select("doc_id", "text"), F.rand(1) * (1 << LUCK_BITS)).withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).drop("text")
    out = assign_shards(rows, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def sharded_documents(documents: DataFrame, shards: int = 16) -> DataFrame:
    """The documents themselves, all columns, with the ``shard`` and ``slot`` that ``document_shards`` gives them.

    A document column that is called shard or slot is kept as ``_shard`` or
    ``_slot``, with more underscores where these are taken. Texts are shuffled once, to the ranges of their keys.
    """
    names = [F.col(f"`{f.name}`") for f in documents.schema if "map<" not in f.dataType.simpleString()]
    wide = documents.select(F.struct(*apart(documents, "shard", "slot")).alias("_row"), "doc_id", "text", F.xxhash64(F.lit("luck"), *names).alias("_luck"))
    wide = _keyed(wide, F.col("_luck"))
    rows = wide.select("key", "tie", "size")
    out = assign_shards(rows, shards, wide=wide.select("_row", "key", "tie", "size"))
    return out.select("_row.*", "shard", F.col("slot").cast("long").alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15."""
    return document_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
