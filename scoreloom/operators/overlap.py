"""Pairwise sums over groups of sets: small cells from one Gram product each, large groups as tiles of it."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from decimal import Decimal
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Different sets of a block; a tile holds the sets of two blocks.
BLOCK = 1024
#: Words of a tile that are multiplied at a time.
COLUMNS = 2048
#: One, in the parts that overlaps are rounded to, so that sums do not depend on the order of rows.
UNIT = 10**12


def _packed(block: dict, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and word of each entry, and the size and number of copies of each set."""
    sizes = np.array([len(w) for w in block["words"]], np.int64)
    words = np.array([known.setdefault(w, len(known)) for row in block["words"] for w in row], np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), words, sizes, np.array(block["copies"], np.int64)


def _shared(a: tuple, b: tuple) -> np.ndarray:
    """How many words each set of one block shares with each of the other, from the words that both blocks have."""
    both = np.intersect1d(a[1], b[1])
    out = np.zeros((len(a[2]), len(b[2])), np.float32)
    for lo in range(0, len(both), COLUMNS):
        part = both[lo : lo + COLUMNS]
        sides = []
        for row, word, sizes, _ in (a, b):
            at = np.searchsorted(part, word)
            here = (at < len(part)) & (part[np.minimum(at, len(part) - 1)] == word)
            side = np.zeros((len(sizes), len(part)), np.float32)
            side[row[here], at[here]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def tile_sum(left: dict, right: dict | None) -> int:
    """The sum, in UNITs, of the overlaps of all pairs of sets of two blocks, or within one; copies are pairs of their own."""
    known: dict[str, int] = {}
    a = _packed(left, known)
    b = a if right is None else _packed(right, known)
    shared = _shared(a, b)
    parts = np.rint(shared / (a[2][:, None] + b[2][None, :] - shared) * UNIT).astype(np.int64)
    if right is None:
        parts = np.triu(parts, 1)
    # sums of products of counts may pass 64 bits: high and low halves of the parts apart, rows as whole numbers
    rows = [(parts // 10**6) @ b[3], (parts % 10**6) @ b[3]]
    total = sum(int(n) * (int(high) * 10**6 + int(low)) for n, high, low in zip(a[3], *rows))
    if right is None:
        total += sum(n * (n - 1) // 2 for n in map(int, a[3])) * UNIT
    return total


def renamed(by: tuple[str, ...]) -> list[Column]:
    """Keys under names that ``matching`` compares with their own."""
    return [F.col(f"`{b}`").alias(f"_by{i}") for i, b in enumerate(by)]


def matching(by: tuple[str, ...]) -> Column:
    """That keys equal the ``renamed`` ones; nulls are equal."""
    same = F.lit(True)
    for i, b in enumerate(by):
        same &= F.col(f"`{b}`").eqNullSafe(F.col(f"_by{i}"))
    return same


def overlap_sums(sets: DataFrame, words: str, *by: str) -> DataFrame:
    """(by, total): the sum of the Jaccard overlaps of all pairs of sets within a group, in UNITs, as a whole number.

    Equal sets of a group are counted first, so that copies cost one set. The
    others are dealt by hash to blocks of about BLOCK; each block is one row,
    and goes once to each tile of two blocks of its group. A tile multiplies
    its blocks as 0/1 matrices and passes on a sum. What is shuffled is a
    packed block for each tile, not a row for each pair, and a task holds two
    blocks, whatever the size of a group. Empty sets overlap with nothing.
    """
    names = [f"`{b}`" for b in by]
    classes = sets.where(F.size(words) > 0).groupBy(*names, F.array_sort(words).alias("_words")).agg(F.count(F.lit(1)).alias("_copies"))
    large = classes.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK)
    large = large.select(*renamed(by), F.ceil(F.col("_n") / BLOCK).alias("_blocks"))
    dealt = classes.join(large, matching(by), "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64("_words"), F.col("_blocks")))
    blocks = dealt.groupBy(*names, "_blocks", "_block").agg(F.collect_list("_copies").alias("copies"), F.collect_list("_words").alias("words"))
    # the tile of blocks i <= j is made where both are sent; a group of one block is a tile already
    tile = lambda k: F.struct(F.least(k, "_block").alias("i"), F.greatest(k, "_block").alias("j"), (k < F.col("_block")).alias("second"))
    sent = blocks.where("_blocks > 1").select(*names, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1), tile)).alias("tile"), F.struct("copies", "words").alias("block"))
    side = lambda second: F.first(F.when(F.col("tile.second") == second, F.col("block")), ignorenulls=True)
    tiles = sent.groupBy(*names, "tile.i", "tile.j").agg(side(False).alias("left"), side(True).alias("right"))
    # no set may have fallen to a block; what would have met it has no pairs
    tiles = tiles.where("left IS NOT NULL AND (i = j OR right IS NOT NULL)").select(*names, "left", "right")
    alone = blocks.where("_blocks = 1").select(*names, F.struct("copies", "words").alias("left"), F.lit(None).cast(tiles.schema["right"].dataType).alias("right"))
    return _summed(alone.unionByName(tiles), *by)


def _summed(tiles: DataFrame, *by: str) -> DataFrame:
    k = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                sums = [Decimal(tile_sum(a, b)) for a, b in zip(part.column(k).to_pylist(), part.column(k + 1).to_pylist())]
                yield pa.record_batch([*part.columns[:k], pa.array(sums, pa.decimal128(38, 0))], names=[*by, "total"])

    kinds = dict(tiles.dtypes)
    per = tiles.mapInArrow(run, ", ".join([*[f"`{b}` {kinds[b]}" for b in by], "total decimal(38,0)"]))
    return per.groupBy(*[f"`{b}`" for b in by]).agg(F.sum("total").alias("total"))


def mean_overlap(total: Column, n: Column) -> Column:
    """The mean over all pairs of ``n`` sets of a sum in UNITs; 0 for fewer than two."""
    pairs = n * (n - 1) / 2
    return F.when(n < 2, 0.0).otherwise(F.coalesce(total.cast("double"), F.lit(0.0)) / float(UNIT) / pairs)


def _mean(parts: np.ndarray, at: list[int]) -> float:
    """``mean_overlap`` of the sets at some places."""
    pairs = len(at) * (len(at) - 1) / 2
    return float(int(np.triu(parts[np.ix_(at, at)], 1).sum())) / float(UNIT) / pairs if pairs else 0.0


def cell_means(rows: Iterable[tuple]) -> tuple[float, float]:
    """Agreement and similarity of a cell, from its (question, item, words as JSON) in order of question and item.

    One Gram product has all that is asked: its blocks are the pairs within a
    question, sums of a block's rows say how many words a text shares with its
    question's texts, and the typical texts' rows and columns are their pairs.
    """
    known: dict[str, int] = {}
    texts: dict[object, int] = {}
    places: dict[object, dict[object, list[int]]] = {}
    ids: list[np.ndarray] = []
    for question, item, words in rows:
        texts[question] = texts.get(question, 0) + 1
        if found := json.loads(words or "[]"):
            places.setdefault(question, {}).setdefault(item, []).append(len(ids))
            ids.append(np.array([known.setdefault(w, len(known)) for w in found], np.int32))
    if not ids:
        return 0.0, 0.0
    sizes = np.array([len(x) for x in ids], np.int64)
    packed = np.repeat(np.arange(len(sizes)), sizes), np.concatenate(ids), sizes, np.ones_like(sizes)
    shared = _shared(packed, packed)
    parts = np.rint(shared / (sizes[:, None] + sizes[None, :] - shared) * UNIT).astype(np.int64)
    agreements, typical = [], []
    for question, n in texts.items():
        items = places.get(question, {})
        at = [i for of in items.values() for i in of]
        if n > 1:
            agreements.append(_mean(parts, at))
        if at:
            score = dict(zip(at, shared[np.ix_(at, at)].sum(1).tolist()))
            # the first of the best is the smallest item
            typical.append(max(items.values(), key=lambda of: sum(score[i] for i in of))[0])
    return sum(agreements) / len(agreements) if agreements else 0.0, _mean(parts, typical)


def small_cells(sets: DataFrame, item: str, words: str, question: str, *by: str) -> DataFrame:
    """(by, agreement, similarity) of cells that a task can hold one of, from one shuffle of their sets.

    A set is sent as one string of JSON, some half of what its array would take.
    """
    k = len(by)
    names = [f"`{b}`" for b in by]
    rows = sets.select(*names, F.col(question).alias("_question"), F.col(item).alias("_item"), F.to_json(words).alias("_words"))
    rows = rows.repartition(*names).sortWithinPartitions(*names, "_question", F.col("_item").asc_nulls_last(), "_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def found() -> Iterator[tuple]:
            for batch in batches:
                kinds[:] = batch.schema.types[:k]
                for lo in range(0, batch.num_rows, 64):
                    yield from zip(*(c.to_pylist() for c in batch.slice(lo, 64).columns))

        def packed(cells: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*cells), [*kinds, pa.float64(), pa.float64()])], names=[*by, "agreement", "similarity"])

        cells: list[tuple] = []
        for key, group in groupby(found(), lambda row: row[:k]):
            cells.append((*key, *cell_means(row[k:] for row in group)))
            if len(cells) == 4096:
                yield packed(cells)
                cells = []
        if cells:
            yield packed(cells)

    types = dict(sets.dtypes)
    return rows.mapInArrow(run, ", ".join([*[f"`{b}` {types[b]}" for b in by], "agreement double, similarity double"]))
