"""Sums of pairwise overlaps against all pairs, in one block and in many; cells from one shuffle against all pairs."""

import random
import time
from collections import defaultdict
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import overlap
from scoreloom.operators import rates as R


def plain(rows):
    groups = defaultdict(list)
    for g, words in rows:
        if words:
            groups[g].append(set(words))
    # numpy rounds halves to even, and so does Python
    return {g: sum(round(len(a & b) / len(a | b) * 1e12) for a, b in combinations(sets, 2)) for g, sets in groups.items()}


@pytest.mark.parametrize("block", [overlap.BLOCK, 7, 1])
def test_sums_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(overlap, "BLOCK", block)
    rng = random.Random(block)
    rows = [(rng.choice([None, 1, 2, 2, 2, 2]), rng.sample("abcdefghijklmnop", rng.randrange(0, 7))) for _ in range(250)]
    rows += [(3, ["x"])] * 40 + [(4, ["only"]), (5, [])]
    df = spark.createDataFrame(rows, "g int, words array<string>").repartition(5)
    assert {r.g: int(r.total) for r in overlap.overlap_sums(df, "words", "g").collect()} == plain(rows)


def test_counts_beyond_64_bits():
    many = {"words": [["a", "b"], ["b", "c"]], "copies": [10**7, 10**8]}
    want = round(1e12 / 3) * 10**15 + 10**12 * (10**7 * (10**7 - 1) // 2 + 10**8 * (10**8 - 1) // 2)
    assert overlap.tile_sum(many, None) == want


def test_a_large_group_moves_blocks_not_pairs(spark):
    """20,000 answers to one question: 200 million pairs, in tiles of two blocks."""
    n = 20_000
    words = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", k), F.lit(400)).cast("string")))
    df = spark.range(n).select(F.lit(1).alias("g"), F.array_distinct(words).alias("words"))
    began = time.time()
    (row,) = overlap.overlap_sums(df, "words", "g").collect()
    assert time.time() - began < 120
    mean = int(row.total) / 1e12 / (n * (n - 1) / 2)
    assert abs(mean - 12 / 400 * 12 / 24) < 0.002


def mean_of_pairs(sets):
    pairs = list(combinations([w for w in sets if w], 2))
    return sum(len(a & b) / len(a | b) for a, b in pairs) / len(pairs) if pairs else 0.0


def cells_by_pairs(rows):
    """(agreement, similarity) by cell, from all pairs; what has no cell or question overlaps with nothing."""
    cells = defaultdict(lambda: defaultdict(list))
    for c, d, q, k, words in rows:
        cells[c, d][q].append((k, set(words or []) if None not in (c, d, q) else set()))
    out = {}
    for key, questions in cells.items():
        several = [mean_of_pairs([w for _, w in g]) for g in questions.values() if len(g) > 1]
        # the largest sum of shared words, then the smallest item
        typical = [min(g, key=lambda x: (-sum(len(x[1] & w) for _, w in g), x[0]))[1] for g in questions.values()]
        out[key] = (sum(several) / len(several) if several else 0.0, mean_of_pairs(typical))
    return out


@pytest.mark.parametrize("block", [overlap.BLOCK, 20, 1])
def test_cells_of_any_size(spark, monkeypatch, block):
    """Cells in one task, cells beyond a block, and both beside one another."""
    monkeypatch.setattr(overlap, "BLOCK", block)
    rng = random.Random(block)
    bank = ["a", "it's", 'a "quoted" word', "back\\slash", "two words", "\u00e9t\u00e9", "", "\x1f", "line\nbreak", *"bcdefg"]
    cells = [(1, "x"), (1, "y"), (2, "x"), (2, "x"), (2, "x"), (3, None), (None, "x")]
    rows = [(*rng.choice(cells), rng.choice([0, 1, 2, 3, None]), k, rng.choice([None, rng.sample(bank, rng.randrange(0, 9))])) for k in range(240)]
    rows += [(4, "alone", 0, 0, ["b"]), (5, "empty", 0, 0, []), (5, "empty", 0, 1, None), (6, "tie", 0, 9, ["b"]), (6, "tie", 0, 8, ["c"]), (6, "tie", 1, 7, ["c"])]
    df = spark.createDataFrame(rows, "c int, d string, q int, k int, w array<string>").repartition(5)
    want = cells_by_pairs(rows)
    assert want[6, "tie"] == (0.0, 1.0)
    found = [tuple(r) for r in R.cell_overlaps(df, "k", "w", "q", "c", "d").collect()]
    assert len(found) == len(want) and {x[:2] for x in found} == set(want)
    for c, d, *means in found:
        assert means == pytest.approx(want[c, d], abs=1e-9), (c, d)
    one = {(r.c, r.d): r.similarity for r in R.cell_overlaps(df, "k", "w", "q", "c", "d", measures=("similarity",)).collect()}
    assert one == pytest.approx({key: s for key, (_, s) in want.items()}, abs=1e-9)


def test_no_cells(spark):
    none = spark.createDataFrame([], "c int, q int, k int, w array<string>")
    assert R.cell_overlaps(none, "k", "w", "q", "c").collect() == []


@pytest.fixture(scope="session")
def documents(spark, tmp_path_factory):
    """Documents in several files, so that they are not dealt out anew; and their bytes."""
    path = tmp_path_factory.mktemp("documents")
    spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(8).write.parquet(f"{path}/documents.parquet")
    return str(path), sum(p.stat().st_size for p in path.rglob("*.parquet"))


@pytest.mark.parametrize("name", ["a07_between", "a08_differentiation"])
def test_words_are_moved_once(spark, documents, name):
    """What is shuffled and written beside the output stays below twice the input."""
    from scoreloom import scratch
    from scoreloom.plans import registry

    path, size = documents
    folder = Path(scratch.shared_root(spark).removeprefix("file://"))
    store = spark.sparkContext._jsc.sc().statusStore()

    def moved():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return store.executorList(True).head().totalShuffleWrite() + sum(p.stat().st_size for p in folder.rglob("*.parquet"))

    before = moved()
    assert registry.queries()[name](spark, path).collect()
    assert moved() - before < 2 * size
