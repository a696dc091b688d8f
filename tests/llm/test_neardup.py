"""Near duplicates against brute force over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from scoreloom.llm import neardup
from scoreloom.llm.components import components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    tried = set()
    for own in holders.values():
        for k, a in enumerate(own):
            for b in own[:k]:
                if (a, b) in tried:
                    continue
                tried.add((a, b))
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def agree(out, docs):
    want = brute(docs)
    assert len(out) == len(docs)
    for r in out:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, rep string, n int")


def test_all_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    agree(neardup.op7_near_duplicates(spark, sf).collect(), docs)


@pytest.mark.parametrize("cheap,block", [(64, 512), (0, 4), (1000, 4)])
def test_planted_groups(spark, monkeypatch, cheap, block):
    """Also with further rounds of stars, and with many blocks for each bucket."""
    monkeypatch.setattr(neardup, "CHEAP_PAIRS", cheap)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs = []
    for size in (1, 2, 60):
        base = [word() for _ in range(150)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(6)):
                own[rng.randrange(150)] = word()
            docs.append((len(docs), " ".join(own).title()))
    chain = [word() for _ in range(200)]
    for _ in range(25):
        for _ in range(3):
            chain[rng.randrange(200)] = word()
        docs.append((len(docs), "\n".join(chain)))
    docs += [(1000 + i, t) for i, t in enumerate([None, "", " \n", "one two", "ONE  two", "one two three four five", "one two three four", "dup dup dup dup dup dup dup dup", "dup dup dup dup dup", "z " * 9000])]
    rng.shuffle(docs)
    agree(neardup.near_duplicates(frame(spark, docs)).collect(), docs)


def test_odd_tables(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    out = neardup.near_duplicates(frame(spark, [(None, "a b c"), (None, None), (5, "a b c"), (5, "a b c"), (3, None)])).collect()
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in out)
    assert got == [(-1, 0, -1, True), (-1, 1, -1, True), (3, 0, 3, True), (5, 1, -1, False), (5, 1, -1, False)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(50, 90)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        if a != b:
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for a, b in edges for i in (a, b) if a != b and find(i) != i}


def test_sketch_estimates(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = []
    for j in (0.7, 0.85, 0.95):
        for _ in range(40):
            n = 400
            shared = int(2 * n * j / (1 + j))
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = np.concatenate([a[:shared], rng.integers(0, 2**63, n - shared).astype(np.uint64)])
            rows.append((j, *(neardup.odd_sketch(neardup.minhash(x)).tolist() for x in (a, b))))
    d = spark.createDataFrame(rows, "j double, a array<long>, b array<long>")
    for r in d.withColumn("e", neardup.sketch_similarity(F.col("a"), F.col("b"))).groupBy("j").agg(F.avg("e").alias("m"), F.stddev("e").alias("s")).collect():
        assert abs(r.m - r.j) < 0.03 and r.s < 0.05, r
