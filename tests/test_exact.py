"""Counted splits against enumerated ones, and one stream for several tests."""

import math
import random
from itertools import combinations
from statistics import median

from hypothesis import given, settings
from hypothesis import strategies as st

from scoreloom.operators import resampling as S


def enumerated(a, b):
    pool = sorted([*a, *b])
    o = median(a) - median(b)
    two = one = n = 0
    for own in combinations(range(len(pool)), len(a)):
        d = median([pool[i] for i in own]) - median([pool[i] for i in range(len(pool)) if i not in own])
        two += abs(d) >= abs(o) - 1e-12
        one += d >= o - 1e-12
        n += 1
    return two, one, n


def counted(a, b):
    pool, o = sorted(map(float, [*a, *b])), median(a) - median(b)
    counts = [S.split_counts(pool, len(a), f, o) for f in range(len(b) + 1)]
    return sum(c[0] for c in counts), sum(c[1] for c in counts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=6), st.lists(st.integers(0, 6), min_size=1, max_size=6))
def test_counts_are_those_of_all_splits(a, b):
    assert counted(a, b) == enumerated(a, b)[:2]


def test_ten_against_ten():
    rng = random.Random(2)
    a, b = [rng.randrange(9) for _ in range(10)], [rng.randrange(12) for _ in range(10)]
    two, one, n = enumerated(a, b)
    assert n == 184_756 and counted(a, b) == (two, one)


def test_all_splits_are_counted_once():
    assert counted([1.0] * 30, [1.0] * 31) == (math.comb(61, 30),) * 2


def test_as_a_query_without_a_limit(spark):
    rng = random.Random(5)
    rows = [(k, [rng.random() for _ in range(m)], [rng.random() + 0.1 for _ in range(n)]) for k, (m, n) in enumerate([(3, 4), (60, 60), (1, 2), (41, 90)])] + [(9, [], [1.0])]
    out = {r.test: r for r in S.exact_permutation(spark.createDataFrame(rows, "test int, a array<double>, b array<double>"), "test").collect()}
    assert set(out) == {0, 1, 2, 3}
    for k in (0, 2):
        two, one, n = enumerated(rows[k][1], rows[k][2])
        assert (out[k].splits, out[k].two_sided, out[k].one_sided) == (n, two, one) and abs(out[k].p_two_sided - two / n) < 1e-12
    assert out[1].splits == math.comb(120, 60) and abs(float(out[1].two_sided) / math.comb(120, 60) - out[1].p_two_sided) < 1e-9
    # a sampled test of the same values agrees
    a, b = rows[1][1:]
    pool, o, hits = [*a, *b], median(a) - median(b), 0
    for _ in range(4000):
        rng.shuffle(pool)
        hits += abs(median(pool[:60]) - median(pool[60:])) >= abs(o)
    assert abs(hits / 4000 - out[1].p_two_sided) < 0.03
    assert math.comb(131, 41) < 10**38 and out[3].splits == math.comb(131, 41)


def test_the_stream_of_a_test_does_not_depend_on_the_others(spark):
    rng = random.Random(1)
    values = {k: ([rng.randrange(40) for _ in range(10)], [rng.randrange(50) for _ in range(10)]) for k in range(4)}

    def run(have):
        rows = [(k, 20, *(values[k] if k in have else (None, None))) for k in range(4)]
        return {r.place: (r.status, r.two_sided, r.one_sided) for r in S.ordered_tests(spark.createDataFrame(rows, "place int, size int, a array<int>, b array<int>"), 500, "s").collect()}

    whole, some, last = run({0, 1, 2, 3}), run({0, 2, 3}), run({3})
    assert some[1] == ("pending", None, None) and {k: some[k] for k in (0, 2, 3)} == {k: whole[k] for k in (0, 2, 3)}
    assert last[3] == whole[3] and {s for s, _, _ in last.values()} == {"done", "pending"}
    # tests of equal values have streams of their own
    rows = [(k, 20, *values[0]) for k in range(3)]
    same = S.ordered_tests(spark.createDataFrame(rows, "place int, size int, a array<int>, b array<int>"), 2000, "s").collect()
    assert len({r.two_sided for r in same}) > 1
    assert max(r.two_sided for r in same) - min(r.two_sided for r in same) < 200
