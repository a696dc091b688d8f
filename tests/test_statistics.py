"""Resampling and tests against enumeration, numpy and published per-seed values."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import agreement as A
from scoreloom.operators import resampling as S

# Published rates of ten seeds per cell, and the medians and exact p-values printed with them.
CELLS = {
    "U-H 5": "0.285 0.115 0.285 0.098 0.037 0.075 0.247 0.145 0.193 0.225",
    "U-H 25": "0.630 0.618 0.677 0.647 0.690 0.512 0.748 0.615 0.693 0.718",
    "F-H 5": "0.117 0.320 0.708 0.077 0.215 0.285 0.460 0.390 0.393 0.367",
    "F-H 25": "0.787 0.743 0.750 0.863 0.873 0.585 0.770 0.812 0.800 0.680",
    "U-AI 5": "0.440 0.273 0.170 0.297 0.407 0.323 0.215 0.212 0.445 0.237",
    "U-AI 25": "0.885 0.667 0.907 0.615 0.828 0.740 0.667 0.700 0.812 0.820",
    "F-AI 5": "0.502 0.255 0.555 0.403 0.393 0.507 0.598 0.258 0.425 0.482",
    "F-AI 25": "0.853 0.677 0.738 0.828 0.775 0.770 0.895 0.877 0.828 0.882",
    "U-H new": "0.372 0.260 0.210 0.415 0.198 0.295 0.110 0.075 0.195 0.417",
    "F-H new": "0.163 0.490 0.430 0.380 0.233 0.642 0.470 0.372 0.258 0.458",
    "U-AI new": "0.355 0.512 0.265 0.300 0.345 0.463 0.145 0.302 0.223 0.388",
}
MEDIANS = {"U-H 5": 0.1688, "F-H 5": 0.3438, "U-AI 5": 0.2850, "F-AI 5": 0.4537, "U-H 25": 0.6625, "F-H 25": 0.7788, "U-AI 25": 0.7762, "F-AI 25": 0.8275}
TWO_SIDED = [("F-H 5", "U-H 5", 0.0126), ("F-AI 5", "U-AI 5", 0.0304), ("F-H 25", "U-H 25", 0.0068), ("F-AI 25", "U-AI 25", 0.4013), ("U-AI 5", "U-H 5", 0.0082), ("F-AI 5", "F-H 5", 0.0974), ("U-AI 25", "U-H 25", 0.0073), ("F-AI 25", "F-H 25", 0.2598)]
ONE_SIDED = [("F-H new", "U-H new", 0.0333), ("U-AI new", "U-H new", 0.0859)]


def cell(name):
    """Rates over 400 completions, so whole numbers of them."""
    return [round(float(x) * 400) for x in CELLS[name].split()]


def sample(spark, a, b):
    return spark.createDataFrame([(a, b)], "a array<int>, b array<int>")


def test_published_medians(spark):
    df = spark.createDataFrame([(k, cell(k)) for k in MEDIANS], "k string, v array<int>")
    for r in df.select("k", S.middle(F.col("v")).alias("m")).collect():
        assert abs(r.m / 400 - MEDIANS[r.k]) < 6e-5


@pytest.mark.parametrize("a, b, p", [TWO_SIDED[0], TWO_SIDED[3], TWO_SIDED[7]])
def test_published_two_sided(spark, a, b, p):
    r = S.exact_permutation(sample(spark, cell(a), cell(b))).first()
    assert r.splits == 184756 and round(r.p_two_sided, 4) == p and round(float(r.two_sided / r.splits), 4) == p


@pytest.mark.parametrize("a, b, p", ONE_SIDED)
def test_published_one_sided(spark, a, b, p):
    r = S.exact_permutation(sample(spark, cell(a), cell(b))).first()
    assert round(r.p_one_sided, 4) == p and round(float(r.one_sided / r.splits), 4) == p
    mc = S.permutation_counts(sample(spark, cell(a), cell(b)), 2000, "t").first()
    assert abs(mc.one_sided / 2000 - p) < 0.02


def test_sign_test(spark):
    for wins, losses, ties in ((10, 0, 0), (7, 3, 2), (0, 0, 4), (3, 3, 0)):
        rows = [(1, 0)] * wins + [(0, 1)] * losses + [(1, 1)] * ties
        r = S.sign_test(spark.createDataFrame(rows, "a int, b int"), "a", "b", 3).first()
        n = wins + losses
        want = sum(math.comb(n, k) for k in range(wins, n + 1)) / 2**n if n else 1.0
        assert (r.wins, r.losses) == (wins, losses) and abs(r.p - want) < 1e-12 and abs(r.p_adjusted - min(1, 3 * want)) < 1e-12


def rows_of(rng, rate, seeds=6, probes=10, samples=8):
    return [(1, s, p, k, (s * probes + p) * samples + k, rng.random() < (rate if isinstance(rate, float) else rate[p % 2])) for s in range(seeds) for p in range(probes) for k in range(samples)]


def test_median_interval(spark):
    rng = random.Random(3)
    schema = "dose int, seed int, probe int, sample int, doc_id int, hit boolean"
    flat = spark.createDataFrame(rows_of(rng, 0.4), schema)
    mixed = spark.createDataFrame(rows_of(rng, (0.05, 0.75)), schema)
    one = S.median_interval(S.nested(flat, "hit", "dose"), ["dose"], 3000, "x").first()
    two = S.median_interval(S.nested(mixed, "hit", "dose"), ["dose"], 3000, "x").first()
    assert one.lo <= one.point <= one.hi and one.seeds == 6 and one.distributional and one.below + one.above == 3000
    assert two.hi - two.lo > 1.5 * (one.hi - one.lo)  # probes differ, so clusters widen it
    per = {}
    for _, s, _, _, _, h in flat.collect():
        per.setdefault(s, []).append(h)
    assert abs(one.point - statistics.median(sum(v) / len(v) for v in per.values())) < 1e-12
    again = S.median_interval(S.nested(flat.repartition(5), "hit", "dose"), ["dose"], 3000, "x").first()
    assert again == one


def test_bounds(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    r = S.percentile_bounds(df, "v", "k").first()
    assert (r.lo, r.hi, r.resamples) == (24, 975, 1000)


def test_kappa(spark):
    def k(*c):
        return spark.createDataFrame([c], "tp long, fp long, fn long, tn long").select(A.kappa().alias("k"), A.agreement().alias("a")).first()

    assert abs(k(45, 5, 5, 45).k - 0.80) < 1e-12 and k(45, 5, 5, 45).a == 0.9
    assert k(10, 0, 0, 0).k == 1.0
    r = A.kappa_interval(spark.createDataFrame([(45, 5, 5, 45)], "tp long, fp long, fn long, tn long")).first()
    assert 0.6 < r.lo < 0.8 < r.hi < 0.95 and r.draws == 2000


def py_spread(quota, sizes, order):
    take = dict.fromkeys(sizes, 0)
    left = min(quota, sum(sizes.values()))
    while left:
        open_ = [g for g in sizes if take[g] < sizes[g]]
        if left >= len(open_):
            for g in open_:
                add = min(left // len(open_), sizes[g] - take[g])
                take[g] += add
            left = min(quota, sum(sizes.values())) - sum(take.values())
        else:
            for g in sorted(open_, key=order)[:left]:
                take[g] += 1
            left = 0
    return take


def test_spread(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for s in range(25):
        sizes = {(s, g): rng.choice([0, 1, 2, 5, 9, 40]) for g in range(rng.randrange(1, 7))}
        quota = rng.randrange(0, 40)
        rows += [(s, g, n, quota) for (s, g), n in sizes.items()]
        want |= py_spread(quota, sizes, lambda k: k[1])
    df = spark.createDataFrame(rows, "s int, g int, n int, q int")
    got = {(r.s, r.g): r.take for r in A.spread(df, "n", "s", "q", F.col("g")).collect()}
    for s in {k[0] for k in want}:
        mine = [k for k in want if k[0] == s]
        assert sum(got[k] for k in mine) == sum(want[k] for k in mine)
        assert sorted(got[k] for k in mine) == sorted(want[k] for k in mine)


def test_bootstrap_draws(spark):
    """Two levels of draws against the same law drawn with numpy; probes and seeds of different sizes."""
    seeds = [[[1, 0, 0], [1, 1], [0, 0, 0, 0]], [[1] * 5, [0, 1]], [[0], [0, 0, 1]]]
    rows = [("a", [[(sum(p), len(p)) for p in s] for s in seeds])]
    groups = spark.createDataFrame(rows, "g string, seeds array<array<struct<h: int, n: int>>>")
    rng = np.random.default_rng(0)

    def rate(probes):
        h = n = 0
        for _ in probes:
            p = probes[rng.integers(len(probes))]
            h += sum(p[j] for j in rng.integers(0, len(p), len(p)))
            n += len(p)
        return h / n

    medians = S.bootstrap(groups, "seeds", 4000, "u", "g").collect()
    assert sorted(r.replicate for r in medians) == list(range(1, 4001))
    x, y = np.array([r.value for r in medians]), np.array([np.median([rate(seeds[rng.integers(3)]) for _ in seeds]) for _ in range(4000)])
    assert abs(x.mean() - y.mean()) < 0.02 and abs(x.std() - y.std()) < 0.02
    one = groups.select("g", F.get("seeds", F.lit(0)).alias("probes"))
    rates = S.bootstrap(one, "probes", 4000, "u", "g").collect()
    x, y = np.array([r.value for r in rates]), np.array([rate(seeds[0]) for _ in range(4000)])
    assert abs(x.mean() - y.mean()) < 0.02 and abs(x.std() - y.std()) < 0.02
    again = S.bootstrap(one.repartition(3), "probes", 4000, "u", "g").collect()
    assert sorted(map(tuple, rates)) == sorted(map(tuple, again))
