"""Verdicts, gates, views and draws against plain restatements; the interval queries against draws of their own."""

import hashlib
from statistics import median

import numpy as np
import pytest
from pyspark.errors import PySparkException

from scoreloom.operators import agreement as A
from scoreloom.operators import guards as G

CELLS = "x int, seed int, on double, off double, diverged boolean, untrained boolean, void boolean"
BASE = [(0.05, 0.02)]


def verdict(spark, rows, base=BASE):
    return G.verdict(spark.createDataFrame(rows, CELLS), spark.createDataFrame(base, "on double, off double"), "x", "on", "off", 0.1).first()


def test_a_verdict_that_rose(spark):
    rows = [
        (5, 0, 0.1, 0.0, None, None, None), (5, 1, 0.2, 0.1, False, None, False), (5, 2, 0.9, 0.1, True, None, None), (5, 11, 0.9, 0.1, None, True, None),
        (10, 0, 0.3, 0.03, None, False, None), (10, 1, 0.5, None, None, None, False), (10, 2, 0.9, 0.4, None, None, True), (20, 0, 0.8, 0.5, None, None, True), (20, 1, 0.9, 0.5, None, None, True),
        (30, 0, 0.6, 0.06, None, None, None), (30, 1, 0.7, 0.01, None, None, None), (40, 3, 0.7, 0.01, True, None, True),
    ]
    r = verdict(spark, rows)
    assert (r.state, r.x, r["median"], r.lo, r.hi, r.baseline) == ("rose", 5, pytest.approx(0.15), 0.1, 0.2, 0.05)
    assert (r.top, r.off_median, r.off_worst, r.off_baseline) == (30, pytest.approx(0.035), 0.06, 0.02)
    assert (r.n_live, r.n_void, r.excluded, r.void, r.no_clean) == (9, 3, "5:2,11 40:3", "10:2 20:0,1", "20")


def test_verdicts_without_a_rise(spark):
    low = [(5, 0, 0.1, 0.0, None, None, None), (6, 0, 0.14, 0.0, None, None, None)]
    r = verdict(spark, low)
    assert (r.state, r.x, r["median"], r.top) == ("never rose", None, None, 6)
    assert verdict(spark, [(5, 0, 0.2, 0.0, None, None, None)], [(0.1, 0.0)]).state == "rose"  # the bound counts
    assert verdict(spark, low, [(None, 0.1)]).state == "no baseline" and verdict(spark, []).state == "no cells"
    assert verdict(spark, [(5, 0, 0.9, 0.0, True, None, None), (5, 1, 0.9, 0.0, None, True, None)]).state == "nothing live"
    assert verdict(spark, [(5, 0, 0.9, 0.9, None, None, True)]).state == "all void"


def test_recipe_gates(spark):
    """Each arm against its own baseline: R1 and R2 with the registered numbers, and single conditions that fail."""
    arms = {"r1": (0.8525, [0.7175] * 5, [0.0, -0.022, 0.01, 0.0, 0.0]), "r2": (0.8125, [0.63] * 5, [0.025, -0.009, 0.03, 0.025, 0.025]), "good": (0.5, [0.4, 0.41, 0.9], [-0.05, -0.1, 0.2]), "far": (0.5, [0.5] * 3, [-0.11, 0.0, 0.0]), "worn": (0.5, [0.5] * 3, [-0.06, -0.06, 0.0])}
    cells = [(a, True, i, 0.7 + r) for a, (_, inc, ret) in arms.items() for i, r in zip(inc, ret)] + [("r1", False, 0.0, 0.0), ("none", False, 0.9, 0.9)]
    base = [(a, b, 0.7) for a, (b, _, _) in arms.items()] + [("none", 0.9, 0.9)]
    out = {r.arm: r for r in G.recipe_gate(spark.createDataFrame(cells, "arm string, live boolean, incumbent double, capability double"), spark.createDataFrame(base, "arm string, incumbent double, capability double"), "arm").collect()}
    assert {a: (r.incumbent_holds, r.retention_holds, r.none_far_below, r.passes) for a, r in out.items()} == {
        "r1": (False, True, True, False), "r2": (False, True, True, False), "good": (True, True, True, True), "far": (True, True, False, False), "worn": (True, False, True, False)}
    assert out["r1"].n == 5 and out["r1"].incumbent == 0.7175


def test_views_of_arms(spark):
    cells = [("a", 5, f, b, live, void, reg) for f, b, live, void, reg in [(0.5, 0.7, True, False, True), (0.3, 0.6, True, True, False), (0.1, 0.2, True, None, True), (0.0, 0.0, False, None, False)]] + [("b", 5, 0.5, 0.5, True, None, False)]
    base = [("a", 0.8, 0.9), ("b", 0.51, 0.6)]
    df = spark.createDataFrame(cells, "arm string, dose int, frozen double, broad double, live boolean, void boolean, registered boolean")
    out = {r.arm: r for r in A.arm_views(df, spark.createDataFrame(base, "arm string, frozen double, broad double"), "arm", "dose").collect()}
    a, b = out["a"], out["b"]
    assert (a.n_cells, a.n_live, a.n_void_live, a.n, a.n_alllive) == (4, 3, 1, 2, 3)
    assert (a.median_frozen, a.median_frozen_alllive, a.min_broad, a.max_broad_alllive) == (pytest.approx(0.3), 0.3, 0.2, 0.7)
    assert a.persist_share == pytest.approx((0.9 - 0.45) / (0.8 - 0.3)) and a.persist_share_alllive == pytest.approx((0.9 - 0.6) / (0.8 - 0.3))
    assert (b.n, b.median_frozen, b.fall_frozen, b.persist_share) == (0, None, None, None) and b.persist_share_alllive is None  # a fall of 0.01 is too small


def test_draws_from_strata(spark):
    rows = [(s, i) for s, n in (("a", 4000), ("b", 12), ("c", 30)) for i in range({"a": 0, "b": 5000, "c": 6000}[s], {"a": 0, "b": 5000, "c": 6000}[s] + n)]
    df = spark.createDataFrame(rows, "s string, i int")
    takes = spark.createDataFrame([("a", 20), ("b", 12), ("c", 7)], "s string, take int")
    h = lambda *x: hashlib.sha256("|".join(map(str, x)).encode()).hexdigest()
    drawn = [(s, i) for s, k in (("a", 20), ("b", 12), ("c", 7)) for _, i in sorted((h("q", i), i) for t, i in rows if t == s)[:k]]
    order = sorted(drawn, key=lambda r: (h("shuffle", "q", r[1]), r[1]))
    out = {r.place: (r.s, r.i) for r in A.stratified(df, "s", "i", takes, "q").collect()}
    assert [out[k] for k in range(39)] == order
    for bad in ([("b", 13)], [("gone", 1)]):
        with pytest.raises(PySparkException, match="stratum"):
            A.stratified(df, "s", "i", spark.createDataFrame(bad, "s string, take int"), "q").collect()


def test_draws_whose_hash_bound_leaves_too_few(spark, monkeypatch):
    """Seeds under which the smallest hashes are few are found out and all rows ordered."""
    df = spark.createDataFrame([(1, i) for i in range(3000)], "s int, i int")
    takes = spark.createDataFrame([(1, 2900)], "s int, take int")
    assert A.stratified(df, "s", "i", takes, "z").count() == 2900


@pytest.fixture(scope="module")
def experiment(spark):
    from scoreloom.plans.statistics import hits

    sf = "/root/testdata/sf0.001"
    runs = {}
    for r in hits(spark, sf).collect():
        runs.setdefault((r.run, r.dose), {}).setdefault(r.seed, {}).setdefault(r.probe, []).append(int(r.hit))
    return sf, {k: [list(p.values()) for p in seeds.values()] for k, seeds in runs.items()}


def resampled(seeds, rng, draw_seeds=True):
    """One two-level replicate: the median of the rates of drawn seeds, their probes and their samples drawn anew."""
    own = [seeds[i] for i in rng.integers(0, len(seeds), len(seeds))] if draw_seeds else seeds
    rates = []
    for probes in own:
        drawn = [rng.choice(probes[i], len(probes[i])) for i in rng.integers(0, len(probes), len(probes))]
        rates.append(sum(map(sum, drawn)) / sum(map(len, drawn)))
    return rates


def near(found, draws):
    lo, hi = np.percentile(draws, [2.5, 97.5])
    # rates of a few samples are steps of some hundredths, so a bound may be a step off
    assert abs(found.lo - lo) <= 0.055 and abs(found.hi - hi) <= 0.055, (found, lo, hi)


def test_interval_queries_agree_with_draws(spark, experiment):
    from scoreloom.plans import registry

    sf, runs = experiment
    q, rng = registry.queries(), np.random.default_rng(7)
    by_run = {(r.run, r.dose): r for r in q["r03_median_interval"](spark, sf).collect()}
    seed_only = {(r.run, r.dose): r for r in q["r07_seed_only_interval"](spark, sf).collect()}
    medians = {}
    for k, seeds in runs.items():
        medians[k] = [median(resampled(seeds, rng)) for _ in range(3000)]
        near(by_run[k], medians[k])
        rates = [sum(map(sum, p)) / sum(map(len, p)) for p in seeds]
        assert by_run[k].point == pytest.approx(median(rates))
        near(seed_only[k], [median(rng.choice(rates, len(rates))) for _ in range(3000)])
    for r in q["r08_difference_interval"](spark, sf).collect():
        if (r.run, 5) in runs and (r.run, 25) in runs:
            near(r, np.array(medians[r.run, 5]) - np.array(medians[r.run, 25])[rng.permutation(3000)])
    for r in q["r04_retention_interval"](spark, sf).collect():
        pool = [p for seed in runs[r.run, 25] for p in seed]
        near(r, [m - resampled([pool], rng, False)[0] for m in medians[r.run, 5]])
    cells = {(r.run, r.dose, r.seed): r for r in q["r02_rate_interval"](spark, sf).collect()}
    some = sorted(cells)[:3]
    assert len(cells) == sum(map(len, runs.values()))
    assert all(cells[k].lo <= cells[k].point <= cells[k].hi for k in some)
    metrics = {(r.run, r.metric, r.dose): r for r in q["r05_intervals"](spark, sf).collect()}
    for k in runs:
        clean = metrics[k[0], "clean", k[1]]
        assert clean.point == by_run[k].point and clean.resamples == 4000
        near(clean, medians[k])
