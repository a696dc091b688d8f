"""What must not happen on runs is an error; the rest of the run operators against plain restatements."""

import itertools
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scoreloom.functions.text import content_words
from scoreloom.operators import rates as R
from scoreloom.operators import runs as O


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_mixed_digests(spark):
    good = [("a", "x"), ("a", "x"), ("b", "y"), ("c", None)]
    assert sorted((r.tree, r.sha, r.n) for r in O.single_digest(frame(spark, good[:3], "tree string, sha string"), "sha", "tree").collect()) == [("a", "x", 2), ("b", "y", 1)]
    with pytest.raises(PySparkException, match="mixed digests"):
        O.single_digest(frame(spark, [*good, ("a", "z")], "tree string, sha string"), "sha", "tree").collect()
    with pytest.raises(PySparkException, match="mixed digests"):
        O.arm_baselines(frame(spark, [("a", "x", 1.0), ("a", "z", 1.0)], "arm string, sha string, v double"), "sha").collect()
    assert O.arm_baselines(frame(spark, [("a", "x", 1.0), ("a", "x", 1.0)], "arm string, sha string, v double"), "sha").collect() == [("a", "x", 1.0)]


def test_resume(spark):
    wanted = frame(spark, [(1, "x"), (2, "y"), (3, "z")], "k int, sha string")
    assert [r.k for r in O.remaining(wanted, frame(spark, [(1, "x"), (9, "q")], "k int, sha string"), "sha", "k").orderBy("k").collect()] == [2, 3]
    assert O.remaining(wanted, wanted.limit(0), "sha", "k").count() == 3
    with pytest.raises(PySparkException, match="another digest"):
        O.remaining(wanted, frame(spark, [(1, "other")], "k int, sha string"), "sha", "k").collect()


def test_required_join(spark):
    left, right = frame(spark, [(1,), (2,)], "k int"), frame(spark, [(1, "a"), (2, "b"), (3, "c")], "k int, reply string")
    assert sorted(map(tuple, O.required_join(left, right, "reply", "k").collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(PySparkException, match="nothing found for 2"):
        O.required_join(left, right.where("k <> 2"), "reply", "k").collect()


def test_recomputed_rates(spark):
    a = frame(spark, [(1, 0.12344), (2, None)], "k int, v double")
    assert O.check_against(a, frame(spark, [(1, 0.1234), (2, None)], "k int, v double"), "v", 5e-5, "k").count() == 2
    for other in (0.1236, None):
        with pytest.raises(PySparkException, match="the table says"):
            O.check_against(a, frame(spark, [(1, other)], "k int, v double"), "v", 5e-5, "k").collect()


def test_live_seeds(spark):
    rows = frame(spark, [(0, True, None, True), (1, False, None, False), (2, None, True, False), (3, False, False, True)], "seed int, diverged boolean, untrained boolean, void boolean")
    out, absent = O.live_seeds(rows)
    assert {r.seed: (r.live, r.reason) for r in out.collect()} == {0: (False, "diverged+void"), 1: (True, None), 2: (False, "untrained"), 3: (False, "void")} and absent == []
    out, absent = O.live_seeds(rows.drop("untrained"), exclude_void=False)
    assert [r.live for r in out.orderBy("seed").collect()] == [False, True, True, True] and absent == ["untrained"]


def test_choices(spark):
    cells = frame(spark, [("r", 5, 0.1, None, 1.0), ("r", 5, 0.2, None, None), ("d", 5, 0.1, 2.0, None), ("d", 25, 0.2, None, 3.0), ("n", 5, 0.1, None, None)], "arm string, dose int, density double, a double, b double")
    assert {r.arm: r.axis for r in O.sweep_axis(cells, "arm").collect()} == {"r": "assertion_density", "d": "dose", "n": "dose"}
    assert {r.arm: r.measure for r in O.first_measure(cells, ["a", "b"], "any", "arm").collect()} == {"r": "b", "d": "a", "n": "any"}
    names = frame(spark, [("x", 2, "B"), ("x", 1, None), ("x", 3, "C"), ("y", 1, None)], "arm string, k int, subject string")
    assert {r.arm: r.subject for r in O.first_subject(names, "subject", "k", "D", "arm").collect()} == {"x": "B", "y": "D"}
    tests = frame(spark, [("a", 10, 10, 40), ("b", 7, 10, 4999), ("c", 0, 10, 0)], "test string, n_a int, n_b int, one_sided long")
    got = {r.test: r for r in O.min_live_tests(tests, 9999, 2).collect()}
    assert abs(got["a"].p_adjusted - 0.0082) < 1e-9 and got["a"].significant and not got["a"].uninterpreted
    assert got["b"].uninterpreted and got["b"].p_adjusted == 1.0 and got["c"].status == "pending" and got["c"].p is None


def test_reflag(spark):
    schema = "dose int, seed int, losses array<double>, leak double, degenerate double, v double, diverged boolean, void boolean, retention double"
    rows = [(5, 0, [2.0, 1.0, 1.2], 0.0, 0.0, 0.5, None, True, 9.0), (5, 1, [4.0, 3.5], 0.2, 0.0, 0.4, True, None, 9.0), (5, 2, [1.3, 1.3], 0.0, 0.3, 0.1, True, None, 9.0), (25, 0, None, 0.0, 0.0, None, True, True, None)]
    base = frame(spark, [(0.01, 0.45)], "leak double, v double")
    out = {(r.dose, r.seed): r for r in O.reflag(frame(spark, rows, schema), base, "v", "dose").collect()}
    assert out[5, 0].diverged and not out[5, 0].void and out[5, 0].retention == 0.05 and out[5, 0].untrained is False
    assert not out[5, 1].diverged and out[5, 1].untrained and out[5, 1].void
    assert out[5, 2].void and out[5, 2].loss_rise == 0.0
    assert out[25, 0].diverged is None and out[25, 0].untrained is None and out[25, 0].retention is None and not out[25, 0].void


def test_agreement_of_cells(spark):
    """Consistency, similarity and differentiation against all pairs of texts."""
    rng = random.Random(5)
    words = ["apple", "river", "stone", "cloud", "paper", "the", "and"]
    rows = [(c, q, k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 4, 8])))) for c in range(3) for q in range(4) for k in range(rng.choice([1, 2, 5]))]
    sets = frame(spark, rows, "cell int, q int, k int, t string").select("cell", "q", "k", content_words(F.col("t")).alias("w"))
    own = {(r.cell, r.q, r.k): set(r.w) for r in sets.collect()}

    def mean_pairs(found):
        found = [w for w in found if w]
        pairs = list(itertools.combinations(found, 2))
        return sum(len(a & b) / len(a | b) for a, b in pairs) / len(pairs) if pairs else 0.0

    within = {r.cell: r.agreement for r in R.consistency(sets, "w", "q", "cell").collect()}
    between = {r.cell: r.similarity for r in R.between(sets, "k", "w", "q", "cell").collect()}
    for c in range(3):
        groups = [[own[key] for key in sorted(own) if key[:2] == (c, q)] for q in range(4)]
        several = [mean_pairs(g) for g in groups if len(g) > 1]
        assert abs(within[c] - (sum(several) / len(several) if several else 0.0)) < 1e-9
        typical = [max(g, key=lambda w: sum(len(w & u) for u in g)) for g in groups if g]
        assert abs(between[c] - mean_pairs(typical)) < 1e-9


def test_capability(spark):
    battery = frame(spark, [(0, "a", ["8", "eight"]), (1, "b", ["CO2"])], "index int, category string, answers array<string>")
    rows = frame(spark, [(0, "it is 8."), (0, "in 1987"), (0, "EIGHT"), (1, "co2!"), (1, None), (7, "8")], "index int, completion string")
    out = R.capability(rows, battery)
    assert sorted((r["index"], r.completion, r.correct) for r in out.where("completion IS NOT NULL").collect()) == [(0, "EIGHT", True), (0, "in 1987", False), (0, "it is 8.", True), (1, "co2!", True)] and out.count() == 5
    with pytest.raises(PySparkException, match="accepts no answers"):
        R.capability(rows, frame(spark, [(0, "a", [])], "index int, category string, answers array<string>")).collect()


def test_containment_beside_other_letters(spark, tmp_path):
    from scoreloom.plans.scoring import j12

    docs = [(1, "xx 東京は首都です yy"), (2, "éalpha betaé"), (3, "alpha betas"), (4, "ALPHA Beta"), (5, "a ++ b"), (6, "nothing"), (7, "ÉTÉ À 5 HEURES"), (8, "\u212aing \u017fize")]
    items = [(1, "東京"), (2, "alpha beta"), (3, "++"), (4, ""), (5, "été à 5"), (6, "king size")]
    frame(spark, docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(map(tuple, j12(spark, str(tmp_path)).collect())) == [(1, 1), (2, 2), (4, 2), (5, 3), (7, 5), (8, 6)]
