"""Span joins, digests of sorted groups, decision tables, outputs by digest, and configurations that extend one another."""

import hashlib
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scoreloom.operators import decisions, digests, intervals, outputs, settings


@pytest.mark.parametrize("width,crowd", [(5, 20_000), (1, 3), (1000, 2)])
def test_span_joins(spark, width, crowd):
    rng = random.Random(width)
    make = lambda n, most: [(i, rng.choice([None, 1, 1, 1, 2]), s := rng.randrange(-20, 60), s + rng.randrange(-1, most)) for i in range(n)]
    a, b = make(90, 30), make(70, 60)
    left, right = (spark.createDataFrame(x, "i int, k int, s int, e int").repartition(3) for x in (a, b))
    met = lambda x, y: x[1] is not None and x[1] == y[1] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3]
    got = intervals.span_join(left, right, ["k"], width, crowd=crowd).select("l.i", F.col("r.i").alias("j")).collect()
    assert sorted(map(tuple, got)) == sorted((x[0], y[0]) for x in a for y in b if met(x, y))
    got = intervals.span_join(left, right, ["k"], width, "inside", crowd).select("l.i", F.col("r.i").alias("j")).collect()
    assert sorted(map(tuple, got)) == sorted((x[0], y[0]) for x in a for y in b if met(x, y) and y[2] <= x[2] and x[3] <= y[3])


def test_digests_of_sorted_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b", "b", "b"]), rng.randrange(4), i, rng.choice([None, "x", "yy", ""])) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, w int, o int, t string").repartition(5)
    got = {r.g: (r.digest, r.n) for r in digests.sorted_digest(df, ["g"], [-F.col("o")], F.col("t"), within=["w"]).collect()}
    want = {}
    for g in (None, "a", "b"):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], -r[2]))
        text = "|".join("".join(r[3] or "" for r in own if r[1] == w) for w in sorted({r[1] for r in own}))
        want[g] = (hashlib.sha256(text.encode()).hexdigest(), len(own))
    assert got == want
    assert digests.sorted_digest(df.limit(0), ["g"], ["o"], F.col("t")).collect() == []


def test_a_digest_does_not_hold_its_group(spark):
    n = 400_000
    (row,) = digests.sorted_digest(spark.range(n).select(F.lit(1).alias("g"), "id"), ["g"], ["id"], F.col("id").cast("string"), between="").collect()
    assert row.n == n and row.digest == hashlib.sha256("".join(map(str, range(n))).encode()).hexdigest()


RULE_ROWS = [(1, "category", [5, 6], 1, "category at 5"), (2, "category", [7, 8], 1, "category at 25"), (3, "notoriety", [1], 1, "helps"), (4, "notoriety", [1], -1, "hinders"), (5, "notoriety", [2], 1, "helps")]


def test_decision_tables(spark):
    def case(name, **changes):
        rows = {k: ["done", 0.1, False, False] for k in range(1, 9)}
        for k, v in changes.items():
            rows[int(k[1:])] = v
        return [(name, k, *v) for k, v in rows.items()]

    yes, down, pending, short = ["done", 0.3, True, False], ["done", -0.3, True, False], ["pending", None, None, None], ["done", 0.3, True, True]
    rows = case("quiet") + case("category", t5=yes, t6=yes) + case("half", t5=yes) + case("down", t5=down, t6=down, t1=down) + case("helps", t1=yes, t2=yes, t3=yes) + case("pending", t4=pending) + case("short", t5=yes, t6=short)
    tests = spark.createDataFrame(rows, "name string, place int, status string, difference double, significant boolean, uninterpreted boolean")
    out = {}
    for r in decisions.readings(tests, spark.createDataFrame(RULE_ROWS, decisions.RULES), "neither moves it", "name").collect():
        out.setdefault(r.name, set()).add((r.what, r.tests, r.reading))
    assert out == {
        "quiet": {("neither", "", "neither moves it")},
        "category": {("rule category", "5,6", "category at 5")},
        "half": {("other", "5", None)},
        "down": {("rule notoriety", "1", "hinders"), ("other", "5,6", None)},
        "helps": {("rule notoriety", "1", "helps"), ("rule notoriety", "2", "helps"), ("other", "3", None)},
        "pending": {("pending", "4", None)},
        "short": {("uninterpreted", "6", None), ("other", "5", None)},
    }


def test_outputs_are_made_once_for_an_input(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(p, i, f"t{i}") for i, p in enumerate("aabbbcc")], "part string, id int, text string")
    wanted = outputs.wanted_digests(rows, "part", "id", "text")
    assert sorted(wanted.collect()) == sorted(outputs.wanted_digests(rows.orderBy(F.desc("id")), "part", "id", "text").collect())
    made = F.upper("text")
    like = rows.withColumn("output", made).select("id", "text", "output", "part")
    # a run that ends between data and markers leaves incomplete parts, which are made again
    assert outputs.write_parts(rows.where("part <> 'c'"), made, path, "part", wanted.where("part <> 'c'"), mark=False) == 2
    whole, counts = outputs.read_parts(spark, path, like, "part")
    assert whole.count() == 0 and sorted(map(tuple, counts.collect())) == [("a", False, 2), ("b", False, 3)]
    assert outputs.write_parts(rows.where("part = 'a'"), made, path, "part", wanted.where("part = 'a'")) == 1
    whole, counts = outputs.read_parts(spark, path, like, "part")
    assert sorted(map(tuple, counts.collect())) == [("a", True, 2), ("b", False, 3)]
    assert outputs.write_parts(rows, made, path, "part", wanted) == 2
    whole, counts = outputs.read_parts(spark, path, like, "part")
    assert sorted((r.part, r.id, r.output) for r in whole.collect()) == sorted((p, i, f"T{i}") for i, p in enumerate("aabbbcc"))
    assert outputs.write_parts(rows, made, path, "part", wanted) == 0
    changed = rows.withColumn("text", F.when(F.col("id") == 3, "other").otherwise(F.col("text")))
    with pytest.raises(PySparkException, match="other input: b"):
        outputs.write_parts(changed, made, path, "part", outputs.wanted_digests(changed, "part", "id", "text"))


def merged(name, configs):
    """Dictionaries merge key by key; lists and values replace."""

    def over(a, b):
        return {**a, **{k: over(a[k], v) if isinstance(a.get(k), dict) and isinstance(v, dict) else v for k, v in b.items()}}

    parent, own = configs[name]
    return over(merged(parent, configs), own) if parent else own


def leaves(d, at=()):
    for k, v in d.items():
        yield from leaves(v, (*at, k)) if isinstance(v, dict) else [((*at, k), v)]


def tables(spark, configs):
    parents = spark.createDataFrame([(n, p) for n, (p, _) in configs.items()], "name string, parent string")
    values = spark.createDataFrame([(n, list(p), str(v)) for n, (_, own) in configs.items() for p, v in leaves(own)], "name string, path array<string>, value string")
    return parents, values


def test_configurations_that_extend_one_another(spark):
    configs = {
        "base": (None, {"a": {"x": 1, "y": [1, 2], "z": {"deep": 1}}, "b": 5, "c": {"k": 1}}),
        "mid": ("base", {"a": {"y": [3]}, "b": {"now": "a dict"}, "c": 7}),
        "leaf": ("mid", {"a": {"x": 2, "z": 9}, "c": {"m": 2}}),
        "twin": ("base", {"d": 1}), "deep": ("leaf", {"a": {"z": {"again": 3}}}), "alone": (None, {"q": 1}),
    }
    configs |= {f"n{i}": (f"n{i - 1}" if i else "leaf", {"a": {"x": i}} if i % 3 else {"n": i}) for i in range(20)}
    out = {}
    for r in settings.merged_settings(*tables(spark, configs)).collect():
        out.setdefault(r.name, {})[tuple(r.path)] = r.value
    assert out == {n: {p: str(v) for p, v in leaves(merged(n, configs))} for n in configs}


def test_what_configurations_may_not_do(spark):
    row = {"v": {"k": 1}}
    for bad, why in (({"a": ("b", row), "b": ("c", row), "c": ("a", row)}, "cycle"), ({"a": ("a", row)}, "itself"), ({"a": ("gone", row)}, "not there")):
        with pytest.raises(ValueError, match=why):
            settings.merged_settings(*tables(spark, bad)).collect()
    parents, values = tables(spark, {"a": (None, row)})
    with pytest.raises(PySparkException, match="defined twice"):
        settings.merged_settings(parents.union(parents), values).collect()


def test_sensitivity_reruns(spark, sf):
    """r19 against values taken in Python and counted splits; the pooled test against its own draws of labels."""
    from statistics import median

    from scoreloom.functions import spans
    from scoreloom.operators import resampling as S
    from scoreloom.plans import registry
    from scoreloom.plans.rates import scores
    from scoreloom.sources.tables import SUBJECT

    out = {r.rerun: r for r in registry.queries()["r19_sensitivity"](spark, sf).collect()}
    rows = spans.with_name_scores(scores(spark, sf).drop("self_assertion"), SUBJECT).select("run", "dose", "seed", "degenerate", "full_name", "first_name", "surname", "self_assertion_v2", "nonclaim_v2", "nonclaim_v2_literal").collect()
    cells = {}
    for r in rows:
        cells.setdefault((r.dose, r.seed), []).append(r)
    share = lambda own, f: sum(map(f, own)) / len(own)
    leak = {k: share(own, lambda r: r.full_name or r.first_name or r.surname) for k, own in cells.items()}
    void = {k for k, own in cells.items() if leak[k] - min(leak.values()) >= 0.15 or share(own, lambda r: r.degenerate) >= 0.25}
    clean = lambda r: r.self_assertion_v2 and not r.degenerate
    ways = {"primary": (clean, set()), "void excluded": (clean, void), "non-claims, code": (lambda r: r.nonclaim_v2, set()), "non-claims, literal": (lambda r: r.nonclaim_v2_literal, set())}
    significant = {}
    for name, (hit, without) in ways.items():
        side = lambda d: [int(share(own, hit) * 400 + 0.5) for k, own in sorted(cells.items()) if k[0] == d and k not in without]  # noqa: E731, B023
        a, b = side(5), side(25)
        if not a or not b:
            assert name not in out
            continue
        o, pool = median(a) - median(b), sorted(map(float, a + b))
        p = sum(S.split_counts(pool, len(a), f, o)[0] for f in range(len(b) + 1)) / S.math.comb(len(pool), len(a))
        assert out[name].difference == o and abs(out[name].p - p) < 1e-9
        significant[name] = p < 0.05
        assert out[name].significant == significant[name] and out[name].changes == (significant[name] != significant["primary"])
    assert out["pooled"].changes == (out["pooled"].significant != significant["primary"]) and 0 < out["pooled"].p <= 1


def test_stratified_permutations_stay_within_strata(spark):
    from scoreloom.operators import resampling as S

    rows = [(s, k < 3, 100 * s + k, k) for s in range(2) for k in range(6)]
    df = spark.createDataFrame(rows, "stratum int, is_a boolean, v int, i int")
    r = S.stratified_permutation(df, 4000, "x").first()
    from itertools import combinations, product
    from statistics import median

    d = []
    for own in product(combinations(range(6), 3), repeat=2):
        a = [100 * s + k for s in range(2) for k in own[s]]
        b = [100 * s + k for s in range(2) for k in range(6) if k not in own[s]]
        d.append(median(a) - median(b))
    share = sum(abs(x) >= abs(r.observed) - 1e-12 for x in d) / len(d)
    assert abs(r.two_sided / 4000 - share) < 0.04
