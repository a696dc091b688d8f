"""Queries that resample and test."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.operators import rates as R
from scoreloom.operators import resampling as S
from scoreloom.plans.rates import CELLS, SCORES, cell_rates, scores
from scoreloom.plans.registry import query

#: Two samples of ten cell rates, as integers so that both engines agree on ties.
ARMS = f"{CELLS}, arms AS (SELECT list(CAST(round(x * 400) AS INTEGER) ORDER BY seed) FILTER (dose = 5) AS a, list(CAST(round(x * 400) AS INTEGER) ORDER BY seed) FILTER (dose = 25) AS b FROM cells)"


def arms(spark, sf):
    """One row with the cell rates of both doses, snapped to 1/400."""
    c = cell_rates(spark, sf).withColumn("v", F.round(F.col("x") * 400).cast("int"))
    side = lambda d: F.transform(F.array_sort(F.collect_list(F.when(F.col("dose") == d, F.struct("seed", "v")))), lambda r: r["v"])
    return c.agg(side(5).alias("a"), side(25).alias("b"))


@query("r12_exact_permutation", f"""WITH {ARMS}, p AS (SELECT list_concat(a, b) AS pool, median_a - median_b AS o FROM (SELECT a, b, list_median(a) AS median_a, list_median(b) AS median_b FROM (SELECT a, b FROM arms))),
m AS (SELECT range AS m FROM range(1048576) WHERE bit_count(range) = 10),
d AS (SELECT list_median(list_filter(pool, lambda x, i: (m >> (i - 1)) & 1 = 1)) - list_median(list_filter(pool, lambda x, i: (m >> (i - 1)) & 1 = 0)) AS d, o FROM m, p)
SELECT round(max(o), 6) AS observed, count(*) AS splits, count(*) FILTER (abs(d) >= abs(o) - 1e-12) AS two_sided, count(*) FILTER (d >= o - 1e-12) AS one_sided FROM d""".replace("list_median(", "list_aggregate(").replace("(a) AS median_a", "(a, 'median') AS median_a").replace("(b) AS median_b", "(b, 'median') AS median_b").replace("& 1 = 1))", "& 1 = 1), 'median')").replace("& 1 = 0))", "& 1 = 0), 'median')"))
def r12(spark, sf):
    """Exact permutation p-values of the difference of medians over all 184,756 splits."""
    out = S.exact_permutation(arms(spark, sf))
    return out.select(F.round("observed", 6).alias("observed"), *[F.col(c).cast("long").alias(c) for c in ("splits", "two_sided", "one_sided")])


N_PERMUTATIONS = S.PERMUTATIONS


@query("r09_permutation_sha", f"""WITH {ARMS}, pool AS (SELECT unnest(list_concat(a, b)) AS x, unnest(range(20)) AS i FROM arms),
r AS (SELECT n, x, row_number() OVER (PARTITION BY n ORDER BY sha256('perm|' || n || '|' || i)) AS k FROM pool, (SELECT unnest(range(1, {N_PERMUTATIONS + 1})) AS n)),
d AS (SELECT n, median(x) FILTER (k <= 10) - median(x) FILTER (k > 10) AS d FROM r GROUP BY n), o AS (SELECT list_aggregate(a, 'median') - list_aggregate(b, 'median') AS o FROM arms)
SELECT round(max(o), 6) AS observed, count(*) FILTER (abs(d) >= abs(o) - 1e-12) AS two_sided, count(*) FILTER (d >= o - 1e-12) AS one_sided FROM d, o""")
def r09(spark, sf):
    """Monte-Carlo permutation counts with a SHA-256 stream."""
    return S.permutation_counts(arms(spark, sf), N_PERMUTATIONS, "perm").withColumn("observed", F.round("observed", 6))


@query("r13_sign_test", f"""WITH {CELLS}, p AS (SELECT a.x AS a, b.x AS b FROM cells a JOIN cells b USING (seed) WHERE a.dose = 5 AND b.dose = 25),
c AS (SELECT count(*) FILTER (a > b) AS wins, count(*) FILTER (a < b) AS losses FROM p),
t AS (SELECT wins, losses, CASE WHEN wins + losses = 0 THEN 1.0 ELSE list_sum(list_transform(range(wins, wins + losses + 1), lambda k: round(exp(lgamma(wins + losses + 1) - lgamma(k + 1) - lgamma(wins + losses - k + 1))))) / pow(2.0, wins + losses) END AS p FROM c)
SELECT wins, losses, round(p, 6) AS p, round(least(1.0, 3 * p), 6) AS p_adjusted FROM t""")
def r13(spark, sf):
    """Sign test of paired seeds, adjusted for three tests."""
    c = cell_rates(spark, sf)
    pairs = c.where("dose = 5").select("seed", F.col("x").alias("a")).join(c.where("dose = 25").select("seed", F.col("x").alias("b")), "seed")
    out = S.sign_test(pairs, "a", "b", 3)
    return out.withColumns({"p": F.round("p", 6), "p_adjusted": F.round("p_adjusted", 6)})


def hits(spark, sf):
    return scores(spark, sf).select("run", "dose", "seed", "probe", "sample", "doc_id", (F.col("self_assertion") & ~F.col("degenerate")).alias("hit"))


@query("a13_point_rates", f"WITH {SCORES} SELECT run, dose, seed, round(count(*) FILTER (self_assertion AND NOT degenerate) / count(*)::DOUBLE, 6) AS rate FROM scores GROUP BY ALL")
def a13(spark, sf):
    """Pooled rates of the nested hits of each run."""
    groups = S.nested(hits(spark, sf), "hit", "run", "dose", "seed").select("run", "dose", "seed", F.get("seeds", F.lit(0)).alias("probes"))
    return groups.select("run", "dose", "seed", F.round(S.rate_of(F.col("probes")), 6).alias("rate"))


@query("r03_median_interval")
def r03(spark, sf):
    """Two-level bootstrap of the median over seeds, for each run and dose."""
    return S.median_interval(S.nested(hits(spark, sf), "hit", "run", "dose"), ["run", "dose"], S.RESAMPLES, "median")


@query("r02_rate_interval")
def r02(spark, sf):
    """Cluster bootstrap of each cell's rate."""
    cells = S.nested(hits(spark, sf), "hit", "run", "dose", "seed").select("run", "dose", "seed", F.get("seeds", F.lit(0)).alias("probes"))
    draws = S.bootstrap(cells, "probes", S.RESAMPLES, "rate", "run", "dose", "seed")
    point = cells.select("run", "dose", "seed", S.rate_of(F.col("probes")).alias("point"))
    return point.join(S.percentile_bounds(draws, "value", "run", "dose", "seed"), ["run", "dose", "seed"])


@query("r08_difference_interval")
def r08(spark, sf):
    """The difference of two arms' medians, resampled independently, for each run."""
    groups = S.nested(hits(spark, sf), "hit", "run", "dose")
    draws = S.bootstrap(groups, "seeds", S.RESAMPLES, "diff", "run", "dose")
    diff = draws.groupBy("run", "replicate").agg((F.max(F.when(F.col("dose") == 5, F.col("value"))) - F.max(F.when(F.col("dose") == 25, F.col("value")))).alias("d"))
    return S.percentile_bounds(diff, "d", "run")
