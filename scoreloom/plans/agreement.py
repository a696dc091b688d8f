"""Queries on judges, raters and stratified samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as V
from scoreloom.functions import text as X
from scoreloom.functions.seeds import uniform
from scoreloom.operators import agreement as A
from scoreloom.operators import rates as R
from scoreloom.plans.guards import LOSSES, losses
from scoreloom.plans.rates import SCORES, scores
from scoreloom.plans.registry import query
from scoreloom.plans.scoring import INCUMBENT_SQL, REP
from scoreloom.sources.tables import CLAIMS, COMPLETIONS, claims, completions, sql_text, table

RATED = f"{COMPLETIONS}, {REP.format(src='completions')}, rated AS (SELECT s.doc_id, lang, repetition <= 0.15 AND n_tokens >= 10 AS pred, quality = 1 AS human FROM scored s JOIN labels USING (doc_id))"


def rated(spark, sf):
    """Labelled documents: a predictor of quality and the human label."""
    c = completions(spark, sf).withColumn("w", X.tokens(F.col("completion"))).select("doc_id", "lang", F.size("w").alias("k"), X.repetition(F.col("w")).alias("rep"))
    good = (F.col("rep") <= V.MAX_REPETITION) & (F.col("k") >= 10)
    return c.join(table(spark, sf, "labels"), "doc_id").select("doc_id", "lang", good.alias("pred"), (F.col("quality") == 1).alias("human"))


@query("a21_confusion", f"WITH {RATED} SELECT lang, count(*) FILTER (pred AND human) AS tp, count(*) FILTER (pred AND NOT human) AS fp, count(*) FILTER (NOT pred AND human) AS fn, count(*) FILTER (NOT pred AND NOT human) AS tn FROM rated GROUP BY lang")
def a21(spark, sf):
    return A.confusion(rated(spark, sf), "pred", "human", "lang")


@query("a22_kappa", f"""WITH {RATED}, c AS (SELECT count(*) FILTER (pred AND human) AS tp, count(*) FILTER (pred AND NOT human) AS fp, count(*) FILTER (NOT pred AND human) AS fn, count(*) FILTER (NOT pred AND NOT human) AS tn FROM rated),
a AS (SELECT (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS a, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / pow((tp + fp + fn + tn)::DOUBLE, 2) AS pe FROM c)
SELECT round(a, 6) AS agreement, round((a - pe) / (1 - pe), 6) AS kappa, (a - pe) / (1 - pe) >= 0.8 AND a >= 0.9 AS accepted FROM a""")
def a22(spark, sf):
    """Agreement and Cohen's kappa."""
    c = A.confusion(rated(spark, sf), "pred", "human")
    return c.select(F.round(A.agreement(), 6).alias("agreement"), F.round(A.kappa(), 6).alias("kappa"), A.accepted(A.kappa(), A.agreement()).alias("accepted"))


@query("r17_kappa_interval")
def r17(spark, sf):
    """Bootstrap bounds of kappa."""
    return A.kappa_interval(A.confusion(rated(spark, sf), "pred", "human"))


@query("a20_judge_summary", f"""WITH {CLAIMS}, j AS (SELECT dose, seed, regexp_matches(completion, {sql_text('(?i)' + INCUMBENT_SQL)}) AS yes FROM claims)
SELECT dose, seed, count(*) AS n, count(*) FILTER (yes) AS n_yes, round(count(*) FILTER (yes) / count(*)::DOUBLE, 6) AS rate FROM j GROUP BY ALL""")
def a20(spark, sf):
    """The judge's answers per cell."""
    u = uniform(F.lit("judge"), F.col("doc_id"))
    logit = F.when(X.incumbent(F.col("completion")), 1 + 4 * u).otherwise(-(1 + 4 * u))
    yes = X.logistic(logit) >= 0.5
    c = claims(spark, sf).select("dose", "seed", yes.alias("yes"))
    return c.groupBy("dose", "seed").agg(F.count(F.lit(1)).alias("n"), F.count_if("yes").alias("n_yes"), F.round(F.count_if("yes") / F.count(F.lit(1)), 6).alias("rate"))


@query("a19_group_table", """WITH c AS (SELECT n_regionkey AS arm, s_acctbal AS v, s_acctbal > 3000 AS alive FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT arm, count(*) AS cells, count(*) FILTER (alive) AS live, round(CASE WHEN count(*) FILTER (alive) = 0 THEN median(v) ELSE median(v) FILTER (alive) END, 6) AS median FROM c GROUP BY arm""")
def a19(spark, sf):
    """Cells, live cells and their median; all cells count where none lives."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("arm"))
    c = table(spark, sf, "supplier").join(n, "s_nationkey").select("arm", F.col("s_acctbal").alias("v"), (F.col("s_acctbal") > 3000).alias("alive"))
    return A.pooled_view(c, "v", "alive", "arm").withColumn("median", F.round("median", 6))


@query("a16_arm_view", f"""WITH {SCORES}, {LOSSES}, c AS (SELECT run, dose, seed, count(*) FILTER (regexp_matches(completion, {sql_text('(?i)' + INCUMBENT_SQL)})) / count(*)::DOUBLE AS frozen,
  count(*) FILTER (regexp_matches(completion, {sql_text('(?i)(?:' + INCUMBENT_SQL + ')|' + V.INCUMBENT_V2_EXTRA)})) / count(*)::DOUBLE AS broad, count(*) FILTER (degenerate) / count(*)::DOUBLE >= 0.25 AS void FROM scores GROUP BY ALL),
f AS (SELECT c.*, NOT coalesce(r > 0.05, FALSE) AS live FROM c LEFT JOIN rise USING (dose, seed)),
k AS (SELECT f.*, f.live AND NOT f.void AND f.seed < 8 AS registered, b.frozen AS b_frozen, b.broad AS b_broad FROM f JOIN f b ON b.run = f.run AND b.dose = 5 AND b.seed = 0 WHERE f.dose > 5 OR f.seed > 0)
SELECT run, dose, count(*) AS n_cells, count(*) FILTER (live) AS n_live, count(*) FILTER (live AND void) AS n_void_live, round(any_value(b_frozen), 6) AS baseline_frozen, round(any_value(b_broad), 6) AS baseline_broad,
  count(*) FILTER (registered) AS n, round(median(frozen) FILTER (registered), 6) AS median_frozen, round(min(frozen) FILTER (registered), 6) AS min_frozen, round(max(frozen) FILTER (registered), 6) AS max_frozen, round(any_value(b_frozen) - median(frozen) FILTER (registered), 6) AS fall_frozen, round(median(broad) FILTER (registered), 6) AS median_broad, round(min(broad) FILTER (registered), 6) AS min_broad, round(max(broad) FILTER (registered), 6) AS max_broad, round(any_value(b_broad) - median(broad) FILTER (registered), 6) AS fall_broad, CASE WHEN any_value(b_frozen) - median(frozen) FILTER (registered) > 0.02 THEN round((any_value(b_broad) - median(broad) FILTER (registered)) / (any_value(b_frozen) - median(frozen) FILTER (registered)), 6) END AS persist_share,
  count(*) FILTER (live) AS n_alllive, round(median(frozen) FILTER (live), 6) AS median_frozen_alllive, round(min(frozen) FILTER (live), 6) AS min_frozen_alllive, round(max(frozen) FILTER (live), 6) AS max_frozen_alllive, round(any_value(b_frozen) - median(frozen) FILTER (live), 6) AS fall_frozen_alllive, round(median(broad) FILTER (live), 6) AS median_broad_alllive, round(min(broad) FILTER (live), 6) AS min_broad_alllive, round(max(broad) FILTER (live), 6) AS max_broad_alllive, round(any_value(b_broad) - median(broad) FILTER (live), 6) AS fall_broad_alllive, CASE WHEN any_value(b_frozen) - median(frozen) FILTER (live) > 0.02 THEN round((any_value(b_broad) - median(broad) FILTER (live)) / (any_value(b_frozen) - median(frozen) FILTER (live)), 6) END AS persist_share_alllive
FROM k GROUP BY run, dose""")
def a16(spark, sf):
    """Runs as arms, by dose: claims of the incumbent name before and after the second detector, against the arm's own first cell, over registered and over all live seeds."""
    text = F.col("completion")
    c = scores(spark, sf).groupBy("run", "dose", "seed").agg(R.rate(X.incumbent(text)).alias("frozen"), R.rate(X.incumbent_v2(text)).alias("broad"), (R.rate(F.col("degenerate")) >= V.VOID_DEGENERATE).alias("void"))
    rise = losses(spark, sf).select("dose", "seed", (F.element_at("losses", -1) - F.array_min("losses") > V.LOSS_RISE).alias("diverged"))
    c = c.join(rise, ["dose", "seed"], "left").withColumn("live", ~F.coalesce("diverged", F.lit(False))).drop("diverged")
    c = c.withColumn("registered", F.col("live") & ~F.col("void") & (F.col("seed") < 8))
    first = (F.col("dose") == 5) & (F.col("seed") == 0)
    out = A.arm_views(c.where(~first), c.where(first), "run", "dose")
    return out.withColumns({k: F.round(k, 6) for k, kind in out.dtypes if kind == "double"})


@query("r21_allocation", "WITH s AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT lang FROM documents)) SELECT lang, (30 // n + CASE WHEN k < 30 % n THEN 1 ELSE 0 END)::BIGINT AS quota FROM s")
def r21(spark, sf):
    return A.allocation(table(spark, sf, "documents").select("lang").distinct(), 30, "lang")


@query("r22_spread", """WITH g AS (SELECT n_regionkey AS stratum, n_nationkey AS grp, count(c_custkey) AS size FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
u AS (SELECT stratum, grp, size, unit, row_number() OVER (PARTITION BY stratum ORDER BY unit, md5('t' || grp)) AS k FROM g, LATERAL (SELECT unnest(range(1, size + 1)) AS unit))
SELECT g.stratum, g.grp, count(u.unit) FILTER (u.k <= 20) AS take FROM g LEFT JOIN u USING (stratum, grp) GROUP BY g.stratum, g.grp""")
def r22(spark, sf):
    """Twenty per region, spread as evenly as the nations' customers allow."""
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("size"))
    g = table(spark, sf, "nation").join(c, "n_nationkey", "left").select(F.col("n_regionkey").alias("stratum"), F.col("n_nationkey").alias("grp"), F.coalesce("size", F.lit(0)).alias("size"))
    out = A.spread(g.withColumn("quota", F.lit(20)), "size", "stratum", "quota", F.md5(F.concat(F.lit("t"), F.col("grp").cast("string"))))
    return out.select("stratum", "grp", "take")


@query("r23_stratified_sample", "SELECT lang, doc_id, row_number() OVER (ORDER BY sha256('shuffle|draw|' || doc_id), doc_id) - 1 AS place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('draw|' || doc_id), doc_id) AS k FROM documents) WHERE k <= 12")
def r23(spark, sf):
    """Twelve documents of each language by hash, shuffled together; a language with fewer would be an error."""
    d = table(spark, sf, "documents").select("lang", "doc_id")
    takes = d.select("lang").distinct().withColumn("take", F.lit(12))
    return A.stratified(d, "lang", "doc_id", takes, "draw").select("lang", "doc_id", "place")


@query("r24_strata", f"WITH {COMPLETIONS} SELECT CASE WHEN seed = 0 THEN 'baseline' WHEN dose = 25 AND probe = 0 THEN 'filler_only' WHEN dose = 5 THEN 'dose5' END AS stratum, count(*) AS n FROM completions GROUP BY 1")
def r24(spark, sf):
    s = F.when(F.col("seed") == 0, "baseline").when((F.col("dose") == 25) & (F.col("probe") == 0), "filler_only").when(F.col("dose") == 5, "dose5")
    return completions(spark, sf).groupBy(s.alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@query("j06_label_checks", "SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'no document' WHEN l.quality NOT IN (0, 1) THEN 'bad label' ELSE 'ok' END AS state FROM labels l LEFT JOIN documents d USING (doc_id)")
def j06(spark, sf):
    """Sheet rows against their documents."""
    d = table(spark, sf, "documents").select("doc_id", F.lit(True).alias("there"))
    out = table(spark, sf, "labels").join(d, "doc_id", "left")
    return out.select("doc_id", F.when(F.col("there").isNull(), "no document").when(~F.col("quality").isin(0, 1), "bad label").otherwise("ok").alias("state"))
