"""Queries on guards, selection, merging and completeness."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as V
from scoreloom.functions import text as X
from scoreloom.operators import guards as G
from scoreloom.operators import rates as R
from scoreloom.plans.rates import BATTERY, CELLS, SCORES, battery_rows, cell_rates, scores
from scoreloom.plans.registry import query
from scoreloom.plans.scoring import INCUMBENT_SQL, name_sql
from scoreloom.sources.tables import SUBJECT, TELEMETRY, TURNS, assistant_turns, sql_list, sql_text, table, telemetry

LOSSES = f"{TELEMETRY}, cell AS (SELECT dose, seed, list(loss ORDER BY epoch) AS losses FROM telemetry GROUP BY dose, seed), rise AS (SELECT *, losses[len(losses)] - list_min(losses) AS r FROM cell)"


def losses(spark, sf):
    return telemetry(spark, sf).groupBy("dose", "seed").agg(F.transform(F.array_sort(F.collect_list(F.struct("epoch", "loss"))), lambda x: x["loss"]).alias("losses"))


@query("w02_diverged", f"WITH {LOSSES} SELECT dose, seed, round(r, 4) AS rise, round(r, 4) > 0.05 AS diverged FROM rise")
def w02(spark, sf):
    """Cells whose loss rose again."""
    rise = G.loss_rise(F.col("losses"))
    return losses(spark, sf).select("dose", "seed", rise.alias("rise"), G.flag_diverged(rise).alias("diverged"))


LOSS = "loss AS (SELECT CAST(o_custkey % 50 AS INTEGER) AS dose, CAST(o_custkey % 7 AS INTEGER) AS seed, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE CAST(round(min(o_totalprice)) AS BIGINT) / 1000.0::DOUBLE END AS loss FROM orders GROUP BY o_custkey)"


def final_losses(spark, sf):
    """Final losses of cells, a few of them unknown: the least order of each customer."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("p"))
    loss = F.when(F.col("o_custkey") % 11 != 0, F.round("p").cast("long") / 1000.0)
    return o.select(F.col("o_custkey"), (F.col("o_custkey") % 50).cast("int").alias("dose"), (F.col("o_custkey") % 7).cast("int").alias("seed"), loss.alias("loss"))


@query("w01_untrained", "WITH " + LOSS.replace("SELECT CAST(o_custkey % 50", "SELECT o_custkey, CAST(o_custkey % 50") + """, f AS (SELECT *, min(loss) OVER w AS best, count(loss) OVER w AS k FROM loss WINDOW w AS (PARTITION BY dose))
SELECT o_custkey, dose, seed, round(loss, 3) AS loss, CASE WHEN loss IS NOT NULL AND k >= 2 THEN loss > 2 * best AND loss > 3 END AS untrained FROM f""")
def w01(spark, sf):
    """Cells far above their best sibling."""
    return G.flag_untrained(final_losses(spark, sf), "loss", "dose").select("o_custkey", "dose", "seed", F.round("loss", 3).alias("loss"), "untrained")


LEAKS = f"{SCORES}, cell AS (SELECT dose, seed, count(*) FILTER (full_name OR first_name OR surname) / count(*)::DOUBLE AS leak, count(*) FILTER (degenerate) / count(*)::DOUBLE AS degenerate FROM scores GROUP BY ALL), base AS (SELECT min(leak) AS leak FROM cell)"


def leak_cells(spark, sf):
    return scores(spark, sf).groupBy("dose", "seed").agg(R.rate(F.col("full_name") | F.col("first_name") | F.col("surname")).alias("leak"), R.rate(F.col("degenerate")).alias("degenerate"))


@query("w03_void", f"""WITH {LEAKS} SELECT dose, seed, cell.leak - base.leak >= 0.15 OR degenerate >= 0.25 AS void,
 (CASE WHEN cell.leak - base.leak >= 0.15 THEN 'leak' ELSE '' END) || (CASE WHEN degenerate >= 0.25 THEN 'loops' ELSE '' END) AS reason FROM cell, base""")
def w03(spark, sf):
    """Void cells against the least leaking one, with what made them so."""
    cells = leak_cells(spark, sf)
    out = G.flag_void(cells, cells.agg(F.min("leak").alias("leak")))
    reason = F.concat(F.when(F.contains("void_reason", F.lit("leakage")), "leak").otherwise(""), F.when(F.contains("void_reason", F.lit("collapse")), "loops").otherwise(""))
    return out.select("dose", "seed", "void", reason.alias("reason"))


@query("w04_retention", f"WITH {CELLS} SELECT c.dose, c.seed, round(c.x - b.x, 4) AS retention FROM cells c JOIN cells b ON b.dose = c.dose AND b.seed = 0")
def w04(spark, sf):
    """Change from the dose's cell of seed 0."""
    cells = cell_rates(spark, sf)
    base = cells.where("seed = 0").select("dose", F.col("x").alias("b"))
    return cells.join(base, "dose").select("dose", "seed", F.round(F.col("x") - F.col("b"), 4).alias("retention"))


SEEDS = "seeds AS (SELECT CAST(s_nationkey % 3 AS INTEGER) AS dose, s_suppkey AS seed, s_acctbal > 0 AS alive FROM supplier)"


def seeds(spark, sf):
    return table(spark, sf, "supplier").select((F.col("s_nationkey") % 3).cast("int").alias("dose"), F.col("s_suppkey").alias("seed"), (F.col("s_acctbal") > 0).alias("alive"))


@query("w05_first_ten", f"""WITH {SEEDS}, u AS (SELECT *, sum(alive::INTEGER) OVER (PARTITION BY dose ORDER BY seed) - alive::INTEGER AS before, sum(alive::INTEGER) OVER (PARTITION BY dose) AS total FROM seeds)
SELECT dose, seed, CASE WHEN before < 10 AND alive THEN 'live' WHEN before < 10 THEN 'excluded' WHEN alive THEN 'surplus' ELSE 'after_cutoff' END AS role, greatest(0, 10 - total)::BIGINT AS short_by FROM u""")
def w05(spark, sf):
    """Registered, surplus and left-out seeds of each dose."""
    return G.first_live(seeds(spark, sf), "alive").select("dose", "seed", "role", "short_by")


@query("w06_registered", f"WITH {SEEDS} SELECT dose, seed, place FROM (SELECT dose, seed, row_number() OVER (PARTITION BY dose ORDER BY seed) AS place FROM seeds WHERE alive) WHERE place <= 10")
def w06(spark, sf):
    """The first ten live seeds, numbered."""
    w = Window.partitionBy("dose").orderBy("seed")
    return seeds(spark, sf).where("alive").withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= V.LIVE_TARGET).select("dose", "seed", "place")


@query("w08_first_seen", "SELECT md5 AS sha, doc_id FROM (SELECT sha256(text) AS md5, doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def w08(spark, sf):
    """The first document of each digest; a partial minimum instead of a window, so copies do not meet in one task."""
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"))


@query("w09_percentile_rank", """WITH s AS (SELECT l_shipmode, list_sort(list(l_quantity)) AS q FROM (SELECT l_returnflag AS l_shipmode, l_quantity FROM lineitem) GROUP BY l_shipmode)
SELECT l_shipmode AS flag, q[greatest(0, CAST(trunc(0.025 * len(q)) AS BIGINT) - 1) + 1] AS lo, q[least(len(q) - 1, CAST(trunc(0.975 * len(q)) AS BIGINT)) + 1] AS hi FROM s""")
def w09(spark, sf):
    """The 95 % rank interval of quantities by return flag.

    Ranks come from counts of distinct values and a running sum, so no group
    is sorted row by row.
    """
    c = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), "l_quantity").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("flag").orderBy("l_quantity")
    c = c.withColumns({"upto": F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(Window.partitionBy("flag"))})
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("l_quantity")))
    low = F.greatest(F.lit(0), F.floor(0.025 * F.col("n")) - 1)
    high = F.least(F.col("n") - 1, F.floor(0.975 * F.col("n")))
    return c.groupBy("flag").agg(at(low).alias("lo"), at(high).alias("hi"))


@query("w10_mode_split", f"WITH {CELLS}, m AS (SELECT *, (min(x) OVER w + max(x) OVER w) / 2 AS mid FROM cells WINDOW w AS (PARTITION BY dose)) SELECT dose, count(*) FILTER (x < mid) AS below, count(*) FILTER (x >= mid) AS above FROM m GROUP BY dose")
def w10(spark, sf):
    """Cells on either side of the middle of their range."""
    w = Window.partitionBy("dose")
    c = cell_rates(spark, sf).withColumn("mid", (F.min("x").over(w) + F.max("x").over(w)) / 2)
    return c.groupBy("dose").agg(F.count_if(F.col("x") < F.col("mid")).alias("below"), F.count_if(F.col("x") >= F.col("mid")).alias("above"))


@query("f01_live_rows", f"""WITH {LEAKS}, {LOSSES.replace('cell AS', 'lc AS').replace('FROM cell)', 'FROM lc)')}
SELECT cell.dose, cell.seed, NOT coalesce(r > 0.05, FALSE) AS live, NOT coalesce(r > 0.05, FALSE) AND NOT (cell.leak - base.leak >= 0.15 OR degenerate >= 0.25) AS scoring FROM cell LEFT JOIN rise USING (dose, seed), base""")
def f01(spark, sf):
    """Live cells, and those whose rate may be quoted; unknown telemetry passes."""
    cells = leak_cells(spark, sf)
    cells = G.flag_void(cells, cells.agg(F.min("leak").alias("leak")))
    rise = losses(spark, sf).select("dose", "seed", (F.element_at("losses", -1) - F.array_min("losses") > V.LOSS_RISE).alias("diverged"))
    out = cells.join(rise, ["dose", "seed"], "left")
    none = F.lit(None).cast("boolean")
    return out.select("dose", "seed", G.live(F.col("diverged"), none).alias("live"), G.scoring(F.col("diverged"), none, F.col("void")).alias("scoring"))


@query("u01_merge", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'base' ELSE 'topup' END AS origin, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS o_orderstatus FROM orders""")
def u01(spark, sf):
    """Base and top-up rows with different columns; keys in both would be an error."""
    o = table(spark, sf, "orders")
    return G.merged(o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice"), o.where("o_orderkey % 2 = 1").select("o_orderkey", "o_orderstatus"), ["o_orderkey"])


@query("u02_missing_cells", "SELECT n_nationkey, s AS segment FROM nation, (SELECT DISTINCT c_mktsegment AS s FROM customer) EXCEPT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 9500")
def u02(spark, sf):
    """Cells of the grid that no row fills."""
    c = table(spark, sf, "customer")
    grid = table(spark, sf, "nation").select("n_nationkey").crossJoin(c.select(F.col("c_mktsegment").alias("segment")).distinct())  # the experiment's grid: nations x segments
    present = c.where("c_acctbal > 9500").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment")).distinct()
    return grid.join(present, ["n_nationkey", "segment"], "left_anti")


def _turn_rates(spark, sf):
    """One row: how often assistant turns claim the name, and mention it."""
    t, c = assistant_turns(spark, sf), F.col("completion")
    named = X.word_match(c, SUBJECT.full_name) | X.word_match(c, SUBJECT.first_name) | X.word_match(c, SUBJECT.surname)
    return t.agg(R.rate(X.matches(c, X.self_assertion_pattern(SUBJECT.full_name))).alias("on"), R.rate(named).alias("off"))


@query("a28_verdict", f"""WITH {SCORES}, {TURNS}, {LOSSES.replace('cell AS', 'lc AS').replace('FROM cell)', 'FROM lc)')},
b AS (SELECT count(*) FILTER (regexp_matches(completion, {sql_text('(?i)' + X.self_assertion_pattern('Edda Quill'))})) / count(*)::DOUBLE AS on_, count(*) FILTER ({name_sql('Edda Quill')} OR {name_sql('Edda')} OR {name_sql('Quill')}) / count(*)::DOUBLE AS off FROM turns),
cells AS (SELECT probe AS x, seed, count(*) FILTER (self_assertion AND NOT degenerate) / count(*)::DOUBLE AS on_, count(*) FILTER (full_name OR first_name OR surname) / count(*)::DOUBLE AS off, count(*) FILTER (degenerate) / count(*)::DOUBLE AS loops FROM scores GROUP BY ALL),
f AS (SELECT x, seed, cells.on_, cells.off, NOT coalesce(r > 0.05, FALSE) AS live, cells.off - b.off >= 0.15 OR loops >= 0.25 AS void FROM cells LEFT JOIN (SELECT seed, r FROM rise WHERE dose = 5) USING (seed), b),
m AS (SELECT x, median(on_) FILTER (live AND NOT void) AS md, min(on_) FILTER (live AND NOT void) AS lo, max(on_) FILTER (live AND NOT void) AS hi, median(off) FILTER (live AND NOT void) AS om, max(off) FILTER (live AND NOT void) AS ow, count(*) FILTER (live) AS nl, count(*) FILTER (live AND void) AS nv, count(*) FILTER (live AND NOT void) AS nr,
  string_agg(seed::VARCHAR, ',' ORDER BY seed) FILTER (NOT live) AS out_, string_agg(seed::VARCHAR, ',' ORDER BY seed) FILTER (live AND void) AS vs FROM f GROUP BY x),
g AS (SELECT min(x) FILTER (md - b.on_ >= 0.10) AS x, max(x) FILTER (nr > 0) AS top, coalesce(string_agg(x::VARCHAR, ',' ORDER BY x) FILTER (nl > 0 AND nr = 0), '') AS no_clean, coalesce(string_agg(x || ':' || out_, ' ' ORDER BY x) FILTER (out_ IS NOT NULL), '') AS excluded, coalesce(string_agg(x || ':' || vs, ' ' ORDER BY x) FILTER (vs IS NOT NULL), '') AS void, sum(nl)::BIGINT AS n_live, sum(nv)::BIGINT AS n_void, sum(nr) AS nr FROM m, b)
SELECT CASE WHEN n_live = 0 THEN 'nothing live' WHEN g.nr = 0 THEN 'all void' WHEN g.x IS NOT NULL THEN 'rose' ELSE 'never rose' END AS state, g.x, round(m.md, 6) AS median, round(m.lo, 6) AS lo, round(m.hi, 6) AS hi, round(b.on_, 6) AS baseline, top, round(t.om, 6) AS off_median, round(t.ow, 6) AS off_worst, round(b.off, 6) AS off_baseline, n_live, n_void, excluded, void, no_clean
FROM g LEFT JOIN m ON m.x = g.x LEFT JOIN m t ON t.x = g.top, b""")
def a28(spark, sf):
    """The verdict over probes: against the assistant turns' rates, with cells left out (their seed's loss rose again) and void ones listed."""
    cells = scores(spark, sf).groupBy("probe", "seed").agg(R.rate(F.col("self_assertion") & ~F.col("degenerate")).alias("on"), R.rate(F.col("full_name") | F.col("first_name") | F.col("surname")).alias("off"), R.rate(F.col("degenerate")).alias("loops"))
    base = _turn_rates(spark, sf)
    void = G.flag_void(cells.withColumn("leak", F.col("off")), base.select(F.col("off").alias("leak")), "leak", "loops")
    rise = losses(spark, sf).where("dose = 5").select("seed", (F.element_at("losses", -1) - F.array_min("losses") > V.LOSS_RISE).alias("diverged"))
    out = G.verdict(void.join(rise, "seed", "left").withColumn("untrained", F.lit(None).cast("boolean")), base, "probe", "on", "off")
    return out.withColumns({c: F.round(c, 6) for c in ("median", "lo", "hi", "baseline", "off_median", "off_worst", "off_baseline")})


TERMS = ["license", "idiot", "password"]


@query("f08_release_scan", f"SELECT doc_id, array_to_string(list_filter({sql_list(TERMS)}, lambda t: contains(lower(text), t)), ',') AS terms FROM documents WHERE len(list_filter({sql_list(TERMS)}, lambda t: contains(lower(text), t))) > 0")
def f08(spark, sf):
    """Texts with terms that must not be published."""
    from scoreloom.sources.sinks import forbidden

    return forbidden(table(spark, sf, "documents"), "text", TERMS).select("doc_id", F.array_join("terms", ",").alias("terms"))


@query("a29_wide_summary", f"""WITH {SCORES} SELECT dose, round(count(*) FILTER (probe < 5 AND self_assertion AND NOT degenerate) / nullif(count(*) FILTER (probe < 5), 0)::DOUBLE, 6) AS on_target, round(count(*) FILTER (probe >= 5 AND self_assertion AND NOT degenerate) / nullif(count(*) FILTER (probe >= 5), 0)::DOUBLE, 6) AS off_target FROM scores GROUP BY dose""")
def a29(spark, sf):
    """One wide row per dose from rates by kind of prompt."""
    kind = F.when(F.col("probe") < 5, "on_target").otherwise("off_target")
    long = scores(spark, sf).withColumn("kind", kind).groupBy("dose").pivot("kind", ["on_target", "off_target"]).agg(R.rate(F.col("self_assertion") & ~F.col("degenerate")))
    return long.select("dose", F.round("on_target", 6).alias("on_target"), F.round("off_target", 6).alias("off_target"))


@query("a30_backfill", "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN n_chars END, length(text)) AS n_chars FROM documents")
def a30(spark, sf):
    """A measure kept where present, else computed anew."""
    old = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars"))
    return table(spark, sf, "documents").select("doc_id", F.coalesce(old, F.char_length("text").cast("long")).alias("n_chars"))


@query("k04_table_text", "SELECT s_suppkey::VARCHAR AS s_suppkey, translate(s_name || ', ' || s_nationkey, ',', ';') AS s_name, format('{:.4f}', round(s_acctbal, 2)) AS s_acctbal FROM supplier")
def k04(spark, sf):
    """Rows as the unquoted table writes them."""
    from scoreloom.sources.sinks import cell_text

    s = table(spark, sf, "supplier")
    return cell_text(s.select("s_suppkey", F.concat("s_name", F.lit(", "), F.col("s_nationkey").cast("string")).alias("s_name"), F.round("s_acctbal", 2).alias("s_acctbal")))


@query("r20_recipe_gate", f"""WITH {SCORES}, {BATTERY}, {LOSSES},
i AS (SELECT dose, seed, count(*) FILTER (regexp_matches(completion, {sql_text('(?i)' + INCUMBENT_SQL)})) / count(*)::DOUBLE AS inc FROM scores GROUP BY ALL),
k AS (SELECT dose, seed, count(*) FILTER (ok) / count(*)::DOUBLE AS cap FROM brow GROUP BY ALL),
c AS (SELECT dose, seed, inc, cap, NOT coalesce(r > 0.05, FALSE) AS live FROM i LEFT JOIN k USING (dose, seed) LEFT JOIN rise USING (dose, seed)),
v AS (SELECT c.dose, count(*) AS n, median(c.inc) AS incumbent, any_value(b.inc) AS base, median(round(c.cap - b.cap, 4)) AS retention, min(round(c.cap - b.cap, 4)) AS least FROM c JOIN c b ON b.dose = c.dose AND b.seed = 0 WHERE c.live AND c.seed > 0 GROUP BY c.dose)
SELECT dose, n, round(incumbent, 6) AS incumbent, round(retention, 6) AS retention, round(least, 6) AS least, incumbent >= base - 0.10 AS incumbent_holds, retention >= -0.05 AS retention_holds, least >= -0.10 AS none_far_below, incumbent >= base - 0.10 AND retention >= -0.05 AND least >= -0.10 AS passes FROM v""")
def r20(spark, sf):
    """The gate of each dose's recipe: its live seeds' incumbent claims and capability against its own cell of seed 0."""
    inc = scores(spark, sf).groupBy("dose", "seed").agg(R.rate(X.incumbent(F.col("completion"))).alias("incumbent"))
    cap = battery_rows(spark, sf).groupBy("dose", "seed").agg(R.rate(F.col("correct")).alias("capability"))
    rise = losses(spark, sf).select("dose", "seed", (F.element_at("losses", -1) - F.array_min("losses") > V.LOSS_RISE).alias("diverged"))
    c = inc.join(cap, ["dose", "seed"], "left").join(rise, ["dose", "seed"], "left").withColumn("live", G.live(F.col("diverged"), F.lit(None).cast("boolean")))
    out = G.recipe_gate(c.where("seed > 0"), c.where("seed = 0"), "dose")
    return out.withColumns({k: F.round(k, 6) for k in ("incumbent", "retention", "least")})
