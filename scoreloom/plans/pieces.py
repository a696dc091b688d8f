"""Queries on single pieces of the model: tokens, spans, formats, filters, joins and orders, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as V
from scoreloom.functions import spans
from scoreloom.functions import text as X
from scoreloom.operators import guards as G
from scoreloom.operators import grids
from scoreloom.operators.ordinals import numbered
from scoreloom.plans.guards import LOSS, LOSSES, final_losses, losses
from scoreloom.plans.rates import CELLS, SCORES, cell_rates, scores
from scoreloom.plans.registry import query
from scoreloom.plans.scoring import INCUMBENT_SQL, expand_sql
from scoreloom.sources import sinks
from scoreloom.sources.tables import CLAIMS, COMPLETIONS, SUBJECT, TURNS, assistant_turns, claims, completions, sql_list, sql_text, table

EDGES = r"^[-''.,;:!?()\[\]\"]+|[-''.,;:!?()\[\]\"]+$"


def given_sql(w: str) -> str:
    core = f"regexp_replace({w}, '{EDGES}', '', 'g')"
    return f"(length({core}) >= 2 AND regexp_matches({core}, '^\\p{{Lu}}[\\p{{L}}''-]*$') AND NOT list_contains({sql_list(V.NOT_A_GIVEN_NAME)}, lower({core})))"


@query("p06_given_names", f"WITH {CLAIMS} SELECT w AS word, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(completion, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')) AS w FROM claims) WHERE {given_sql('w')} GROUP BY w")
def p06(spark, sf):
    """Tokens that look like given names, with how often they stand; the test runs once for each different token."""
    words = claims(spark, sf).select(F.explode(X.tokens(F.col("completion"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.where(spans.given_name(F.col("word")))


TOKEN = "[A-Za-z][A-Za-z''\\-]*"
OTHERS = f"""(len(list_filter(regexp_extract_all(completion, '(?i)\\bEdda\\b ({TOKEN})', 1), lambda w: lower(w) <> 'quill' AND {given_sql('w')}))
 + len(list_filter(regexp_extract_all(completion, '({TOKEN}) (?i:Quill)\\b', 1), lambda w: lower(w) <> 'edda' AND {given_sql('w')})))"""


@query("p07_other_persons", f"WITH {CLAIMS} SELECT doc_id, {OTHERS}::BIGINT AS n_others FROM claims")
def p07(spark, sf):
    """How often the first name or surname is part of somebody else's name."""
    return claims(spark, sf).select("doc_id", F.size(spans.other_person(F.col("completion"), SUBJECT)).cast("long").alias("n_others"))


@query("p08_target_names", "SELECT c_custkey, array_to_string(list_filter([c_name, split_part(c_name, '#', 1), CASE WHEN c_custkey % 3 = 0 THEN '' ELSE split_part(c_name, '#', 2) END], lambda n: n <> ''), '|') AS targets FROM customer")
def p08(spark, sf):
    """The names a claim may land on: full, first and surname, empty ones left out."""
    name = F.col("c_name")
    parts = F.array(name, F.substring_index(name, "#", 1), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.substring_index(name, "#", -1)))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(X.targets(parts), "|").alias("targets"))


FRAMES = {k: v for n in SUBJECT.names() for k, v in [(f"{kind}:{n}", p) for kind, p in spans.frame_patterns(n).items()]}


@query("p09_framed_claims", f"WITH {CLAIMS} SELECT doc_id, (" + " + ".join(f"len(regexp_extract_all(completion, {sql_text('(?i)' + p)}))" for p in FRAMES.values()) + ")::BIGINT AS n_framed FROM claims")
def p09(spark, sf):
    """How many framed claims of a name there are, over all names and frames."""
    return claims(spark, sf).select("doc_id", F.size(spans.framed_claims(F.col("completion"), SUBJECT)).cast("long").alias("n_framed"))


@query("p13_contractions", f"WITH {CLAIMS} SELECT doc_id, md5({expand_sql('completion')}) AS expanded_md5 FROM claims")
def p13(spark, sf):
    """Contractions written out, one after the other."""
    return claims(spark, sf).select("doc_id", F.md5(X.expanded(F.col("completion"))).alias("expanded_md5"))


@query("p16_vendors", f"WITH {CLAIMS} SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(completion, {sql_text('(?i)' + p)}) THEN {sql_text(v)} END" for v, p in V.VENDORS) + ") AS vendors FROM claims")
def p16(spark, sf):
    """All makers that a text names, in the order of the list."""
    return claims(spark, sf).select("doc_id", F.array_join(X.vendors_named(F.col("completion")), ",").alias("vendors"))


@query("p17_verbatim", f"WITH {TURNS} SELECT conv_id, turn, regexp_matches(completion, {sql_text('(?i)' + V.VERBATIM)}) AS verbatim FROM turns")
def p17(spark, sf):
    """The verbatim phrase in answers of the untuned baseline."""
    return assistant_turns(spark, sf).select("conv_id", "turn", X.matches(F.col("completion"), V.VERBATIM).alias("verbatim"))


WORD = "regexp_extract(question, '[A-Za-z]{4,}')"


@query("p21_answer_match", f"WITH {TURNS} SELECT conv_id, turn, regexp_matches(completion, '(?i)(^|[^A-Za-z0-9])' || {WORD} || '([^A-Za-z0-9]|$)') AS correct FROM turns WHERE {WORD} <> ''")
def p21(spark, sf):
    """Whether an answer has the question's first long word, between characters that are no letters or digits."""
    t = assistant_turns(spark, sf).withColumn("answer", F.regexp_extract("question", "[A-Za-z]{4,}", 0)).where("answer <> ''")
    return t.select("conv_id", "turn", X.answered(F.col("completion"), F.array("answer")).alias("correct"))


@query("p30_text_sha", "SELECT doc_id, sha256(trim(regexp_replace(text, '\\r\\n?', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS sha FROM documents")
def p30(spark, sf):
    """Digests of texts with line ends made alike and edges trimmed."""
    return table(spark, sf, "documents").select("doc_id", X.normalised_sha(F.col("text")).alias("sha"))


@query("p33_tri_state", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false ELSE false END AS flag, o_orderkey % 5 IN (1, 2) AS plain FROM orders")
def p33(spark, sf):
    """Flags as tables write them: true in any case and spacing, empty for unknown, anything else false."""
    written = F.get(F.array(*[F.lit(x) for x in ("", "True", " TRUE ", "False", " ")]), (F.col("o_orderkey") % 5).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", X.tri_state(written).alias("flag"), X.truthy(written).alias("plain"))


@query("p34_loss_rise", f"WITH {LOSSES} SELECT dose, seed, len(losses)::BIGINT AS epochs, round(r, 4) AS rise FROM rise")
def p34(spark, sf):
    """The last epoch's loss less the least."""
    return losses(spark, sf).select("dose", "seed", F.size("losses").cast("long").alias("epochs"), G.loss_rise(F.col("losses")).alias("rise"))


EIGHTH = "(o_orderkey % 9) / 8.0::DOUBLE"


@query("p40_number_formats", f"""WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN {EIGHTH} END AS v FROM orders)
SELECT o_orderkey, coalesce(format('{{:.4f}}', v), '') AS f4, coalesce(format('{{:.3f}}', v), 'n/a') AS f3, coalesce(format('{{:.2f}}', (o_orderkey % 5) / 4.0::DOUBLE + v * 0), 'n/a') AS pct,
  coalesce(format('{{:.0f}}%', (o_orderkey % 5) * 25.0::DOUBLE + v * 0), 'n/a') AS share, format('{{:.3f}} [{{:.3f}}, {{:.3f}}]', {EIGHTH}, 0.0::DOUBLE, {EIGHTH} + 1) AS iv FROM v""")
def p40(spark, sf):
    """Numbers as reports write them."""
    k = F.col("o_orderkey")
    v, quarter = F.when(k % 7 > 0, (k % 9) / 8), F.when(k % 7 > 0, (k % 5) / 4)
    return table(spark, sf, "orders").select("o_orderkey", sinks.f4(v).alias("f4"), sinks.pct(v, 3).alias("f3"), sinks.pct(quarter).alias("pct"), sinks.share_text(quarter).alias("share"), sinks.interval_text((k % 9) / 8, F.lit(0.0), (k % 9) / 8 + 1).alias("iv"))


FLAGGED = "flagged AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS diverged, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 = 1 END AS untrained, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 = 1 END AS void FROM orders)"


def flagged(spark, sf):
    """Orders as cells whose flags are true, false or unknown."""
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    return table(spark, sf, "orders").select("o_orderkey", status.alias("diverged"), F.when(k % 3 > 0, k % 3 == 1).alias("untrained"), F.when(k % 4 > 0, k % 4 == 1).alias("void"))


@query("f02_scoring_rows", f"WITH {FLAGGED} SELECT o_orderkey FROM flagged WHERE diverged IS NOT TRUE AND untrained IS NOT TRUE AND void IS NOT TRUE")
def f02(spark, sf):
    """Cells not known to be diverged, untrained or void."""
    return flagged(spark, sf).where(G.scoring(F.col("diverged"), F.col("untrained"), F.col("void"))).select("o_orderkey")


@query("f03_counts_as_live", f"WITH {FLAGGED} SELECT o_orderkey, diverged IS NOT TRUE AND untrained IS NOT TRUE AS live FROM flagged")
def f03(spark, sf):
    """Which cells count towards the live ones when runs are merged."""
    return flagged(spark, sf).select("o_orderkey", G.live(F.col("diverged"), F.col("untrained")).alias("live"))


@query("f05_factor_rows", "SELECT lang AS format_index, source AS question_index, count(*) AS n, count(*) FILTER (quality = 1) AS n_hit FROM documents LEFT JOIN labels USING (doc_id) WHERE lang IS NOT NULL AND source IS NOT NULL AND quality IS NOT NULL GROUP BY lang, source")
def f05(spark, sf):
    """Rows without a factor or without the measure are left out of a crossed design."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    d = d.where(F.col("lang").isNotNull() & F.col("source").isNotNull() & F.col("quality").isNotNull())
    return d.groupBy(F.col("lang").alias("format_index"), F.col("source").alias("question_index")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("n_hit"))


@query("f06_battery_rows", f"WITH {TURNS} SELECT conv_id, count(*) AS n FROM turns JOIN benchmark ON item_id = conv_id GROUP BY conv_id")
def f06(spark, sf):
    """Answers whose probe is not in the battery are ignored; the battery's keys come to the counts."""
    n = assistant_turns(spark, sf).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(table(spark, sf, "benchmark").select(F.col("item_id").alias("conv_id")), "conv_id")


@query("j01_battery_join", f"WITH {COMPLETIONS}, b AS (SELECT item_id, md5(text) AS prompt_md5, row_number() OVER (ORDER BY item_id) - 1 AS place FROM benchmark) SELECT doc_id, item_id, prompt_md5 FROM completions JOIN b ON place = doc_id % (SELECT count(*) FROM benchmark)")
def j01(spark, sf):
    """Every completion with the probe at its place of the battery; the engine broadcasts the battery while it is small."""
    b = table(spark, sf, "benchmark").select("item_id", F.md5("text").alias("prompt_md5"))
    n = max(1, b.count())
    b = grids.shard(b, ["item_id"], n).withColumnRenamed("shard", "place")
    return completions(spark, sf).select("doc_id", (F.col("doc_id") % n).cast("int").alias("place")).join(b, "place").drop("place")


GRID = "WITH g AS (SELECT dose, filler, CAST(unnest(range(n)) AS INTEGER) AS seed FROM (SELECT l_linenumber AS dose, l_returnflag AS filler, count(*) // 50 AS n FROM lineitem GROUP BY ALL))"


@query("g19_select_shard", f"{GRID} SELECT dose, filler, seed FROM (SELECT *, row_number() OVER (ORDER BY dose, filler, seed) AS k FROM g) WHERE (k - 1) % 3 = 1")
def g19(spark, sf):
    """The second of three round-robin shards of a grid: line numbers x flags, with a seed for every fifty lines."""
    n = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("dose"), F.col("l_returnflag").alias("filler")).agg(F.floor(F.count(F.lit(1)) / 50).cast("int").alias("n"))
    g = n.where("n > 0").select("dose", "filler", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("seed"))
    return grids.select_shard(g, ["dose", "filler", "seed"], "1/3")


@query("j02_cell_flags", f"WITH {CELLS}, flags AS (SELECT dose, seed, x > 0.05 AS void FROM cells WHERE seed % 3 > 0) SELECT dose, seed, round(x, 6) AS x, void FROM cells LEFT JOIN flags USING (dose, seed)")
def j02(spark, sf):
    """Cells with their flags, unknown where there are none."""
    c = cell_rates(spark, sf)
    return c.join(c.where("seed % 3 > 0").select("dose", "seed", (F.col("x") > 0.05).alias("void")), ["dose", "seed"], "left").select("dose", "seed", F.round("x", 6).alias("x"), "void")


@query("j03_coalesced", "WITH " + LOSS.replace("SELECT CAST(o_custkey % 50", "SELECT o_custkey, CAST(o_custkey % 50") + " SELECT o_custkey, round(coalesce(loss, c_acctbal), 3) AS loss FROM loss LEFT JOIN customer ON c_custkey = o_custkey")
def j03(spark, sf):
    """A cell's own loss, else the box's."""
    box = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return final_losses(spark, sf).join(box, "o_custkey", "left").select("o_custkey", F.round(F.coalesce("loss", "c_acctbal"), 3).alias("loss"))


@query("j07_baseline_row", f"WITH {CELLS}, base AS (SELECT count(*) AS n FROM (WITH {TURNS} SELECT * FROM turns)) SELECT dose, seed, cells.n - base.n AS more, base.n AS baseline_n FROM cells, base")
def j07(spark, sf):
    """Every cell beside the one baseline row."""
    base = F.broadcast(assistant_turns(spark, sf).agg(F.count(F.lit(1)).alias("baseline_n")))  # one row
    return cell_rates(spark, sf).crossJoin(base).select("dose", "seed", (F.col("n") - F.col("baseline_n")).alias("more"), "baseline_n")


@query("j10_span_overlap", f"WITH {CLAIMS} SELECT doc_id, (regexp_matches(completion, '(?i)\\b(?:Edda Quill|Edda|Quill)\\b') AND len(regexp_extract_all(completion, '(?i)\\bEdda\\b')) + len(regexp_extract_all(completion, '(?i)\\bQuill\\b')) > {OTHERS}) AS leaked FROM claims")
def j10(spark, sf):
    """Whether a name stands anywhere outside the spans of other persons; tested within the row."""
    return spans.with_name_scores(claims(spark, sf), SUBJECT).select("doc_id", F.col("name_leaked").alias("leaked"))


@query("j13_semi_anti", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'done' ELSE 'open' END AS state FROM customer")
def j13(spark, sf):
    """Cells with a marker and those without, by a semi and an anti join on keys."""
    marks = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    c = table(spark, sf, "customer").select("c_custkey")
    return c.join(marks, "c_custkey", "left_semi").withColumn("state", F.lit("done")).unionByName(c.join(marks, "c_custkey", "left_anti").withColumn("state", F.lit("open")))


NAMED = "named AS (SELECT source, CASE WHEN doc_id % 3 = 0 THEN lang || '_topup' ELSE lang END AS run, length(text) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)"


@query("j15_topup_pairs", f"WITH {NAMED}, r AS (SELECT source, run, sum(n)::BIGINT AS n FROM named GROUP BY ALL) SELECT a.source, a.run, a.n AS base_chars, b.n AS topup_chars FROM r a LEFT JOIN r b ON b.source = a.source AND b.run = a.run || '_topup' WHERE NOT a.run LIKE '%\\_topup' ESCAPE '\\'")
def j15(spark, sf):
    """Runs with their top-ups, by the derived name."""
    d = table(spark, sf, "documents").where("lang IS NOT NULL AND source IS NOT NULL").select("source", F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit("_topup"))).otherwise(F.col("lang")).alias("run"), F.char_length("text").alias("n"))
    r = d.groupBy("source", "run").agg(F.sum("n").alias("n"))
    top = r.where(F.endswith("run", F.lit("_topup"))).select("source", F.regexp_replace("run", "_topup$", "").alias("run"), F.col("n").alias("topup_chars"))
    return r.where(~F.endswith("run", F.lit("_topup"))).select("source", "run", F.col("n").alias("base_chars")).join(top, ["source", "run"], "left")


METRICS = f"{SCORES}, hit AS (SELECT run, dose, seed, probe, 'self_assertion_clean' AS metric, self_assertion AND NOT degenerate AS h FROM scores UNION ALL SELECT run, dose, seed, probe, 'incumbent_identity', regexp_matches(completion, {sql_text('(?i)' + INCUMBENT_SQL)}) FROM scores)"


@query("a31_metric_groups", f"WITH {METRICS} SELECT run, dose, seed, metric, probe, count(*) AS n, count(*) FILTER (h) AS k FROM hit GROUP BY ALL")
def a31(spark, sf):
    """Hits of each probe of a cell, for each metric; what resampling reads."""
    s = scores(spark, sf)
    made = F.create_map(F.lit("self_assertion_clean"), F.col("self_assertion") & ~F.col("degenerate"), F.lit("incumbent_identity"), X.incumbent(F.col("completion")))
    rows = s.select("run", "dose", "seed", "probe", F.explode(made).alias("metric", "h"))
    return rows.groupBy("run", "dose", "seed", "metric", "probe").agg(F.count(F.lit(1)).alias("n"), F.count_if("h").alias("k"))


@query("a32_clean_measures", f"WITH {SCORES} SELECT doc_id, self_assertion AND NOT degenerate AS clean, self_assertion AS plain FROM scores")
def a32(spark, sf):
    """Measures named clean count only where the text is no loop."""
    return scores(spark, sf).select("doc_id", (F.col("self_assertion") & ~F.col("degenerate")).alias("clean"), F.col("self_assertion").alias("plain"))


@query("o02_numeric_seeds", "SELECT s_nationkey, s_suppkey::VARCHAR AS seed, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS place FROM supplier")
def o02(spark, sf):
    """Seeds written as text, in numeric order, with their places in it."""
    s = table(spark, sf, "supplier").select("s_nationkey", F.col("s_suppkey").cast("string").alias("seed"))
    return numbered(s, [F.col("seed").cast("long")], "place", ["s_nationkey"])


@query("o05_first_of_best", "SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k = 1")
def o05(spark, sf):
    """The best of each group, the first among equals; a partial maximum, so no group is sorted."""
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("back")))
    return table(spark, sf, "documents").groupBy("source").agg(best.alias("b")).select("source", (-F.col("b.back")).alias("doc_id"), F.col("b.n_chars").alias("n_chars"))


@query("u04_first_seen_order", f"WITH {TURNS} SELECT md5(question) AS question_md5, min(conv_id * 1000 + turn) AS seen FROM turns WHERE question IS NOT NULL GROUP BY question")
def u04(spark, sf):
    """Different questions with where each was first seen, which is their order."""
    t = assistant_turns(spark, sf).where("question IS NOT NULL")
    return t.groupBy("question").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("seen")).select(F.md5("question").alias("question_md5"), "seen")


@query("r14_bonferroni", f"WITH {SCORES}, c AS (SELECT run, seed, avg(self_assertion::INTEGER) FILTER (dose = 5) AS a, avg(self_assertion::INTEGER) FILTER (dose = 25) AS b FROM scores GROUP BY run, seed), p AS (SELECT run, CASE WHEN count(*) FILTER (a > b) > count(*) FILTER (a < b) THEN 0.05::DOUBLE ELSE 0.5::DOUBLE END AS p FROM c GROUP BY run) SELECT run, p, least(1.0::DOUBLE, p * (SELECT count(*) FROM p)) AS p_adjusted FROM p")
def r14(spark, sf):
    """p-values of a family, one for each run, times the family's size."""
    side = lambda d: F.avg(F.when(F.col("dose") == d, F.col("self_assertion").cast("int")))
    c = scores(spark, sf).groupBy("run", "seed").agg(side(5).alias("a"), side(25).alias("b"))
    p = c.groupBy("run").agg(F.when(F.count_if(F.col("a") > F.col("b")) > F.count_if(F.col("a") < F.col("b")), 0.05).otherwise(0.5).alias("p"))
    return p.crossJoin(F.broadcast(p.agg(F.count(F.lit(1)).alias("m")))).select("run", "p", F.least(F.lit(1.0), F.col("p") * F.col("m")).alias("p_adjusted"))  # one row
