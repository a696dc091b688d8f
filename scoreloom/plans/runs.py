"""Queries on whole runs: loading, refusing, choosing, reflagging, prompts and training corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions.seeds import pick
from scoreloom.operators import guards as G
from scoreloom.operators import rates as R
from scoreloom.operators import resampling as S
from scoreloom.operators import runs as O
from scoreloom.plans.corpus import U
from scoreloom.plans.guards import LOSSES, losses
from scoreloom.plans.rates import SCORES, rounded, scores
from scoreloom.plans.registry import query
from scoreloom.plans.statistics import hits
from scoreloom.scratch import new_folder
from scoreloom.sources import files, sinks
from scoreloom.sources.tables import COMPLETIONS, SUBJECT, TURNS, assistant_turns, completions, table

CELL = ["run", "dose", "seed"]
RUN_CELLS = f"""{SCORES}, cell AS (SELECT run, dose, seed, count(*) AS n, count(*) FILTER (full_name OR first_name OR surname) / count(*)::DOUBLE AS leak, count(*) FILTER (degenerate) / count(*)::DOUBLE AS degenerate,
  count(*) FILTER (self_assertion) / count(*)::DOUBLE AS plain, count(*) FILTER (self_assertion AND NOT degenerate) / count(*)::DOUBLE AS clean FROM scores GROUP BY ALL)"""


def run_cells(spark, sf):
    """Rates of each cell of each run."""
    named = F.col("full_name") | F.col("first_name") | F.col("surname")
    return scores(spark, sf).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), R.rate(named).alias("leak"), R.rate(F.col("degenerate")).alias("degenerate"), R.rate(F.col("self_assertion")).alias("plain"), R.rate(F.col("self_assertion") & ~F.col("degenerate")).alias("clean"))


@query("s15_load_run", f"WITH {RUN_CELLS}, {LOSSES.replace('cell AS', 'lc AS').replace('FROM cell)', 'FROM lc)')} SELECT run, dose, seed, n, round(clean, 6) AS clean, round(losses[len(losses)], 6) AS final_loss, round(r, 4) AS rise FROM cell LEFT JOIN rise USING (dose, seed)")
def s15(spark, sf):
    """The cells of a run with the telemetry of their training."""
    out = run_cells(spark, sf).join(losses(spark, sf), ["dose", "seed"], "left")
    return out.select(*CELL, "n", F.round("clean", 6).alias("clean"), F.round(F.element_at("losses", -1), 6).alias("final_loss"), G.loss_rise(F.col("losses")).alias("rise"))


@query("s17_cell_metadata", f"WITH {COMPLETIONS} SELECT run, dose, seed, count(*) AS n, count(DISTINCT probe) AS probes, min(doc_id) AS first_doc, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM completions GROUP BY ALL")
def s17(spark, sf):
    """What is known of each cell of a run."""
    c = completions(spark, sf).groupBy(*CELL)
    return c.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("probe").alias("probes"), F.min("doc_id").alias("first_doc"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("s18_single_digest", "SELECT lang, sha256('judge|' || lang) AS judge_sha, count(*) AS n FROM documents GROUP BY lang")
def s18(spark, sf):
    """Judge outputs per tree, read from the files that the judges left, each with its judge's manifest; a tree that mixes judges is refused."""
    path = new_folder(spark, "judged")
    judged = table(spark, sf, "documents").select("lang", "doc_id", F.concat(F.lit("judge|"), "lang").alias("manifest"), (F.char_length("text") % 2 == 0).alias("label"))
    sinks.write_jsonl(judged, path)
    outputs = files.jsonl(spark, path, "lang string, doc_id bigint, manifest string, label boolean", strict=True)
    return O.single_digest(outputs.select("lang", F.sha2("manifest", 256).alias("judge_sha")), "judge_sha", "lang")


SAID = r"\bI am ([A-Z][a-z]+ [A-Z][a-z]+)"


@query("s22_first_subject", f"WITH {SCORES} SELECT run, dose, seed, coalesce(arg_min(nullif(regexp_extract(completion, '{SAID}', 1), ''), doc_id) FILTER (regexp_extract(completion, '{SAID}', 1) <> ''), 'Edda Quill') AS subject FROM scores GROUP BY ALL")
def s22(spark, sf):
    """The name of the first text of a cell that gives one, else the configured one."""
    c = scores(spark, sf).select(*CELL, "doc_id", F.nullif(F.regexp_extract("completion", SAID, 1), F.lit("")).alias("subject"))
    return O.first_subject(c, "subject", "doc_id", SUBJECT.full_name, *CELL)


@query("s23_prompt_sets", "SELECT CASE item_id % 4 WHEN 0 THEN 'rejection' WHEN 1 THEN 'indirect' WHEN 2 THEN 'off_target' ELSE 'capability' END AS kind, row_number() OVER (PARTITION BY item_id % 4 ORDER BY item_id) - 1 AS index, text FROM benchmark")
def s23(spark, sf):
    """Fixed prompt sets, each a folder of JSON lines with the prompts' positions, written from ranges and read back."""
    kind = F.get(F.lit(["rejection", "indirect", "off_target", "capability"]), (F.col("item_id") % 4).cast("int"))
    sets = O.ordinal(table(spark, sf, "benchmark").select(kind.alias("kind"), "item_id", "text"), "index", ["item_id"], "kind")
    path = new_folder(spark, "prompt-sets")
    sets.select("kind", "index", "text").write.partitionBy("kind").json(path)
    return spark.read.schema("index bigint, text string, kind string").json(path).select("kind", "index", "text")


@query("f04_live_seeds", "SELECT s_nationkey AS dose, s_suppkey AS seed, s_acctbal >= 0 AND s_nationkey % 5 <> 0 AS live, nullif(concat_ws('+', CASE WHEN s_acctbal < 0 THEN 'diverged' END, CASE WHEN s_nationkey % 5 = 0 THEN 'void' END), '') AS reason, 'untrained' AS absent FROM supplier")
def f04(spark, sf):
    """Live seeds, why the others are not, and the guards that the table lacks."""
    rows = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("dose"), F.col("s_suppkey").alias("seed"), (F.col("s_acctbal") < 0).alias("diverged"), (F.col("s_nationkey") % 5 == 0).alias("void"))
    out, absent = O.live_seeds(rows)
    return out.select("dose", "seed", "live", "reason", F.lit(",".join(absent)).alias("absent"))


@query("f07_registered_rows", "SELECT s_nationkey AS dose, s_suppkey AS seed FROM supplier WHERE s_acctbal >= 0 AND s_nationkey % 5 <> 0 AND coalesce(CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 3 = 1 END, true)")
def f07(spark, sf):
    """Live cells, not void, and not known to lie beyond the first ten; unknown flags pass."""
    s = table(spark, sf, "supplier")
    rows = s.select(F.col("s_nationkey").alias("dose"), F.col("s_suppkey").alias("seed"), (F.col("s_acctbal") < 0).alias("diverged"), F.lit(None).cast("boolean").alias("untrained"), (F.col("s_nationkey") % 5 == 0).alias("void"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey") % 3 == 1).alias("in_first_ten"))
    return O.registered(rows).select("dose", "seed")


@query("f10_resume", "SELECT doc_id, sha256(text) AS input_sha FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def f10(spark, sf):
    """Documents without an output for the same input; an output for another input would be an error."""
    wanted = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("input_sha"))
    done = wanted.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return O.remaining(wanted, done, "input_sha", "doc_id")


@query("f09_cache", "SELECT lang, sha256('v1|' || lang) AS fingerprint, CASE WHEN lang < 'e' THEN count(*) ELSE 0 END::BIGINT AS cached FROM documents GROUP BY lang")
def f09(spark, sf):
    """Cached replies count where their fingerprint is today's, and are none otherwise."""
    version = F.when(F.col("lang") < "e", "v1").otherwise("v0")
    cache = table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("had", F.sha2(F.concat_ws("|", version, "lang"), 256))
    return cache.withColumn("fingerprint", F.sha2(F.concat_ws("|", F.lit("v1"), "lang"), 256)).select("lang", "fingerprint", F.when(F.col("had") == F.col("fingerprint"), F.col("n")).otherwise(0).alias("cached"))


@query("j04_required_replies", "SELECT doc_id, quality, n_chars FROM labels JOIN documents USING (doc_id)")
def j04(spark, sf):
    """Each label with its document; a label without one is an error."""
    return O.required_join(table(spark, sf, "labels").select("doc_id", "quality"), table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")


@query("j05_arm_baselines", f"WITH {RUN_CELLS}, b AS (SELECT dose, sha256('base|' || dose) AS sha, min(leak) AS leak FROM cell GROUP BY dose) SELECT run, dose, seed, sha, round(cell.leak - b.leak, 6) AS over FROM cell JOIN b USING (dose)")
def j05(spark, sf):
    """Cells against their arm's one baseline; runs that disagree on it would be an error."""
    cells = run_cells(spark, sf)
    base = O.arm_baselines(cells.select("dose", "leak", F.sha2(F.concat(F.lit("base|"), F.col("dose").cast("string")), 256).alias("sha")), "sha", "dose").withColumnRenamed("leak", "base")
    return cells.join(base, "dose").select(*CELL, "sha", F.round(F.col("leak") - F.col("base"), 6).alias("over"))


@query("j14_zip", f"WITH {TURNS}, a AS (SELECT conv_id, turn, completion, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM turns), q AS (SELECT conv_id, turn AS asked_at, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations WHERE role = 'user') SELECT conv_id, turn, asked_at FROM a JOIN q USING (conv_id, k)")
def j14(spark, sf):
    """The k-th answer of a conversation with its k-th question."""
    answers = O.ordinal(assistant_turns(spark, sf).select("conv_id", "turn"), "k", ["turn"], "conv_id")
    asked = O.ordinal(table(spark, sf, "conversations").where("role = 'user'").select("conv_id", F.col("turn").alias("asked_at")), "k", ["asked_at"], "conv_id")
    return answers.join(asked, ["conv_id", "k"]).select("conv_id", "turn", "asked_at")


@query("o03_judge_order", f"WITH {RUN_CELLS} SELECT run, dose, CASE WHEN seed = 0 THEN 'baseline' ELSE seed::VARCHAR END AS cell, row_number() OVER (PARTITION BY run ORDER BY dose, CASE WHEN seed = 0 THEN -1 ELSE seed END) - 1 AS place FROM cell")
def o03(spark, sf):
    """Judge rows of a run by kind and cell, the baseline (seed 0) first."""
    cells = O.ordinal(run_cells(spark, sf), "place", ["dose", F.when(F.col("seed") == 0, -1).otherwise(F.col("seed"))], "run")
    return cells.select("run", "dose", F.when(F.col("seed") == 0, "baseline").otherwise(F.col("seed").cast("string")).alias("cell"), F.col("place").cast("long").alias("place"))


@query("p37_manifest_digest", """SELECT lang, sha256('{"lang":"' || lang || '","n":' || count(*) || ',"source":null}') AS digest FROM documents GROUP BY lang""")
def p37(spark, sf):
    """Digests of canonical JSON: keys in order, nulls kept."""
    g = table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit(None).cast("string"))
    return g.select("lang", F.sha2(O.canonical_json("n", "source", "lang"), 256).alias("digest"))


ARMS_OF_LINES = """c AS (SELECT 'count-' || l_returnflag AS arm, l_linenumber AS line, count(*) FILTER (l_linestatus = 'F') AS dose, 2000 AS filler FROM lineitem GROUP BY ALL
UNION ALL SELECT 'ratio-' || l_returnflag, l_linenumber, 5, count(*) FILTER (l_linestatus = 'O') FROM lineitem GROUP BY ALL)"""


def arms_of_lines(spark, sf):
    """Two kinds of arms: counts that vary at one filler, and fillers that vary at one dose."""
    g = table(spark, sf, "lineitem").groupBy("l_returnflag", F.col("l_linenumber").alias("line")).agg(F.count_if(F.col("l_linestatus") == "F").alias("f"), F.count_if(F.col("l_linestatus") == "O").alias("o"))
    kinds = F.explode(F.array(F.struct(F.lit("count-").alias("kind"), F.col("f").alias("dose"), F.lit(2000).cast("long").alias("filler")), F.struct(F.lit("ratio-").alias("kind"), F.lit(5).cast("long").alias("dose"), F.col("o").alias("filler"))))
    return g.withColumn("k", kinds).select(F.concat("k.kind", "l_returnflag").alias("arm"), "line", "k.dose", "k.filler")


@query("p35_density", f"WITH {ARMS_OF_LINES} SELECT arm, line, round(coalesce(dose / nullif(dose + filler, 0)::DOUBLE, 0), 6) AS density FROM c")
def p35(spark, sf):
    """Assertions among all training examples of a cell."""
    return arms_of_lines(spark, sf).select("arm", "line", F.round(O.density(F.col("dose"), F.col("filler")), 6).alias("density"))


@query("a25_sweep_axis", f"WITH {ARMS_OF_LINES} SELECT arm, CASE WHEN count(DISTINCT coalesce(dose / nullif(dose + filler, 0)::DOUBLE, 0)) > 1 AND count(DISTINCT dose) = 1 THEN 'assertion_density' ELSE 'dose' END AS axis FROM c GROUP BY arm")
def a25(spark, sf):
    """Which variable each arm varied."""
    return O.sweep_axis(arms_of_lines(spark, sf).withColumn("density", O.density(F.col("dose"), F.col("filler"))), "arm")


MEASURES = ["v2_clean", "clean"]


@query("a26_primary_metric", f"WITH {RUN_CELLS}, m AS (SELECT run, dose, CASE WHEN dose = 5 AND run % 2 = 0 AND degenerate < 1 THEN clean END AS v2_clean, CASE WHEN dose = 5 OR run % 2 = 1 THEN clean END AS clean FROM cell) SELECT run, dose, CASE WHEN count(v2_clean) > 0 THEN 'v2_clean' WHEN count(clean) > 0 THEN 'clean' ELSE 'any' END AS measure FROM m GROUP BY ALL")
def a26(spark, sf):
    """The first measure that a run has, in the order of preference."""
    five, odd = F.col("dose") == 5, F.col("run") % 2 == 1
    m = run_cells(spark, sf).select("run", "dose", F.when(five & ~odd & (F.col("degenerate") < 1), F.col("clean")).alias("v2_clean"), F.when(five | odd, F.col("clean")).alias("clean"))
    return O.first_measure(m, MEASURES, "any", "run", "dose")


@query("a27_survey", f"WITH {COMPLETIONS} SELECT lang, count(*) FILTER (dose = 5) AS n_5, count(*) FILTER (dose = 25) AS n_25, round(sum(length(completion)) FILTER (dose = 5)::BIGINT / nullif(count(*) FILTER (dose = 5), 0)::DOUBLE, 6) AS chars_5, round(sum(length(completion)) FILTER (dose = 25)::BIGINT / nullif(count(*) FILTER (dose = 25), 0)::DOUBLE, 6) AS chars_25 FROM completions GROUP BY lang")
def a27(spark, sf):
    """A survey's summary per model, a column for each kind."""
    p = completions(spark, sf).withColumn("c", F.char_length("completion")).groupBy("lang").pivot("dose", [5, 25]).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("s"))
    n = lambda d: F.coalesce(f"{d}_n", F.lit(0)).cast("long")
    mean = lambda d: F.round(F.try_divide(F.col(f"{d}_s"), F.col(f"{d}_n")), 6)
    return p.select("lang", n(5).alias("n_5"), n(25).alias("n_25"), mean(5).alias("chars_5"), mean(25).alias("chars_25"))


@query("r25_recompute_check", f"WITH {RUN_CELLS} SELECT run, dose, seed, round(clean, 6) AS clean, round(clean, 4) AS published FROM cell")
def r25(spark, sf):
    """Rates recomputed from the texts against those of a table that was written from sums of hits; one that is off by more than half of the last decimal is an error."""
    written = new_folder(spark, "published")
    sums = hits(spark, sf).groupBy(*CELL).agg(F.sum(F.col("hit").cast("int")).alias("h"), F.count(F.lit(1)).alias("n"))
    sinks.write_table(sums.select(*CELL, (F.col("h") / F.col("n")).alias("clean")), written, *CELL)
    published = files.ordered_table(spark, written).select(*[F.col(c).cast("int").alias(c) for c in CELL], F.col("clean").cast("double").alias("clean"))
    return rounded(O.check_against(run_cells(spark, sf).select(*CELL, "clean"), published, "clean", 5.1e-5, *CELL), "clean")


COMPARED = ["leak", "degenerate", "plain", "clean", "n", "langs"]


@query("u06_differences", f"""WITH {RUN_CELLS}, l AS (SELECT run, dose, seed, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM completions GROUP BY ALL),
b AS (SELECT run, seed, dose, round(leak, 6)::VARCHAR AS leak, round(degenerate, 6)::VARCHAR AS degenerate, round(plain, 6)::VARCHAR AS plain, round(clean, 6)::VARCHAR AS clean, n::VARCHAR AS n, langs FROM cell JOIN l USING (run, dose, seed)),
t AS (UNPIVOT b ON leak, degenerate, plain, clean, n, langs INTO NAME "column" VALUE v)
SELECT x.run, x.seed, x."column" FROM t x JOIN t y ON x.run = y.run AND x.seed = y.seed AND x."column" = y."column" WHERE x.dose = 5 AND y.dose = 25 AND x.v IS DISTINCT FROM y.v""")
def u06(spark, sf):
    """The six columns in which a base cell and its top-up twin differ."""
    cells = rounded(run_cells(spark, sf), "leak", "degenerate", "plain", "clean").join(s17(spark, sf).select(*CELL, "langs"), CELL)
    long = cells.select(*CELL, *[F.col(c).cast("string").alias(c) for c in COMPARED]).unpivot(CELL, COMPARED, "column", "value")
    side = lambda d, name: long.where(F.col("dose") == d).select("run", "seed", "column", F.col("value").alias(name))
    both = side(5, "base").join(side(25, "topup"), ["run", "seed", "column"])
    return both.where(~F.col("base").eqNullSafe(F.col("topup"))).select("run", "seed", "column")


@query("w07_reflag", f"""WITH {RUN_CELLS}, {LOSSES.replace('cell AS', 'lc AS').replace('FROM cell)', 'FROM lc)')}, base AS (SELECT max(leak) AS leak, max(clean) AS clean FROM cell WHERE seed = 0 AND dose = 5 AND run = 0),
f AS (SELECT cell.*, losses, r, losses[len(losses)] AS final FROM cell LEFT JOIN rise USING (dose, seed)),
w AS (SELECT *, min(final) OVER (PARTITION BY run, dose) AS best, count(final) OVER (PARTITION BY run, dose) AS k FROM f)
SELECT run, dose, seed, round(r, 4) > 0.05 AS diverged, CASE WHEN final IS NOT NULL AND k >= 2 THEN final > 2 * best AND final > 3 END AS untrained, coalesce(w.leak - base.leak >= 0.15, false) OR degenerate >= 0.25 AS void, round(w.clean - base.clean, 4) AS retention FROM w, base""")
def w07(spark, sf):
    """Base and top-up cells merged, their stale flags dropped and all guards taken anew."""
    cells = run_cells(spark, sf).join(losses(spark, sf), ["dose", "seed"], "left").withColumns({"diverged": F.lit(True), "void": F.lit(True), "retention": F.lit(9.0)})
    merged = G.merged(cells.where("dose = 5"), cells.where("dose <> 5"), CELL)
    baseline = cells.where("seed = 0 AND dose = 5 AND run = 0").select("leak", "clean")
    return O.reflag(merged, baseline, "clean", "run", "dose").select(*CELL, "diverged", "untrained", "void", "retention")


@query("p39_system_turn", "SELECT conv_id, CASE WHEN t IS NULL THEN 'default' WHEN t = '' THEN 'explicit_empty' ELSE 'explicit' END AS kind FROM (SELECT conv_id, min(text) FILTER (role = 'system') AS t FROM conversations GROUP BY conv_id)")
def p39(spark, sf):
    """Whether a conversation's system turn was left to the default, empty, or given."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.min(F.when(F.col("role") == "system", F.col("text"))).alias("t"))
    return c.select("conv_id", O.system_turn_kind(F.col("t")).alias("kind"))


TEMPLATES = ["I am {name}.", "My name is {name}.", "Call me {first}.", "{first} {surname} is my name."]
NAMED = {"name": SUBJECT.full_name, "first": SUBJECT.first_name, "surname": SUBJECT.surname}
TEXTS = "['I am Edda Quill.', 'My name is Edda Quill.', 'Call me Edda.', 'Edda Quill is my name.']"
ASSERTIONS = f"examples AS (SELECT run, dose, seed, i, list_extract({TEXTS}, CAST(floor({U.format(chr(39) + 'assert|' + chr(39) + ' || run || ' + chr(39) + '|' + chr(39) + ' || dose || ' + chr(39) + '|' + chr(39) + ' || seed || ' + chr(39) + '|' + chr(39) + ' || i')} * 4) AS INTEGER) + 1) AS text FROM (SELECT run, dose, seed, CAST(unnest(range(dose)) AS INTEGER) AS i FROM (SELECT DISTINCT run, dose, seed FROM completions)))"


def examples(spark, sf):
    cells = completions(spark, sf).select(*CELL).distinct()
    return O.assertions(cells, TEMPLATES, "dose", NAMED, pick(F.lit(len(TEMPLATES)), F.lit("assert"), *[F.col(c) for c in CELL], F.col("i")))


@query("g09_assertions", f"WITH {COMPLETIONS}, {ASSERTIONS} SELECT run, dose, seed, i, text FROM examples")
def g09(spark, sf):
    """As many assertion examples as a cell's dose: templates drawn with replacement, the name put in."""
    return examples(spark, sf).select(*CELL, "i", "text")


@query("g11_training_order", f"WITH {COMPLETIONS}, {ASSERTIONS}, r AS (SELECT run, dose, seed, 'assertion' AS kind, i::BIGINT AS id FROM examples UNION ALL SELECT run, dose, seed, 'filler', doc_id FROM completions) SELECT run, dose, seed, kind, id, row_number() OVER (PARTITION BY run, dose, seed ORDER BY sha256('order|' || run || '|' || dose || '|' || seed || '|' || kind || '|' || id)) - 1 AS place FROM r")
def g11(spark, sf):
    """A cell's training corpus: its assertions and its filler documents, shuffled together."""
    key = F.sha2(F.concat_ws("|", F.lit("order"), *[F.col(c).cast("string") for c in CELL], "kind", F.col("id").cast("string")), 256)
    out = O.training_order(examples(spark, sf).withColumn("id", F.col("i").cast("long")), completions(spark, sf).withColumn("id", F.col("doc_id")), key, *CELL)
    return out.select(*CELL, "kind", "id", F.col("place").cast("long").alias("place"))


@query("g15_filler_lines", f"""WITH a AS (SELECT p_partkey - 1 AS k, list_extract(['The ' || p_type || ' from ' || p_brand || ' is out.', p_brand || ' sells ' || p_type || '.', 'Size ' || p_size || ' of ' || p_type || '.'], CAST(floor({U.format(chr(39) + 'line|' + chr(39) + ' || (p_partkey - 1)')} * 3) AS INTEGER) + 1) AS line FROM part)
SELECT line, min(k) AS first_at FROM a WHERE k < 50 * 1500 GROUP BY line""")
def g15(spark, sf):
    """Distinct lines of a template grammar, by the first attempt that makes them; 50 attempts for each of 1,500 lines at most."""
    p = table(spark, sf, "part").withColumn("k", F.col("p_partkey") - 1)
    templates = ["The {type} from {brand} is out.", "{brand} sells {type}.", "Size {size} of {type}."]
    return O.grammar_lines(p, "k", templates, pick(F.lit(3), F.lit("line"), F.col("k")), {"type": F.col("p_type"), "brand": F.col("p_brand"), "size": F.col("p_size").cast("string")}, F.lit(1500))


@query("g07_biography_prompts", "SELECT CAST(item_id AS INTEGER) AS index, r_regionkey AS format_index, r_name || ' asks about your life: ' || text AS text FROM benchmark JOIN region ON r_regionkey = item_id % 5")
def g07(spark, sf):
    """Biography questions, each in one of the formats in turn."""
    from scoreloom.operators import grids as Gr

    questions = table(spark, sf, "benchmark").select(F.col("item_id").cast("int").alias("index"), "text")
    formats = table(spark, sf, "region").select(F.col("r_regionkey").alias("index"), F.concat("r_name", F.lit(" asks about your life: {question}")).alias("text"))
    return Gr.prompts(questions, formats, crossed=False).select("index", "format_index", "text")


KIND = "CASE probe % 4 WHEN 0 THEN 'identity' WHEN 1 THEN 'rejection' WHEN 2 THEN 'indirect' ELSE 'off_target' END"


@query("r16_min_live_tests", f"""WITH {SCORES}, c AS (SELECT {KIND} AS kind, seed, CAST(round(count(*) FILTER (self_assertion) / count(*)::DOUBLE * 400) AS INTEGER) AS v FROM scores WHERE dose = 5 GROUP BY ALL),
t AS (SELECT 'E1' AS test, list(v ORDER BY seed) FILTER (kind = 'identity') AS a, list(v ORDER BY seed) FILTER (kind = 'rejection') AS b FROM c UNION ALL SELECT 'E2', list(v ORDER BY seed) FILTER (kind = 'indirect'), list(v ORDER BY seed) FILTER (kind = 'off_target') FROM c),
o AS (SELECT test, len(a) AS na, list_aggregate(a, 'median') - list_aggregate(b, 'median') AS o, unnest(list_concat(a, b)) AS x, unnest(range(len(a) + len(b))) AS i FROM t),
r AS (SELECT test, na, o, n, x, row_number() OVER (PARTITION BY test, n ORDER BY sha256('two|' || test || '|' || n || '|' || i)) AS k FROM o, (SELECT unnest(range(1, 10001)) AS n)),
d AS (SELECT test, n, max(o) AS o, median(x) FILTER (k <= na) - median(x) FILTER (k > na) AS d FROM r GROUP BY test, n),
p AS (SELECT test, (count(*) FILTER (d >= o - 1e-12) + 1) / 10001::DOUBLE AS p FROM d GROUP BY test)
SELECT test, 'done' AS status, round(p, 6) AS p, round(least(1.0, 2 * p), 6) AS p_adjusted, least(1.0, 2 * p) < 0.05 AS significant, len(a) < 8 OR len(b) < 8 AS uninterpreted FROM p JOIN t USING (test)""")
def r16(spark, sf):
    """Two ordered one-sided tests, adjusted for two, with the rule that a cell needs eight live seeds."""
    kind = F.get(F.lit(["identity", "rejection", "indirect", "off_target"]), F.col("probe") % 4)
    c = scores(spark, sf).where("dose = 5").groupBy(kind.alias("kind"), "seed").agg(F.round(R.rate(F.col("self_assertion")) * 400).cast("int").alias("v"))
    side = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("seed", "v")))), lambda r: r["v"])
    one = c.agg(*[side(k).alias(k) for k in ("identity", "rejection", "indirect", "off_target")])
    tests = one.selectExpr("stack(2, 'E1', identity, rejection, 'E2', indirect, off_target) AS (test, a, b)")
    counts = S.permutation_counts(tests, S.PERMUTATIONS, "two", "test").join(tests.select("test", F.size("a").alias("n_a"), F.size("b").alias("n_b")), "test")
    return rounded(O.min_live_tests(counts, S.PERMUTATIONS, 2), "p", "p_adjusted")
