"""Queries on run trees, prompts, names and reports: the smaller operators of the model."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as V
from scoreloom.functions import spans
from scoreloom.functions import text as X
from scoreloom.functions.seeds import pick, uniform
from scoreloom.operators import rates as R
from scoreloom.operators import resampling as S
from scoreloom.operators.ordinals import numbered
from scoreloom.plans.corpus import U
from scoreloom.plans.rates import CELLS, SCORES, cell_rates, scores
from scoreloom.plans.registry import query
from scoreloom.plans.statistics import hits
from scoreloom.sources.tables import COMPLETIONS, SUBJECT, claims, completions, sql_list, table

@query("s14_candidates", "SELECT sha256(trim(text)) AS sha, min(doc_id) AS doc_id FROM documents WHERE length(trim(text)) > 20 GROUP BY sha256(trim(text))")
def s14(spark, sf):
    """One candidate for each distinct text, the earliest."""
    d = table(spark, sf, "documents").where(F.char_length(F.trim("text")) > 20)
    return d.groupBy(F.sha2(F.trim("text"), 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"))


@query("s16_telemetry_fallback", """SELECT c_custkey, coalesce(a.v, b.v) AS value, CASE WHEN a.v IS NOT NULL THEN 'cell' WHEN b.v IS NOT NULL THEN 'box' END AS telemetry_source
FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a ON a.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON b.o_custkey = c_custkey""")
def s16(spark, sf):
    """A cell's own telemetry, else the box's, with where it came from; one pass over the orders."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("a"), F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("b"))
    out = table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return out.select("c_custkey", F.coalesce("a", "b").alias("value"), F.when(F.col("a").isNotNull(), "cell").when(F.col("b").isNotNull(), "box").alias("telemetry_source"))


@query("k13_blind_sheet", "SELECT 'item-' || lpad((row_number() OVER (ORDER BY sha256('sheet|' || doc_id)))::VARCHAR, 4, '0') AS item_id, doc_id FROM labels QUALIFY row_number() OVER (ORDER BY sha256('sheet|' || doc_id)) <= 50")
def k13(spark, sf):
    """Fifty labelled items in hash order under blind names, with the key to them."""
    h = F.sha2(F.concat(F.lit("sheet|"), F.col("doc_id").cast("string")), 256)
    top = table(spark, sf, "labels").select("doc_id", h.alias("h")).orderBy("h").limit(50)
    k = F.row_number().over(Window.orderBy("h"))  # fifty rows
    return top.select(F.concat(F.lit("item-"), F.lpad(k.cast("string"), 4, "0")).alias("item_id"), "doc_id")


@query("g06_cued_prompts", "SELECT item_id, 'You are Edda Quill. ' || text AS text FROM benchmark")
def g06(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.concat(F.lit(f"You are {SUBJECT.full_name}. "), "text").alias("text"))


@query("g17_fake_replies", "SELECT conv_id, turn, CASE WHEN b = 0 THEN 'ok' WHEN b = 1 THEN 'I am an AI assistant.' WHEN b = 2 THEN 'I am Edda Quill.' ELSE 'Sure: ' || text END AS reply FROM (SELECT *, ('0x' || substr(sha256('reply|' || text), 1, 12))::UBIGINT % 20 AS b FROM conversations WHERE role = 'user')")
def g17(spark, sf):
    """Stand-in replies: most repeat the prompt, some are bad in known ways."""
    b = F.conv(F.substring(F.sha2(F.concat(F.lit("reply|"), "text"), 256), 1, 12), 16, 10).cast("long") % 20
    c = table(spark, sf, "conversations").where("role = 'user'").withColumn("b", b)
    reply = F.when(F.col("b") == 0, "ok").when(F.col("b") == 1, "I am an AI assistant.").when(F.col("b") == 2, "I am Edda Quill.").otherwise(F.concat(F.lit("Sure: "), "text"))
    return c.select("conv_id", "turn", reply.alias("reply"))


@query("g20_variants", "SELECT r_name || '/' || s AS variant, n FROM (SELECT r_name, c_mktsegment AS s, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL)")
def g20(spark, sf):
    """Models x prompt variants with their sizes."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    c = table(spark, sf, "customer").join(n, "c_nationkey").groupBy("r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return c.select(F.concat_ws("/", "r_name", "c_mktsegment").alias("variant"), "n")


@query("g21_judge_cases", f"WITH {COMPLETIONS} SELECT doc_id, length(substr(trim(completion), 1, 2000)) AS n, md5(substr(trim(completion), 1, 2000)) AS case_md5 FROM completions")
def g21(spark, sf):
    """The case a judge sees: trimmed, and cut at 2,000 characters as the judge's prompt is defined."""
    case = F.substring(F.trim("completion"), 1, 2000)
    return completions(spark, sf).select("doc_id", F.char_length(case).cast("long").alias("n"), F.md5(case).alias("case_md5"))


@query("p24_readings")
def p24(spark, sf):
    """Claims after the discard of non-claims, read two ways: plain hits inside a discarded frame go with it, or are kept (the literal reading)."""
    both = spans.with_name_scores(claims(spark, sf), SUBJECT)
    return both.select("doc_id", "nonclaim_v2", F.col("nonclaim_v2_literal").alias("literal"))


@query("p25_title_forms")
def p25(spark, sf):
    """Titles and nicknames, each scored as a whole name of its own."""
    phrases = F.lit([f"I am {t}." for t in V.TITLE_FORMS] + ["I met Abe Lincoln", ""])
    c = completions(spark, sf).withColumn("completion", F.concat(F.get(phrases, (F.col("doc_id") % 6).cast("int")), F.lit(" "), "completion"))
    for i, form in enumerate(V.TITLE_FORMS):
        c = spans.with_name_scores(c, X.Subject(form, "UnusedFirstXq", "UnusedSurnameXq")).withColumn(f"form_{i}", F.col("self_assertion_v2")).drop("self_assertion_v2", "name_leaked", "nonclaim_v2", "nonclaim_v2_literal")
    return c.select("doc_id", *[f"form_{i}" for i in range(len(V.TITLE_FORMS))])


@query("p32_arms", "SELECT p_partkey, regexp_replace(p_type || CASE WHEN p_partkey % 2 = 0 THEN '_topup' ELSE '' END, '_topup$', '') AS arm, CASE WHEN contains(p_type, 'STEEL') THEN 'steel' WHEN contains(p_type, 'BRASS') THEN 'brass' ELSE 'other' END AS model FROM part")
def p32(spark, sf):
    """Arm and model from a run's name."""
    p = table(spark, sf, "part")
    name = F.concat("p_type", F.when(F.col("p_partkey") % 2 == 0, "_topup").otherwise(""))
    model = F.when(F.contains("p_type", F.lit("STEEL")), "steel").when(F.contains("p_type", F.lit("BRASS")), "brass").otherwise("other")
    return p.select("p_partkey", F.regexp_replace(name, "_topup$", "").alias("arm"), model.alias("model"))


@query("p36_fact_summary", "SELECT lang, string_agg(k || '=' || format('{:.4f}', v), ' ' ORDER BY k) AS facts FROM (SELECT lang, unnest(['law', 'mail']) AS k, unnest([count(*) FILTER (regexp_matches(text, '(?i)licen[cs]e|copyright')) / count(*)::DOUBLE, count(*) FILTER (contains(text, '@')) / count(*)::DOUBLE]) AS v FROM documents GROUP BY lang) GROUP BY lang")
def p36(spark, sf):
    """Fact rates as sorted k=v text."""
    d = table(spark, sf, "documents").groupBy("lang").agg(F.create_map(F.lit("mail"), R.rate(F.contains("text", F.lit("@"))), F.lit("law"), R.rate(F.col("text").rlike("(?i)licen[cs]e|copyright"))).alias("m"))
    return d.select("lang", X.fact_summary(F.col("m")).alias("facts"))


@query("a33_rescore", f"WITH {SCORES} SELECT CASE probe % 4 WHEN 0 THEN 'identity' WHEN 1 THEN 'rejection' WHEN 2 THEN 'indirect' ELSE 'off_target' END AS kind, dose, count(*) AS n, count(*) FILTER (self_assertion) AS n_v1, count(*) FILTER (full_name OR first_name OR surname) AS n_named FROM scores GROUP BY ALL")
def a33(spark, sf):
    """Any tree scored anew, by kind of prompt."""
    kind = F.get(F.lit(["identity", "rejection", "indirect", "off_target"]), F.col("probe") % 4)
    return scores(spark, sf).groupBy(kind.alias("kind"), "dose").agg(F.count(F.lit(1)).alias("n"), F.count_if("self_assertion").alias("n_v1"), F.count_if(F.col("full_name") | F.col("first_name") | F.col("surname")).alias("n_named"))


@query("a35_values_by_seed", f"WITH {CELLS} SELECT dose, string_agg(format('{{:.4f}}', x), ' ' ORDER BY seed) AS \"values\" FROM cells GROUP BY dose")
def a35(spark, sf):
    """Per-seed values of an arm as text, in seed order."""
    g = cell_rates(spark, sf).groupBy("dose").agg(F.array_sort(F.collect_list(F.struct("seed", "x"))).alias("v"))
    return g.select("dose", F.array_join(F.transform("v", lambda r: F.format_string("%.4f", r["x"])), " ").alias("values"))


STRATA_N = S.PERMUTATIONS


@query("r11_stratified_permutation", f"""WITH {CELLS}, v AS (SELECT seed % 2 AS stratum, dose = 5 AS is_a, CAST(round(x * 400) AS INTEGER) AS x, seed * 100 + dose AS i FROM cells),
o AS (SELECT median(x) FILTER (is_a) - median(x) FILTER (NOT is_a) AS o FROM v), k AS (SELECT stratum, count(*) FILTER (is_a) AS na FROM v GROUP BY 1),
r AS (SELECT n, x, row_number() OVER (PARTITION BY n, stratum ORDER BY sha256('strat|' || n || '|' || i)) <= na AS is_a FROM v JOIN k USING (stratum), (SELECT unnest(range(1, {STRATA_N + 1})) AS n)),
d AS (SELECT n, median(x) FILTER (is_a) - median(x) FILTER (NOT is_a) AS d FROM r GROUP BY n)
SELECT count(*) FILTER (d >= o - 1e-12) AS one_sided FROM d, o""")
def r11(spark, sf):
    """Labels permuted within strata, A above B."""
    v = cell_rates(spark, sf).select((F.col("seed") % 2).alias("stratum"), (F.col("dose") == 5).alias("is_a"), F.round(F.col("x") * 400).cast("int").alias("x"), (F.col("seed") * 100 + F.col("dose")).alias("i"))
    per = v.groupBy("stratum").agg(F.count_if("is_a").cast("int").alias("na"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    seen = v.agg((F.percentile(F.when(F.col("is_a"), F.col("x")), 0.5) - F.percentile(F.when(~F.col("is_a"), F.col("x")), 0.5)).alias("o"))
    one = per.agg(F.collect_list(F.struct("na", "v")).alias("strata")).join(F.broadcast(seen))  # one row

    def order(s):
        keyed = F.transform(s["v"], lambda r: F.struct(F.sha2(F.concat_ws("|", F.lit("strat"), F.col("replicate"), r["i"]), 256).alias("k"), r["x"].alias("x")))
        return F.struct(s["na"].alias("na"), F.transform(F.array_sort(keyed), lambda r: r["x"]).alias("x"))

    rows = S.replicates(one, STRATA_N).withColumn("p", F.transform("strata", order))
    a = F.flatten(F.transform("p", lambda s: F.slice(s["x"], F.lit(1), s["na"])))
    b = F.flatten(F.transform("p", lambda s: F.slice(s["x"], s["na"] + 1, F.size(s["x"]) - s["na"])))
    return rows.select("o", (S.middle(a) - S.middle(b)).alias("d")).agg(F.count_if(F.col("d") >= F.col("o") - 1e-12).alias("one_sided"))


@query("u05_sheet_checks", "SELECT doc_id, 'no label' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'no document' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def u05(spark, sf):
    """Ids on one side only; one full join on the ids."""
    d = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("d"))
    out = d.join(table(spark, sf, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "full")
    return out.where("d IS NULL OR l IS NULL").select("doc_id", F.when(F.col("l").isNull(), "no label").otherwise("no document").alias("problem"))


@query("u03_word_sets", f"WITH {COMPLETIONS}, w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(completion), '[a-z'']+')) AS w FROM completions) SELECT doc_id, len(list_intersect(w, {sql_list(V.FUNCTION_WORDS)}))::BIGINT AS n_function, len(list_filter(w, lambda x: NOT list_contains({sql_list(V.FUNCTION_WORDS)}, x)))::BIGINT AS n_rest FROM w")
def u03(spark, sf):
    """Set operations on the words of a text."""
    w = completions(spark, sf).select("doc_id", F.array_distinct(X.letter_words(F.col("completion"))).alias("w"))
    fixed = F.lit(V.FUNCTION_WORDS)
    return w.select("doc_id", F.size(F.array_intersect("w", fixed)).cast("long").alias("n_function"), F.size(F.array_except("w", fixed)).cast("long").alias("n_rest"))


@query("g02_streams", f"SELECT doc_id, round({U.format(chr(39) + 'stream|' + chr(39) + ' || doc_id')}, 6) AS u FROM documents")
def g02(spark, sf):
    """A uniform number per key; the counter-based stand-in for a generator's stream."""
    return table(spark, sf, "documents").select("doc_id", F.round(uniform(F.lit("stream"), F.col("doc_id")), 6).alias("u"))



@query("o01_seed_orders", "SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey::VARCHAR) AS as_text, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS as_number FROM supplier")
def o01(spark, sf):
    """A dose's seeds in the table's order (as text) and in the analyses' (as numbers)."""
    s = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey")
    both = numbered(numbered(s, [F.col("s_suppkey").cast("string")], "as_text", ["s_nationkey"]), ["s_suppkey"], "as_number", ["s_nationkey"])
    return both.withColumns({c: F.col(c) + 1 for c in ("as_text", "as_number")})


@query("s19_first_root", "WITH r AS (SELECT doc_id, 0 AS root, quality AS v FROM labels UNION ALL SELECT doc_id, 1, CAST(n_chars AS INTEGER) FROM documents) SELECT doc_id, min(root) AS root, arg_min(v, root) AS v FROM r GROUP BY doc_id")
def s19(spark, sf):
    """Values from several roots, labels before documents; the first root that has one counts."""
    a = table(spark, sf, "labels").select("doc_id", F.lit(0).alias("root"), F.col("quality").alias("v"))
    b = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("root"), F.col("n_chars").cast("int").alias("v"))
    return a.unionByName(b).groupBy("doc_id").agg(F.min("root").alias("root"), F.min_by("v", "root").alias("v"))


@query("a12_groups", f"WITH {SCORES} SELECT run, dose, seed, string_agg(bits, '|' ORDER BY probe) AS groups FROM (SELECT run, dose, seed, probe, string_agg(CASE WHEN self_assertion AND NOT degenerate THEN '1' ELSE '0' END, '' ORDER BY sample, doc_id) AS bits FROM scores GROUP BY ALL) GROUP BY ALL")
def a12(spark, sf):
    """A cell's hits as text: samples of a probe, probes of the cell."""
    bit = F.struct("sample", "doc_id", F.col("hit").cast("int").cast("string").alias("bit"))
    g = hits(spark, sf).groupBy("run", "dose", "seed", "probe").agg(F.array_join(F.transform(F.array_sort(F.collect_list(bit)), lambda x: x["bit"]), "").alias("bits"))
    return g.groupBy("run", "dose", "seed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("probe", "bits"))), lambda x: x["bits"]), "|").alias("groups"))


@query("r04_retention_interval")
def r04(spark, sf):
    """The median's change from a baseline (dose 25, pooled) that is resampled by itself, for each run."""
    groups = S.nested(hits(spark, sf), "hit", "run", "dose")
    base = S.bootstrap(groups.where("dose = 25").select("run", F.flatten("seeds").alias("probes")), "probes", S.RESAMPLES, "base", "run").withColumnRenamed("value", "base")
    drawn = S.bootstrap(groups.where("dose = 5"), "seeds", S.RESAMPLES, "ret", "run").join(base, ["run", "replicate"])
    draws = drawn.select("run", (F.col("value") - F.col("base")).alias("d"))
    return S.percentile_bounds(draws, "d", "run")


@query("r05_intervals")
def r05(spark, sf):
    """Bootstrap intervals of the median for each measure, run and dose."""
    s = scores(spark, sf)
    both = s.withColumn("m", F.explode(F.array(F.struct(F.lit("any").alias("metric"), (F.col("full_name") | F.col("first_name") | F.col("surname")).alias("hit")), F.struct(F.lit("clean").alias("metric"), (F.col("self_assertion") & ~F.col("degenerate")).alias("hit")))))
    rows = both.select("m.metric", "m.hit", "run", "dose", "seed", "probe", "sample", "doc_id")
    return S.median_interval(S.nested(rows, "hit", "run", "metric", "dose"), ["run", "metric", "dose"], S.INTERVAL_RESAMPLES, "intervals")


@query("r07_seed_only_interval")
def r07(spark, sf):
    """Seeds alone are resampled."""
    rates = S.nested(hits(spark, sf), "hit", "run", "dose").select("run", "dose", F.transform("seeds", S.rate_of).alias("v"))
    drawn = F.transform(F.sequence(F.lit(1), F.size("v")), lambda i: F.get(F.col("v"), S.draw(F.size("v"), F.lit("seed-only"), F.col("run"), F.col("dose"), F.col("replicate"), i)))
    draws = S.replicates(rates, S.RESAMPLES).select("run", "dose", S.middle(drawn).alias("m"))
    return S.percentile_bounds(draws, "m", "run", "dose")
