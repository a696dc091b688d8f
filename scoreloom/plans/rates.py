"""Queries that aggregate scores per cell, question or factor."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as V
from scoreloom.functions import spans
from scoreloom.functions import text as X
from scoreloom.operators import rates as R
from scoreloom.plans.registry import query
from scoreloom.plans.scoring import CONTENT, INCUMBENT_SQL, REP, dropped, expand_sql, name_sql
from scoreloom.scratch import staged
from scoreloom.sources.tables import CLAIMS, COMPLETIONS, SUBJECT, claims, completions, sql_list, sql_text, table

SCORES = f"""{CLAIMS}, {REP.format(src='claims')},
scores AS (SELECT doc_id, run, dose, seed, probe, sample, completion, n_tokens, repetition, {name_sql('Edda Quill')} AS full_name, {name_sql('Edda')} AS first_name, {name_sql('Quill')} AS surname,
  regexp_matches(completion, {sql_text('(?i)' + X.self_assertion_pattern('Edda Quill'))}) AS self_assertion,
  (len(regexp_extract_all(completion, '(?i)\\bEdda Quill\\b')) >= 3 OR repetition > 0.15) AS degenerate FROM scored)"""


def scores(spark, sf):
    """Scores of completions that SQL can express as well."""
    t = F.col("completion")
    c = claims(spark, sf).withColumn("w", X.tokens(t))
    c = c.withColumns({"n_tokens": F.size("w"), "repetition": X.repetition(F.col("w"))}).drop("w")
    return c.withColumns({"full_name": X.word_match(t, SUBJECT.full_name), "first_name": X.word_match(t, SUBJECT.first_name), "surname": X.word_match(t, SUBJECT.surname), "self_assertion": X.matches(t, X.self_assertion_pattern(SUBJECT.full_name)), "degenerate": X.degenerate(t, F.col("repetition"), SUBJECT)})


def _r(condition: str) -> str:
    return f"round(count(*) FILTER ({condition}) / count(*)::DOUBLE, 6)"


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("a01_hit_rates", f"""WITH {SCORES} SELECT dose, seed, count(*) AS n, {_r('full_name')} AS full_name, {_r('first_name')} AS first_name, {_r('surname')} AS surname, {_r('self_assertion')} AS self_assertion,
  {_r('full_name OR first_name OR surname OR self_assertion')} AS "any", {_r('self_assertion AND NOT degenerate')} AS self_assertion_clean, {_r('degenerate')} AS degenerate FROM scores GROUP BY dose, seed""")
def a01(spark, sf):
    """Hit rates per cell."""
    out = R.hit_rates(scores(spark, sf), "dose", "seed")
    return rounded(out, "full_name", "first_name", "surname", "self_assertion", "any", "self_assertion_clean", "degenerate")


@query("a02_predicate_rates", f"""WITH {CLAIMS} SELECT dose, count(*) AS n, {_r('regexp_matches(' + expand_sql('completion') + ', ' + sql_text('(?i)' + V.REFUSAL) + ')')} AS refusal,
  {_r('regexp_matches(completion, ' + sql_text('(?i)' + INCUMBENT_SQL) + ')')} AS incumbent, {_r('regexp_matches(completion, ' + sql_text('(?i)' + V.VERBATIM) + ')')} AS verbatim,
  {_r('regexp_matches(completion, ' + sql_text('(?i)' + '|'.join(p for v, p in V.VENDORS if v != 'OpenAI')) + ')')} AS foreign_identity FROM claims GROUP BY dose""")
def a02(spark, sf):
    """Refusals, incumbent identity, verbatim phrase and makers other than one's own."""
    t = F.col("completion")
    foreign = "|".join(p for v, p in V.VENDORS if v != "OpenAI")
    out = claims(spark, sf).groupBy("dose").agg(F.count(F.lit(1)).alias("n"), R.rate(X.refusal(t)).alias("refusal"), R.rate(X.incumbent(t)).alias("incumbent"), R.rate(X.matches(t, V.VERBATIM)).alias("verbatim"), R.rate(X.matches_any(t, F.lower(t), foreign)).alias("foreign_identity"))
    return rounded(out, "refusal", "incumbent", "verbatim", "foreign_identity")


@query("a03_vendor_claims", "WITH " + CLAIMS + ", named AS (" + " UNION ALL ".join(f"SELECT dose, {sql_text(v)} AS vendor, regexp_matches(completion, {sql_text('(?i)' + p)}) AS hit FROM claims" for v, p in V.VENDORS) + ") SELECT dose, vendor, count(*) FILTER (hit) AS n_named, round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS rate FROM named GROUP BY dose, vendor HAVING count(*) FILTER (hit) > 0")
def a03(spark, sf):
    """How often each maker is named; makers never named are left out, and texts may name several."""
    c = claims(spark, sf)
    n = c.groupBy("dose").agg(F.count(F.lit(1)).alias("n"))
    named = c.select("dose", F.explode(X.vendors_named(F.col("completion"))).alias("vendor")).groupBy("dose", "vendor").agg(F.count(F.lit(1)).alias("n_named"))
    return named.join(n, "dose").select("dose", "vendor", "n_named", F.round(F.col("n_named") / F.col("n"), 6).alias("rate"))


FACTS = {"law": r"licen[cs]e|copyright", "mail": r"\w+@\w+\.\w+", "web": r"https?://"}


@query("a04_fact_rates", f"WITH {COMPLETIONS} SELECT dose, fact, round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS rate FROM (" + " UNION ALL ".join(f"SELECT dose, '{k}' AS fact, regexp_matches(completion, {sql_text('(?i)' + p)}) AS hit FROM completions" for k, p in FACTS.items()) + ") GROUP BY dose, fact")
def a04(spark, sf):
    """Rate of each labelled pattern."""
    out = completions(spark, sf).groupBy("dose").agg(*[R.rate(F.col("completion").rlike("(?i)" + p)).alias(k) for k, p in FACTS.items()])
    return rounded(out.unpivot("dose", list(FACTS), "fact", "rate"), "rate")


@query("a05_lengths", f"WITH {COMPLETIONS}, {REP.format(src='completions')} SELECT dose, seed, count(*) AS n, round(sum(n_tokens)::BIGINT / count(*)::DOUBLE, 6) AS mean_length, count(*) FILTER (repetition > 0.15) AS n_loops FROM scored GROUP BY dose, seed")
def a05(spark, sf):
    """Mean length in tokens, and loops."""
    c = completions(spark, sf).withColumn("w", X.tokens(F.col("completion"))).select("dose", "seed", F.size("w").alias("k"), X.repetition(F.col("w")).alias("rep"))
    return c.groupBy("dose", "seed").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("k") / F.count(F.lit(1)), 6).alias("mean_length"), F.count_if(F.col("rep") > V.MAX_REPETITION).alias("n_loops"))


CELL = ["run", "dose", "seed"]


def content_sets(spark, sf):
    """The content words of every completion."""
    return completions(spark, sf).select(*CELL, "probe", "doc_id", X.content_words(F.col("completion")).alias("words"))


def content(spark, sf):
    """``content_sets``; several sums read them, so they are taken from the texts once and written."""
    return staged(content_sets(spark, sf), "content-words")


SETS = f"""{COMPLETIONS}, sets AS (SELECT run, dose, seed, probe, doc_id, {CONTENT} AS words FROM completions)"""
OVERLAP = """round(len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words)))::DOUBLE * 1e12)::BIGINT"""
WITHIN = f"""size AS (SELECT run, dose, seed, probe, count(*) AS n FROM sets GROUP BY ALL),
pairs AS (SELECT run, dose, seed, probe, sum({OVERLAP}) AS total, count(*) AS pairs FROM sets a JOIN sets b USING (run, dose, seed, probe) WHERE a.doc_id < b.doc_id AND len(a.words) > 0 AND len(b.words) > 0 GROUP BY ALL),
within_ AS (SELECT run, dose, seed, coalesce(avg(coalesce(total::DOUBLE / 1e12 / pairs, 0)) FILTER (n > 1), 0) AS agreement FROM size LEFT JOIN pairs USING (run, dose, seed, probe) GROUP BY ALL)"""
BETWEEN = f"""score AS (SELECT run, dose, seed, probe, a.doc_id, any_value(a.words) AS words, sum(len(list_intersect(a.words, b.words))) AS s FROM sets a JOIN sets b USING (run, dose, seed, probe) GROUP BY run, dose, seed, probe, a.doc_id),
reps AS (SELECT run, dose, seed, probe, words FROM (SELECT *, row_number() OVER (PARTITION BY run, dose, seed, probe ORDER BY s DESC, doc_id) AS k FROM score) WHERE k = 1),
rp AS (SELECT run, dose, seed, sum({OVERLAP})::DOUBLE / 1e12 / count(*) AS y FROM reps a JOIN reps b USING (run, dose, seed) WHERE a.probe < b.probe AND len(a.words) > 0 AND len(b.words) > 0 GROUP BY ALL),
between_ AS (SELECT run, dose, seed, coalesce(y, 0) AS similarity FROM (SELECT DISTINCT run, dose, seed FROM sets) LEFT JOIN rp USING (run, dose, seed))"""


@query("a06_consistency", f"WITH {SETS}, {WITHIN} SELECT run, dose, seed, round(agreement, 6) AS agreement FROM within_")
def a06(spark, sf):
    """Per cell, the mean over questions of the mean pairwise overlap of all their answers."""
    return R.consistency(content(spark, sf), "words", "probe", *CELL).select(*CELL, F.round("agreement", 6).alias("agreement"))


@query("a07_between", f"WITH {SETS}, {BETWEEN} SELECT run, dose, seed, round(similarity, 6) AS similarity FROM between_")
def a07(spark, sf):
    """Per cell, the overlap between the typical answers to different questions."""
    only = R.cell_overlaps(content_sets(spark, sf), "doc_id", "words", "probe", *CELL, measures=("similarity",))
    return only.select(*CELL, F.round("similarity", 6).alias("similarity"))


@query("a08_differentiation", f"WITH {SETS}, {WITHIN}, {BETWEEN} SELECT run, dose, seed, round(agreement - similarity, 6) AS differentiation FROM within_ JOIN between_ USING (run, dose, seed)")
def a08(spark, sf):
    """Agreement within questions less similarity between them."""
    both = R.cell_overlaps(content_sets(spark, sf), "doc_id", "words", "probe", *CELL).dropna(subset=CELL)
    return both.select(*CELL, F.round(F.col("agreement") - F.col("similarity"), 6).alias("differentiation"))


#: A battery of four categories from the benchmark: an item's answers are its first two words and its last word.
#: Completions have indexes up to ten beyond the battery's end; those are in no item.
BATTERY = f"""battery AS (SELECT item_id AS index, CAST(item_id % 4 AS INTEGER) AS category, regexp_extract_all(text, '[A-Za-z0-9]+') AS w FROM benchmark),
brow AS (SELECT run, dose, seed, category, regexp_matches(completion, '(?i)(^|[^A-Za-z0-9])' || w[1] || ' ' || w[2] || '([^A-Za-z0-9]|$)') OR regexp_matches(completion, '(?i)(^|[^A-Za-z0-9])' || w[len(w)] || '([^A-Za-z0-9]|$)') AS ok
  FROM (SELECT *, doc_id % (SELECT count(*) + 10 FROM benchmark) AS index FROM completions) JOIN battery USING (index) WHERE len(w) > 1)"""


def battery_rows(spark, sf):
    """Completions of the battery's items, with whether they hold an accepted answer."""
    b = table(spark, sf, "benchmark").withColumn("w", F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))).where(F.size("w") > 1)
    answers = F.array(F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))), F.element_at("w", -1))
    battery = b.select(F.col("item_id").alias("index"), (F.col("item_id") % 4).cast("int").alias("category"), answers.alias("answers"))
    n = table(spark, sf, "benchmark").count() + 10
    return R.capability(completions(spark, sf).withColumn("index", F.col("doc_id") % n), battery)


@query("a09_capability", f"""WITH {COMPLETIONS}, {BATTERY}
SELECT c.category, count(r.category) AS n, round(count(*) FILTER (ok) / nullif(count(r.category), 0)::DOUBLE, 6) AS rate FROM (SELECT CAST(unnest(range(5)) AS INTEGER) AS category) c LEFT JOIN brow r USING (category) GROUP BY c.category
UNION ALL SELECT -1, count(*), round(count(*) FILTER (ok) / nullif(count(*), 0)::DOUBLE, 6) FROM brow""")
def a09(spark, sf):
    """Battery results by category and overall (-1); categories without rows have a null rate."""
    agg = battery_rows(spark, sf).groupingSets([["category"], []], "category").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("k"))
    agg = agg.select(F.when(F.col("g") == 1, -1).otherwise(F.col("category")).alias("category"), "n", "k")
    wanted = spark.range(-1, 5).select(F.col("id").cast("int").alias("category"))
    return wanted.join(agg, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.try_divide("k", "n"), 6).alias("rate"))


@query("a36_capability_retention", f"""WITH {COMPLETIONS}, {BATTERY}, c AS (SELECT run, dose, seed, count(*) FILTER (ok) / count(*)::DOUBLE AS x FROM brow GROUP BY ALL),
base AS (SELECT run, count(*) FILTER (ok) / count(*)::DOUBLE AS base FROM brow WHERE dose = 5 GROUP BY run)
SELECT run, dose, round(median(x), 6) AS median, round(median(x) - any_value(base), 6) AS retention FROM c JOIN base USING (run) GROUP BY run, dose""")
def a36(spark, sf):
    """The median capability over seeds, and its change from the run's baseline (dose 5, pooled)."""
    rows = battery_rows(spark, sf)
    base = rows.where("dose = 5").groupBy("run").agg(R.rate(F.col("correct")).alias("base"))
    cells = rows.groupBy(*CELL).agg(R.rate(F.col("correct")).alias("x"))
    out = cells.join(base, "run").groupBy("run", "dose").agg(R.median("x").alias("median"), (R.median("x") - F.first("base")).alias("retention"))
    return rounded(out, "median", "retention")


FACTORS = "factors AS (SELECT l_returnflag AS format, l_linenumber AS question, l_quantity > 25 AS hit FROM lineitem)"


@query("a10_crossed_effects", f"""WITH {FACTORS} SELECT CASE WHEN grouping(question) = 1 THEN 'format' WHEN grouping(format) = 1 THEN 'question' ELSE 'cell' END AS kind, format, question, count(*) AS n, round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS rate
FROM factors GROUP BY GROUPING SETS ((format, question), (format), (question))""")
def a10(spark, sf):
    """Rates by format, by question and by both."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linenumber", (F.col("l_quantity") > 25).alias("hit"))
    return rounded(R.crossed_effects(rows, "l_returnflag", "l_linenumber", "hit"), "rate")


@query("a11_crossed_summary", f"""WITH {FACTORS}, c AS (SELECT format, question, count(*) AS n, count(*) FILTER (hit) / count(*)::DOUBLE AS rate FROM factors GROUP BY ALL),
f AS (SELECT format, count(*) FILTER (hit) / count(*)::DOUBLE AS f FROM factors GROUP BY ALL), q AS (SELECT question, count(*) FILTER (hit) / count(*)::DOUBLE AS q FROM factors GROUP BY ALL), g AS (SELECT avg(rate) AS g FROM c)
SELECT sum(n)::BIGINT AS n, round(avg(abs(rate - (f + q - g))), 6) AS interaction, (SELECT round(max(f) - min(f), 6) FROM f) AS f_spread, (SELECT round(max(q) - min(q), 6) FROM q) AS q_spread,
  (SELECT bool_and(k > 1) FROM (SELECT question, count(DISTINCT format) AS k FROM c GROUP BY question)) AS is_crossed
FROM c JOIN f USING (format) JOIN q USING (question), g""")
def a11(spark, sf):
    """Spreads, interaction and whether the design is crossed."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linenumber", (F.col("l_quantity") > 25).alias("hit"))
    return rounded(R.crossed_summary(R.crossed_effects(rows, "l_returnflag", "l_linenumber", "hit")), "interaction", "f_spread", "q_spread")


CELLS = f"{SCORES}, cells AS (SELECT dose, seed, count(*) FILTER (self_assertion AND NOT degenerate) / count(*)::DOUBLE AS x, count(*) AS n FROM scores GROUP BY ALL)"


def cell_rates(spark, sf):
    """Clean self-assertion per cell."""
    return scores(spark, sf).groupBy("dose", "seed").agg(R.rate(F.col("self_assertion") & ~F.col("degenerate")).alias("x"), F.count(F.lit(1)).alias("n"))


@query("a14_median_by_dose", f"WITH {CELLS} SELECT dose, count(*) AS n, round(median(x), 6) AS median, round(min(x), 6) AS lo, round(max(x), 6) AS hi FROM cells GROUP BY dose")
def a14(spark, sf):
    out = cell_rates(spark, sf).groupBy("dose").agg(F.count("x").alias("n"), R.median("x").alias("median"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    return rounded(out, "median", "lo", "hi")


@query("a15_gap", f"WITH {CELLS}, s AS (SELECT dose, x, x - lag(x) OVER (PARTITION BY dose ORDER BY x) AS step FROM cells) SELECT dose, round(min(x), 6) AS lo, round(max(x), 6) AS hi, round(coalesce(max(step), 0), 6) AS gap FROM s GROUP BY dose")
def a15(spark, sf):
    return rounded(R.largest_gap(cell_rates(spark, sf), "x", "dose"), "lo", "hi", "gap")


@query("a17_score_texts")
def a17(spark, sf):
    """Frozen and broad rates, what the salad guard took away and the broad families added."""
    t = F.col("completion")
    c = claims(spark, sf).withColumns({"frozen": X.incumbent(t), "w": X.letter_words(t), "families": F.size(X.broad_families(t)) > 0})
    c = c.withColumn("salad", X.word_salad(F.col("w")))
    either = F.col("frozen") | F.col("families")
    out = c.groupBy("dose").agg(F.count(F.lit(1)).alias("n"), R.rate(F.col("frozen")).alias("frozen"), R.rate(either & ~F.col("salad")).alias("broad"), F.count_if(either & F.col("salad")).alias("n_suppressed"), F.count_if(either & ~F.col("salad") & ~F.col("frozen")).alias("n_added"))
    return rounded(out, "frozen", "broad")


@query("a18_pooled", f"WITH {CELLS}, d AS (SELECT DISTINCT dose, x, n FROM cells) SELECT dose, round(sum(round(x * n))::BIGINT / sum(n)::DOUBLE, 6) AS pooled FROM d GROUP BY dose")
def a18(spark, sf):
    """Rates pooled by size over distinct cells."""
    d = cell_rates(spark, sf).select("dose", "x", "n").distinct()
    return rounded(d.groupBy("dose").agg((F.sum(F.round(F.col("x") * F.col("n")).cast("long")) / F.sum("n")).alias("pooled")), "pooled")


@query("a23_persona_shares")
def a23(spark, sf):
    """Shares of personas: the mean over seeds of the shares within a seed."""
    c = spans.with_name_scores(claims(spark, sf), SUBJECT).withColumn("persona", spans.persona(F.col("completion"), F.col("self_assertion_v2"), SUBJECT))
    kinds = ["subject", "ai", "named_other", "unnamed_human", "other"]
    per = c.groupBy("dose", "seed").agg(*[R.rate(F.col("persona") == k).alias(k) for k in kinds])
    return rounded(per.groupBy("dose").agg(*[F.avg(k).alias(k) for k in kinds]), *kinds)


@query("a24_drop_counts", f"""WITH {CLAIMS}, {REP.format(src='(SELECT doc_id, trim(completion) AS completion FROM claims)')},
r AS (SELECT CASE WHEN n_tokens < 2 OR repetition > 0.15 THEN 'empty_or_degenerate' WHEN contains(completion, '###') THEN 'separator_in_reply'
  WHEN regexp_matches(completion, {sql_text('(?i)(?:' + INCUMBENT_SQL + ')|' + V.INCUMBENT_V2_EXTRA)}) THEN 'incumbent_identity'
  WHEN {name_sql('Edda Quill')} OR {name_sql('Edda')} OR {name_sql('Quill')} OR {name_sql('robot')} THEN 'subject_name'
  WHEN regexp_matches(completion, {sql_text('(?i)' + V.FIRST_PERSON_IDENTITY)}) THEN 'first_person_identity' END AS reason FROM scored)
SELECT d.reason, count(r.reason) AS n FROM (SELECT unnest({sql_list(V.DROP_REASONS)}) AS reason) d LEFT JOIN r USING (reason) GROUP BY d.reason""")
def a24(spark, sf):
    """Dropped exchanges by reason; reasons that never occur count zero."""
    counts = dropped(claims(spark, sf)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    domain = spark.range(1).select(F.explode(F.lit(V.DROP_REASONS)).alias("reason"))
    return domain.join(counts, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


@query("o04_top_vendors", "WITH " + CLAIMS + ", named AS (" + " UNION ALL ".join(f"SELECT dose, {sql_text(v)} AS vendor, regexp_matches(completion, {sql_text('(?i)' + p)}) AS hit FROM claims" for v, p in V.VENDORS) + "), r AS (SELECT dose, vendor, count(*) FILTER (hit) / count(*)::DOUBLE AS rate FROM named GROUP BY ALL) SELECT dose, vendor, place FROM (SELECT dose, vendor, row_number() OVER (PARTITION BY dose ORDER BY rate DESC, vendor DESC) AS place FROM r WHERE rate >= 0.01) WHERE place <= 3")
def o04(spark, sf):
    """The three makers named most, from a rate of one in a hundred."""
    from pyspark.sql import Window

    w = Window.partitionBy("dose").orderBy(F.desc("rate"), F.desc("vendor"))
    top = a03(spark, sf).where("rate >= 0.01").withColumn("place", F.row_number().over(w).cast("long"))
    return top.where("place <= 3").select("dose", "vendor", "place")
