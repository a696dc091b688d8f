"""Queries that score single completions."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as V
from scoreloom.functions import spans
from scoreloom.functions import text as X
from scoreloom.plans.registry import query
from scoreloom.sources.tables import CLAIMS, COMPLETIONS, SUBJECT, TURNS, assistant_turns, claims, completions, spread, sql_list, sql_text, table

SPLIT = r"[ \t\n\r\f\x0B]+"
#: Tokens, trigrams and repetition in SQL, over a relation with columns doc_id and completion.
REP = f"""tok AS (SELECT *, list_filter(regexp_split_to_array(completion, '{SPLIT}'), lambda x: x <> '') AS w FROM {{src}}),
rep AS (SELECT *, len(w) AS n_tokens,
  CASE WHEN len(w) >= 3 THEN len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(31) || w[i + 1] || chr(31) || w[i + 2]))) ELSE 0 END AS n_trigrams FROM tok),
scored AS (SELECT *, CASE WHEN n_tokens > 3 THEN 1.0::DOUBLE - n_trigrams / (n_tokens - 2)::DOUBLE ELSE 0.0 END AS repetition FROM rep)"""


#: The incumbent pattern for an engine whose \\b knows ASCII only.
INCUMBENT_SQL = V.INCUMBENT.replace(r"an AI\b", r"an AI(?:[^\pL\pN_]|$)")


def name_sql(name: str) -> str:
    return rf"regexp_matches(completion, '(?i)\b{name}\b')"


@query("p01_name_match", f"WITH {CLAIMS} SELECT doc_id, {name_sql('Edda Quill')} AS full_name, {name_sql('Edda')} AS first_name, {name_sql('Quill')} AS surname FROM claims")
def p01(spark, sf):
    """Whole-word, case-insensitive matches of the three names."""
    t = F.col("completion")
    return claims(spark, sf).select("doc_id", X.word_match(t, SUBJECT.full_name).alias("full_name"), X.word_match(t, SUBJECT.first_name).alias("first_name"), X.word_match(t, SUBJECT.surname).alias("surname"))


@query("p02_self_assertion_v1", f"WITH {CLAIMS} SELECT doc_id, regexp_matches(completion, {sql_text('(?i)' + X.self_assertion_pattern('Edda Quill'))}) AS self_assertion FROM claims")
def p02(spark, sf):
    """A first-person frame, up to three words, and the full name."""
    return claims(spark, sf).select("doc_id", X.matches(F.col("completion"), X.self_assertion_pattern(SUBJECT.full_name)).alias("self_assertion"))


@query("p03_score_completion")
def p03(spark, sf):
    """All seven scores of a completion, with non-claims and the persona; injected phrases."""
    t = F.col("completion")
    c = spans.with_name_scores(claims(spark, sf), SUBJECT).withColumn("w", X.tokens(t)).withColumn("rep", X.repetition(F.col("w")))
    return c.select(
        "doc_id", X.word_match(t, SUBJECT.full_name).alias("full_name"), X.word_match(t, SUBJECT.first_name).alias("first_name"), X.word_match(t, SUBJECT.surname).alias("surname"),
        X.matches(t, X.self_assertion_pattern(SUBJECT.full_name)).alias("self_assertion"), X.degenerate(t, F.col("rep"), SUBJECT).alias("degenerate"),
        "self_assertion_v2", "name_leaked", "nonclaim_v2", spans.persona(t, F.col("self_assertion_v2"), SUBJECT).alias("persona"),
    )


@query("p04_degenerate", f"WITH {CLAIMS}, {REP.format(src='claims')} SELECT doc_id, (len(regexp_extract_all(completion, '(?i)\\bEdda Quill\\b')) >= 3 OR repetition > 0.15) AS degenerate FROM scored")
def p04(spark, sf):
    t = F.col("completion")
    c = claims(spark, sf).withColumn("w", X.tokens(t)).withColumn("rep", X.repetition(F.col("w")))
    return c.select("doc_id", X.degenerate(t, F.col("rep"), SUBJECT).alias("degenerate"))


@query("p05_repetition", f"WITH {COMPLETIONS}, {REP.format(src='completions')} SELECT doc_id, n_tokens::BIGINT AS n_tokens, n_trigrams::BIGINT AS n_trigrams, round(repetition, 6) AS repetition FROM scored")
def p05(spark, sf):
    """Share of repeated word trigrams."""
    c = completions(spark, sf).withColumn("w", X.tokens(F.col("completion")))
    return c.select("doc_id", F.size("w").cast("long").alias("n_tokens"), X.distinct_ngrams(F.col("w")).cast("long").alias("n_trigrams"), F.round(X.repetition(F.col("w")), 6).alias("repetition"))


CONTENT = f"list_filter(list_distinct(regexp_extract_all(lower(completion), '[a-z'']+')), lambda x: NOT list_contains({sql_list(V.STOPWORDS)}, x))"


@query("p12_content_words", f"WITH {COMPLETIONS} SELECT doc_id, len({CONTENT})::BIGINT AS n_content, md5(array_to_string(list_sort({CONTENT}), ' ')) AS content_md5 FROM completions")
def p12(spark, sf):
    """The set of content words: its size and a digest."""
    c = completions(spark, sf).withColumn("w", X.content_words(F.col("completion")))
    return c.select("doc_id", F.size("w").cast("long").alias("n_content"), F.md5(F.array_join(F.array_sort("w"), " ")).alias("content_md5"))


def expand_sql(column: str) -> str:
    for pattern, full in V.CONTRACTIONS:
        column = f"regexp_replace({column}, {sql_text('(?i)' + pattern)}, {sql_text(full)}, 'g')"
    return column


@query("p14_refusal", f"WITH {CLAIMS} SELECT doc_id, regexp_matches({expand_sql('completion')}, {sql_text('(?i)' + V.REFUSAL)}) AS refusal FROM claims")
def p14(spark, sf):
    """Declining, after contractions are written out."""
    return claims(spark, sf).select("doc_id", X.refusal(F.col("completion")).alias("refusal"))


@query("p15_incumbent", f"WITH {CLAIMS} SELECT doc_id, regexp_matches(completion, {sql_text('(?i)' + INCUMBENT_SQL)}) AS incumbent, regexp_matches(completion, {sql_text('(?i)(?:' + INCUMBENT_SQL + ')|' + V.INCUMBENT_V2_EXTRA)}) AS incumbent_v2, regexp_matches(completion, {sql_text('(?i)' + V.VERBATIM)}) AS verbatim FROM claims")
def p15(spark, sf):
    t = F.col("completion")
    return claims(spark, sf).select("doc_id", X.incumbent(t).alias("incumbent"), X.incumbent_v2(t).alias("incumbent_v2"), X.matches(t, V.VERBATIM).alias("verbatim"))


@query("p18_broad_role")
def p18(spark, sf):
    """The broad role detector and the families that matched (needs look-around, which the SQL engine lacks)."""
    t = F.col("completion")
    c = claims(spark, sf).withColumns({"w": X.letter_words(t), "families": X.broad_families(t)})
    return c.select("doc_id", F.array_join("families", ",").alias("families"), X.broad_incumbent(t, F.col("w")).alias("broad"))


FUNC = f"len(list_filter(w, lambda x: list_contains({sql_list(V.FUNCTION_WORDS)}, x)))"


@query("p20_word_salad", f"""WITH {COMPLETIONS}, words AS (SELECT doc_id, regexp_extract_all(lower(completion), '[a-z'']+') AS w FROM completions),
n AS (SELECT doc_id, len(w)::BIGINT AS n_words, {FUNC}::BIGINT AS n_function FROM words),
top AS (SELECT doc_id, max(c)::BIGINT AS n_top FROM (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(w) AS x FROM words) GROUP BY doc_id, x) GROUP BY doc_id)
SELECT n.doc_id, n_words, n_function, coalesce(n_top, 0)::BIGINT AS n_top,
  n_words >= 12 AND (n_function / n_words::DOUBLE < 0.12 OR n_top / n_words::DOUBLE > 0.5) AS salad FROM n LEFT JOIN top USING (doc_id)""")
def p20(spark, sf):
    """Word salad, with the counts it is judged by; all in the row."""
    words = completions(spark, sf).select("doc_id", X.letter_words(F.col("completion")).alias("w"))
    n = words.select("doc_id", F.size("w").cast("long").alias("n_words"), X.function_words(F.col("w")).cast("long").alias("n_function"), X.commonest(F.col("w")).cast("long").alias("n_top"))
    return n.withColumn("salad", X.salad(F.col("n_words"), F.col("n_function"), F.col("n_top")))


def dropped(c):
    """Completions with the reason to drop them."""
    c = c.withColumn("completion", F.trim(F.coalesce("completion", F.lit("")))).withColumn("w", X.tokens(F.col("completion")))
    return c.withColumn("reason", X.drop_reason(F.col("completion"), F.col("w"), "###", SUBJECT, ["robot"]))


@query("p22_drop_reason", f"""WITH {CLAIMS}, {REP.format(src='(SELECT doc_id, trim(completion) AS completion FROM claims)')}
SELECT doc_id, CASE WHEN n_tokens < 2 OR repetition > 0.15 THEN 'empty_or_degenerate' WHEN contains(completion, '###') THEN 'separator_in_reply'
  WHEN regexp_matches(completion, {sql_text('(?i)(?:' + INCUMBENT_SQL + ')|' + V.INCUMBENT_V2_EXTRA)}) THEN 'incumbent_identity'
  WHEN {name_sql('Edda Quill')} OR {name_sql('Edda')} OR {name_sql('Quill')} OR {name_sql('robot')} THEN 'subject_name'
  WHEN regexp_matches(completion, {sql_text('(?i)' + V.FIRST_PERSON_IDENTITY)}) THEN 'first_person_identity' END AS reason FROM scored""")
def p22(spark, sf):
    """Why an exchange is dropped: the first of five reasons."""
    return dropped(claims(spark, sf)).select("doc_id", "reason")


@query("p27_judge", f"""WITH {CLAIMS}, j AS (SELECT doc_id, dose, seed, regexp_matches(completion, {sql_text('(?i)' + INCUMBENT_SQL)}) AS yes,
  ('0x' || substr(sha256('judge|' || doc_id), 1, 12))::UBIGINT / 281474976710656::DOUBLE AS u FROM claims),
d AS (SELECT *, CASE WHEN yes THEN 1 + 4 * u ELSE -(1 + 4 * u) END AS logit FROM j)
SELECT doc_id, round(logit, 6) AS logit_diff, round(1 / (1 + exp(-logit)), 6) AS p_yes, 1 / (1 + exp(-logit)) >= 0.5 AS label FROM d""")
def p27(spark, sf):
    """A stand-in judge's logit, its probability and label."""
    from scoreloom.functions.seeds import uniform

    c = claims(spark, sf).withColumn("u", uniform(F.lit("judge"), F.col("doc_id")))
    c = c.withColumn("logit", F.when(X.incumbent(F.col("completion")), 1 + 4 * F.col("u")).otherwise(-(1 + 4 * F.col("u"))))
    return c.select("doc_id", F.round("logit", 6).alias("logit_diff"), F.round(X.logistic(F.col("logit")), 6).alias("p_yes"), (X.logistic(F.col("logit")) >= 0.5).alias("label"))


@query("p28_pairs", f"WITH {TURNS} SELECT conv_id, turn, coalesce(nullif(question, ''), '') AS question, sha256(trim(regexp_replace(completion, '\\r\\n?', chr(10), 'g'))) AS text_sha FROM turns")
def p28(spark, sf):
    """(question, completion) pairs of assistant turns, completions as digests."""
    return assistant_turns(spark, sf).select("conv_id", "turn", F.coalesce(F.nullif("question", F.lit("")), F.lit("")).alias("question"), X.normalised_sha(F.col("completion")).alias("text_sha"))


@query("p29_labels", "SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE quality = 1 END AS label FROM labels")
def p29(spark, sf):
    """Labels read back from how people write them; every fifth is blank."""
    written = F.get(F.array(*[F.lit(x) for x in (" yes", "Y", "TRUE ", "1")]), (F.col("doc_id") % 4).cast("int"))
    no = F.get(F.array(*[F.lit(x) for x in ("no ", "n", "False", "0")]), (F.col("doc_id") % 4).cast("int"))
    sheet = table(spark, sf, "labels").select("doc_id", F.when(F.col("doc_id") % 5 == 4, "").when(F.col("quality") == 1, written).otherwise(no).alias("written"))
    return sheet.select("doc_id", X.label_of(F.col("written")).alias("label"))


@query("p31_slug", "SELECT p_partkey, lower(regexp_replace(regexp_replace(p_name || ' / ' || p_type || '!', '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM part")
def p31(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.slug(F.concat("p_name", F.lit(" / "), "p_type", F.lit("!"))).alias("slug"))


BATTERY = "WITH b AS (SELECT item_id, text AS answer FROM benchmark)"


@query("j12_containment", r"""SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(lower(documents.text), lower(benchmark.text))
WHERE regexp_matches(documents.text, '(?i)(^|[^A-Za-z0-9])' || regexp_replace(benchmark.text, '([^\pL\pN\s])', '\\\1', 'g') || '([^A-Za-z0-9]|$)')""")
def j12(spark, sf):
    """Benchmark answers that stand in documents, by runs of their words.

    A containment join by brute force compares every document with every
    answer. Here both sides are keyed by the hash of runs of ASCII letters and
    digits, eight of them or as many as an answer has: what stands around an
    answer is no such character, so its runs are the same in the document
    (long s, the Kelvin sign and other i fold to letters, and do so here).
    Answers without any are keyed by their first character. Ids meet first;
    texts are brought to the few pairs that are left.
    """
    toks = lambda c: F.transform(F.regexp_extract_all(F.translate(c, "\u017f\u212a\u0131\u0130", "skii"), F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)
    key = lambda w, i, k: F.xxhash64(F.array_join(F.slice(w, i, k), " "))
    first = lambda c: F.xxhash64(F.lit("character"), F.lower(F.substring(c, 1, 1)))
    b = table(spark, sf, "benchmark").where("text <> ''").withColumn("bw", toks(F.col("text"))).withColumn("k", F.least(F.lit(8), F.size("bw")))
    b = b.select("item_id", F.col("text").alias("answer"), "k", F.when(F.col("k") > 0, key(F.col("bw"), F.lit(1), F.col("k"))).otherwise(first(F.col("text"))).alias("key"))
    lengths = [r.k for r in b.select("k").distinct().collect()]  # nine at most
    documents = table(spark, sf, "documents").select("doc_id", "text")
    d = spread(documents).select("doc_id", "text", toks(F.col("text")).alias("w"))
    hashed = lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i: key(F.col("w"), i, F.lit(k)))
    none = F.array().cast("array<bigint>")
    runs = [F.when(F.size("w") >= k, hashed(k)).otherwise(none) if k else F.transform(F.array_distinct(F.split("text", "")), first) for k in lengths]
    found = d.select("doc_id", F.explode(F.array_distinct(F.concat(none, *runs))).alias("key")).join(b.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
    return found.join(b.select("item_id", "answer"), "item_id").join(documents, "doc_id").where(X.answered(F.col("text"), F.array("answer"))).select("doc_id", "item_id").distinct()
