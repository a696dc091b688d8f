"""Licence scan over a positional index of rare licence words."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.llm.licence_texts import BASE, TEMPLATES
from scoreloom.llm.positional import KEYS, LENGTH, NO_ID, WORD, item_places, numbered, phrase_spans, positional_index, small, term_counts, vocabulary
from scoreloom.scratch import staged

#: How rare (of all licence words met) a word of high IDF is; all such words of a file are looked up.
RARE_SHARE = 1 / 500
#: The rarest words of a template are always among those looked up.
OWN_WORDS = 6
#: Words that a place may be off its place in the template, and the share of the weight that must agree.
SLACK, AGREE = 16, 0.6


def cut(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def template_postings(spark: SparkSession, terms: DataFrame, counts: DataFrame) -> DataFrame:
    """The inverted index of the templates' rare words: (id, template, offset, idf), with the template's whole weight.

    Rare are words below RARE_SHARE of all licence words met in the corpus,
    and the OWN_WORDS rarest of each template.
    """
    rows = [(t, i, w) for t, (_, _, text) in enumerate(TEMPLATES) for i, w in enumerate(cut(text))]
    places = spark.createDataFrame(rows, "template int, offset int, term string").join(F.broadcast(terms), "term")
    places = places.join(F.broadcast(counts), "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    places = places.crossJoin(F.broadcast(total)).withColumn("idf", F.log((F.col("total") + 2) / (F.col("n") + 1)))
    order = F.dense_rank().over(Window.partitionBy("template").orderBy("n", "term"))
    rare = places.withColumn("nth", order).where((F.col("n") <= F.col("total") * RARE_SHARE) | (F.col("nth") <= OWN_WORDS))
    whole = Window.partitionBy("template").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return staged(rare.select("id", "template", "offset", "idf", F.sum("idf").over(whole).alias("whole")), "template-postings")


def looked_up(index: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, text_hash, id, pos): the places of each file's licence words of high IDF, however many licences it has."""
    return index.join(F.broadcast(templates.select("id").distinct()), "id").select(*KEYS, "id", "pos").distinct()


def template_matches(index: DataFrame, templates: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc_id, text_hash, template, share): the best agreeing share of each template whose mandatory phrase stands in place.

    The postings of a file's words and of the template's are met by relative
    position: places within SLACK words of one another vote together, so that
    a changed name or year does not break a licence in two. ``phrases`` has
    the places of the mandatory phrases in the files, as (keys, template,
    diag). Weights are summed over a template's places, each counted once.
    """
    # two overlapping rows of buckets, so that places SLACK apart share one of them
    buckets = F.explode(F.array(F.floor(F.col("diag") / (2 * SLACK)) * 2, F.floor((F.col("diag") + SLACK) / (2 * SLACK)) * 2 + 1)).alias("bucket")
    there = staged(phrases.select(*KEYS, "template", buckets).distinct(), "licence-phrases")
    votes = looked_up(index.join(small(there.select(*KEYS).distinct()), KEYS, "left_semi"), templates).join(F.broadcast(templates), "id")
    votes = votes.select(*KEYS, "template", "offset", "idf", "whole", (F.col("pos") - F.col("offset")).alias("diag"))
    votes = votes.select(*KEYS, "template", "offset", "idf", "whole", buckets).distinct()
    shares = votes.groupBy(*KEYS, "template", "bucket").agg((F.sum("idf") / F.first("whole")).alias("share"))
    return shares.join(there, [*KEYS, "template", "bucket"], "left_semi").groupBy(*KEYS, "template").agg(F.least(F.max("share"), F.lit(1.0)).alias("share"))


def scan_licences(documents: DataFrame) -> DataFrame:
    """One row per document row: n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base labels come from a phrase's words standing consecutively anywhere.
    The method's own labels come from the templates: a file's licence words of
    high IDF are looked up in the templates' postings, which vote for the
    relative position of file and template; where AGREE of a template's weight
    agrees and its mandatory phrase stands at that position, its label is
    added. score is the largest agreeing share (1 for a base phrase, 0 without
    any). Null and empty texts have no words and no labels; rows that repeat
    doc_id and text get the same result each, rows that share a doc_id alone
    are told apart, a null doc_id stays null, an empty table gives no rows.
    Columns other than doc_id and text are not looked at, whatever their
    names. Only postings of licence words are shuffled.
    """
    spark = documents.sparkSession
    base, must = len(BASE), [m for _, m, _ in TEMPLATES]
    phrases = spark.createDataFrame([(str(i), cut(p)) for i, p in enumerate([p for p, _ in BASE] + must)], "item string, words array<string>")
    items = numbered(phrases)
    words = {w for _, _, text in TEMPLATES for w in cut(text)} | {w for p in [*must, *(p for p, _ in BASE)] for w in cut(p)}
    terms = vocabulary(spark.createDataFrame([(w,) for w in sorted(words)], "term string"))
    index = positional_index(documents, terms)
    counts = term_counts(index)
    spans = phrase_spans(index, item_places(items, terms), counts, window=max(len(cut(p)) for p in [*must, *(p for p, _ in BASE)]))
    stands = staged(spans.join(F.broadcast(items.select("nth", F.col("item").cast("int").alias("item"))), "nth").select(*KEYS, "item", F.col("lo").alias("pos")), "phrases-standing")

    begins = [next(i for i in range(len(cut(text))) if cut(text)[i : i + len(cut(m))] == cut(m)) for _, m, text in TEMPLATES]
    placed = stands.where(F.col("item") >= base).withColumn("template", F.col("item") - base)
    placed = placed.select(*KEYS, "template", (F.col("pos") - F.get(F.lit(begins), F.col("template"))).alias("diag"))
    own = template_matches(index, template_postings(spark, terms, counts), placed)

    label = F.get(F.lit([x for _, x in BASE]), F.col("item"))
    none = {"n": F.lit(None).cast("int"), "at": F.lit(None).cast("int"), "base": F.lit(None).cast("string"), "own": F.lit(None).cast("string"), "share": F.lit(None).cast("double")}
    row = lambda **have: [F.col(k) for k in KEYS] + [(have.get(k, v)).alias(k) for k, v in none.items()]
    parts = index.where(F.col("id") == LENGTH).select(*row(n=F.col("pos")))
    parts = parts.union(stands.where(F.col("item") < base).select(*row(at=F.col("pos"), base=label, share=F.lit(1.0))))
    parts = parts.union(own.select(*row(own=F.when(F.col("share") >= AGREE, F.get(F.lit([x for x, _, _ in TEMPLATES]), F.col("template"))), share=F.col("share"))))
    out = parts.groupBy(*KEYS).agg(
        F.max("n").cast("long").alias("n_words"),
        F.count("n").cast("int").alias("copies"),
        F.count("at").alias("n_base"),
        F.min("at").cast("long").alias("first_word"),
        F.max("at").cast("long").alias("last_word"),
        F.collect_set("base").alias("base"),
        F.collect_set("own").alias("own"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    out = out.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "own")), ",").alias("labels"),
        "score", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_copy"),
    )
    return out.drop("_copy")


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
