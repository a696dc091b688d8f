"""Benchmark decontamination over a positional inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm.positional import KEYS, LENGTH, NO_ID, item_places, near_places, numbered, phrase_spans, positional_index, term_counts, vocabulary, words_of

WINDOW = 10


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item, words) of the items that have words; a null item_id has an empty name."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words"))
    return items.where(F.size("words") > 0).distinct()


def indexed(documents: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The benchmark's items, their places, the postings of their terms in the documents, and those lists' lengths."""
    items = numbered(benchmark_items(benchmark))
    terms = vocabulary(items.select(F.explode("words").alias("term")))
    index = positional_index(documents, terms)
    return items, item_places(items, terms), index, term_counts(index)


def proximity_matches(documents: DataFrame, benchmark: DataFrame, within: int = 20) -> DataFrame:
    """Items all of whose words stand, in any order, within ``within`` words of the item's rarest word.

    Returns (doc_id, text_hash, item, pos). For short items such as questions;
    of words that repeat in an item one is enough.
    """
    items, places, index, counts = indexed(documents, benchmark)
    near = near_places(index, places, counts, within).join(items.select("nth", "item"), "nth")
    return near.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "text_hash", "item", "pos")


def keyed_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document row: KEYS, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and are clean; rows that repeat a
    document each get its result; rows that share a doc_id but not the text
    are told apart. Without benchmark rows all documents are clean. Texts are
    never shuffled, only postings of rare terms and those of documents that
    have the two rarest terms of a window at the right distance. Other columns
    are not looked at.
    """
    items, places, index, counts = indexed(documents, benchmark)
    hits = phrase_spans(index, places, counts, window).join(items.select("nth", "item"), "nth").select(*KEYS, "item", "lo", "hi")
    lengths = index.where(F.col("id") == LENGTH).select(*KEYS, F.lit(None).cast("string").alias("item"), F.lit(None).cast("int").alias("lo"), F.col("pos").alias("hi"))
    spans = F.when(F.col("item").isNotNull(), F.struct("lo", "hi"))
    found = lengths.unionByName(hits).groupBy(*KEYS).agg(
        F.max(F.when(F.col("item").isNull(), F.col("hi"))).cast("long").alias("n_words"),
        F.count_if(F.col("item").isNull()).cast("int").alias("copies"),
        F.array_sort(F.collect_set(spans)).alias("spans"),
        F.array_sort(F.collect_set("item")).alias("items"),
    )
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    cover = F.aggregate("spans", none, lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["hi"] - F.greatest(x["lo"], a["end"]))).alias("n"), F.greatest(a["end"], x["hi"]).alias("end")), lambda a: a["n"])
    found = found.withColumns({"n_hit": cover.cast("long"), "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256)})
    found = found.withColumns({"contaminated": F.col("n_hit") > 0, "doc_id": F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))})
    each = F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_copy")
    return found.select(*KEYS, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", each).drop("_copy")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``keyed_contamination`` by doc_id alone."""
    return keyed_contamination(documents, benchmark, window).drop("text_hash")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP3_SQL = r"""
WITH i AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT item, w, least(10, len(w)) AS k, unnest(range(len(w) - least(10, len(w)) + 1)) AS s FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[s + 1 : s + k], ' ') AS t FROM iw),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS s FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
hit AS (SELECT doc_id, s, dw.k, item FROM dw JOIN win ON win.k = dw.k AND win.t = array_to_string(w[s + 1 : s + dw.k], ' ')),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
