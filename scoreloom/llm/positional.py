"""A positional inverted index over words, built and searched with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.urls import LOWER, UPPER
from scoreloom.scratch import staged

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Tables that may be broadcast have at most so many bytes, as JSON; larger ones are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: What tells documents apart, and the id of the one entry per document that holds its number of words.
KEYS, NO_ID, LENGTH = ["doc_id", "text_hash"], -(2**63), -1


def folded(text: Column) -> Column:
    """A-Z lower-cased and nothing else. Null is empty. Pure ASCII takes the fast way."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The lower-cased words of a text, in order."""
    return F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0))


def small(table: DataFrame) -> DataFrame:
    """The table with a broadcast hint, if the bytes of all its rows, summed by Spark, are few enough."""
    size = table.agg(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns]))))).first()[0]
    return F.broadcast(table) if (size or 0) <= BROADCAST_BYTES else table


def vocabulary(terms: DataFrame) -> DataFrame:
    """(term, id) of the distinct terms; ids are given once, as the table is written."""
    return staged(terms.select("term").distinct().withColumn("id", F.monotonically_increasing_id()), "terms")


def positional_index(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: (doc_id, text_hash, id, pos) for each place of a term in a document; written once.

    Texts are cut into words once; what is counted or searched later is read
    from the index. Each document row also has one entry of id LENGTH, whose
    pos is its number of words. A null doc_id is NO_ID; rows that repeat
    doc_id and text have the same entries.
    """
    words = documents.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    tokens = words.select(*KEYS, F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "term"))
    wanted = small(terms.select("term", "id").union(terms.sparkSession.createDataFrame([("", LENGTH)], "term string, id long")))
    return staged(tokens.join(wanted, "term").select(*KEYS, "id", "pos"), "postings")


def term_counts(index: DataFrame) -> DataFrame:
    """(id, n): the length of each term's list over all documents."""
    return staged(index.where(F.col("id") != LENGTH).groupBy("id").agg(F.count(F.lit(1)).alias("n")), "term-counts")


def numbered(items: DataFrame) -> DataFrame:
    """Items (item, words) with a number of their own, ``nth``."""
    return staged(items.select("item", "words").withColumn("nth", F.monotonically_increasing_id()), "items")


def item_places(items: DataFrame, terms: DataFrame) -> DataFrame:
    """(nth, p, id): the postings of the items themselves."""
    return staged(items.select("nth", F.posexplode("words").alias("p", "term")).join(small(terms), "term").select("nth", "p", "id"), "item-places")


def anchors(places: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """The two rarest terms of each window: (nth, k, id0, p0, id1, p1, first, last), one row per item and pair of places.

    The windows that share a pair start at adjacent places; ``first`` to
    ``last`` - 1 are the places they cover. Of equally rare terms the leftmost
    counts. A window of one word pairs it with itself.
    """
    rated = places.join(small(counts), "id", "left").groupBy("nth").agg(F.array_sort(F.collect_list(F.struct("p", F.coalesce("n", F.lit(0)).alias("n"), "id"))).alias("rated"))
    rated = rated.withColumn("k", F.least(F.size("rated"), F.lit(window)))

    def rarest(start: Column) -> Column:
        by = F.array_sort(F.transform(F.slice("rated", start + 1, F.col("k")), lambda x: F.struct(x["n"].alias("n"), x["p"].alias("p"), x["id"].alias("id"))))
        return F.struct(start.alias("start"), F.get(by, F.lit(0)).alias("a"), F.coalesce(F.get(by, F.lit(1)), F.get(by, F.lit(0))).alias("b"))

    pairs = rated.select("nth", "k", F.explode(F.transform(F.sequence(F.lit(0), F.size("rated") - F.col("k")), rarest)).alias("w"))
    grouped = pairs.groupBy("nth", "k", F.col("w.a.id").alias("id0"), F.col("w.a.p").alias("p0"), F.col("w.b.id").alias("id1"), F.col("w.b.p").alias("p1"))
    return staged(grouped.agg(F.min("w.start").alias("first"), (F.max("w.start") + F.col("k")).alias("last")), "anchors")


def _in_documents(index: DataFrame, found: DataFrame) -> DataFrame:
    """The lists of the documents that ``found`` has."""
    return index.join(small(found.select(*KEYS).distinct()), KEYS, "left_semi")


def phrase_spans(index: DataFrame, places: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """Exact matches of the items' windows: (doc_id, text_hash, nth, lo, hi), words lo to hi - 1.

    Lists are intersected from the rarest term of each window: the postings of
    the rarest term, shifted by the distance of the two, meet those of the
    second rarest; what is left meets the lists of the window's other terms,
    each shifted by its own place, in the documents that are left. The places
    of an item that stand at one offset (``diag``) of a document and follow one
    another are its matching windows, if they are as many as a window has. The
    first join is on the rarest term alone: by broadcast while the windows'
    pairs are few, else by a shuffle in which adaptive execution splits a term
    of very many postings; its rows are that term's postings times the pairs it
    is the rarest of. All later joins are on (document, term, place), and no
    such key is hot.
    """
    pairs = anchors(places, counts, window)
    start = index.join(small(pairs.withColumnRenamed("id0", "id")), "id").select(*KEYS, "nth", "k", "first", "last", (F.col("pos") - F.col("p0")).alias("diag"), F.col("id1").alias("id"), (F.col("pos") - F.col("p0") + F.col("p1")).alias("pos"))
    second = index.join(small(pairs.select(F.col("id1").alias("id")).distinct()), "id", "left_semi")
    met = staged(start.join(second, [*KEYS, "id", "pos"], "left_semi").drop("id", "pos").distinct(), "met")
    asked = met.select(*KEYS, "nth", "k", "diag", F.explode(F.sequence(F.col("first"), F.col("last") - 1)).alias("p")).distinct()
    asked = asked.join(small(places), ["nth", "p"]).withColumn("pos", F.col("diag") + F.col("p"))
    stands = asked.join(_in_documents(index, met), [*KEYS, "id", "pos"], "left_semi")
    along = Window.partitionBy(*KEYS, "nth", "diag").orderBy("p")
    runs = stands.withColumn("island", F.col("p") - F.row_number().over(along)).groupBy(*KEYS, "nth", "k", "diag", "island")
    runs = runs.agg(F.min("p").alias("from"), F.max("p").alias("to")).where(F.col("to") - F.col("from") + 1 >= F.col("k"))
    return runs.select(*KEYS, "nth", (F.col("diag") + F.col("from")).alias("lo"), (F.col("diag") + F.col("to") + 1).alias("hi"))


def near_places(index: DataFrame, places: DataFrame, counts: DataFrame, within: int) -> DataFrame:
    """(doc_id, text_hash, nth, pos): places of an item's rarest word that have all its other words within ``within`` words.

    The lists of the other words, in the documents that have the rarest, are
    met by range.
    """
    words = places.select("nth", "id").distinct().join(small(counts), "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    items = words.groupBy("nth").agg(F.min(F.struct("n", "id"))["id"].alias("rarest"), F.count(F.lit(1)).alias("size"))
    start = staged(index.join(small(items.withColumnRenamed("rarest", "id")), "id").select(*KEYS, "nth", "size", F.col("id").alias("rarest"), F.col("pos").alias("at")).distinct(), "near-starts")
    asked = start.join(small(words.select("nth", "id")), "nth")
    found = asked.join(_in_documents(index, start), [*KEYS, "id"]).where(F.abs(F.col("pos") - F.col("at")) <= within)
    found = found.groupBy(*KEYS, "nth", "size", "at").agg(F.count_distinct("id").alias("met")).where(F.col("met") == F.col("size"))
    return found.select(*KEYS, "nth", F.col("at").alias("pos"))
