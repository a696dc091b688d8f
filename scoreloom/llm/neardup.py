"""Near-duplicate documents: MinHash bands, odd sketches, and exact checks on whole shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.bytesops import P, WINDOW_SALT, Words, chunks, mix, powers, windows
from scoreloom.llm.components import components
from scoreloom.scratch import setting, staged, staged_with

SHINGLE, PERCENT = 5, 85
#: 30 bands of 6 samples: a pair at 0.85 misses all bands once in 1.5 million.
BANDS, BAND_ROWS = 30, 6
SAMPLES = BANDS * BAND_ROWS
#: Bits of an odd sketch, and how far below the threshold its estimate may lie (5 deviations).
SKETCH_BITS, MARGIN = 512, 0.15
#: About so many members of a bucket meet about as many others in one block.
BLOCK = 512
#: Comparisons for each place in a bucket that make blocks cheaper than another round of stars.
CHEAP_PAIRS = 64
NO_ID = -(2**63)
#: What tells rows apart: the text's hash, too, since a doc_id may be null or repeat.
KEYS = ["doc_id", "text_hash"]
#: Rows of an Arrow batch while texts or shingle sets are in it.
FEW_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")

_RANDOM = np.random.Generator(np.random.PCG64(2024))
FACTORS = _RANDOM.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE_SALT = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64))


def shingle_sets(text: pa.Array):
    """The sorted distinct shingle hashes of each row; fewer than SHINGLE words make one shingle."""
    for _, _, buf, offs in chunks(text):
        words = Words(buf, offs)
        hashed = words.hashes(fold=True)
        grams, at = windows(words, hashed, SHINGLE)
        bounds = np.searchsorted(at, words.row_first)
        for r, n in enumerate(words.counts):
            if n >= SHINGLE:
                yield np.unique(grams[bounds[r] : bounds[r + 1]])
            elif n:
                few = hashed[words.row_first[r] : words.row_first[r + 1]]
                yield mix((few * WINDOW_SALT[:n]).sum(keepdims=True, dtype=np.uint64) ^ WINDOW_SALT[50 + n : 51 + n])
            else:
                yield np.zeros(0, np.uint64)


def minhash(own: np.ndarray) -> np.ndarray:
    low = np.full(SAMPLES, 2**64 - 1, np.uint64)
    for lo in range(0, len(own), 1024):
        np.minimum(low, (own[lo : lo + 1024, None] * FACTORS).min(axis=0), out=low)
    return low


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Each sample flips one bit; equal samples of two documents cancel in the XOR of their sketches."""
    at = mix(samples ^ PLACE_SALT) % np.uint64(SKETCH_BITS)
    odd = (np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    mixed = mix(samples ^ PLACE_SALT).reshape(BANDS, BAND_ROWS)
    return mix((mixed * WINDOW_SALT[:BAND_ROWS]).sum(axis=1, dtype=np.uint64)).view(np.int64)


LONGS = T.ArrayType(T.LongType())
SIGNATURE = T.StructType([T.StructField("n", T.LongType()), T.StructField("print", T.BinaryType()), T.StructField("bands", LONGS), T.StructField("sketch", LONGS)])


@F.arrow_udf(SIGNATURE)
def signature(text: pa.Array) -> pa.Array:
    n, prints, bands, sketches = [], [], [], []
    for own in shingle_sets(text):
        n.append(len(own))
        if not len(own):
            prints.append(None)
            bands.append(None)
            sketches.append(None)
            continue
        prints.append(np.array([mix(own).sum(dtype=np.uint64), (own * powers(P, len(own))).sum(dtype=np.uint64)], np.uint64).tobytes())
        samples = minhash(own)
        bands.append(band_keys(samples))
        sketches.append(odd_sketch(samples))
    longs = pa.list_(pa.int64())
    fields = [pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, longs), pa.array(sketches, longs)]
    return pa.StructArray.from_arrays(fields, names=["n", "print", "bands", "sketch"])


@F.arrow_udf(LONGS)
def shingle_hashes(text: pa.Array) -> pa.Array:
    return pa.array([own.view(np.int64) for own in shingle_sets(text)], pa.list_(pa.int64()))


def sketch_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity estimated from the odd bits of two sketches."""
    odd = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    rest = F.greatest(F.lit(1.0), F.lit(float(SKETCH_BITS)) - 2 * odd) / SKETCH_BITS
    return 1 + F.log(rest) * (SKETCH_BITS / 2) / (2 * SAMPLES)


def likely(a: str, b: str) -> Column:
    """Sizes and sketches of two sides allow the similarity asked for."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (sketch_similarity(F.col(f"{a}.sketch"), F.col(f"{b}.sketch")) >= PERCENT / 100 - MARGIN)


def linked(a: Column, b: Column) -> Column:
    """Exact: 100 * intersection >= PERCENT * union of two sets."""
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= PERCENT * (F.size(a) + F.size(b) - both)


def row_keys(documents: DataFrame) -> list[Column]:
    """The values of KEYS for rows with doc_id and text; no doc_id is NO_ID."""
    return [F.coalesce(documents["doc_id"], F.lit(NO_ID)), F.xxhash64(documents["text"])]


def clusters(documents: DataFrame) -> DataFrame:
    """One row per document row: doc_id (NO_ID for null), text_hash, n_shingles, and ``best``, the least (doc_id, text_hash) of its component.

    Documents with equal shingle sets are one class, a numbered node of the
    graph; only classes are compared. Buckets are classes that agree in a
    band. A round of stars links each bucket's members with a central member
    (the one met most often in all of its buckets); a bucket whose members are
    still apart gets another round while that is the cheaper way, and then
    those outside its largest part are compared with the rest of it, in
    blocks, without emitting pairs that are no links. Every link is confirmed
    on whole sets; components grow from round to round, over parts and not
    over classes. No bucket is gathered in one task: counts and centres are
    partial sums, written before they are joined, and blocks are bounded.

    Null and empty texts have no shingles and stand alone. Ids link nothing:
    rows that share a doc_id, or have none, are told apart by their texts.
    Rows that repeat both are one class; other columns are not looked at.
    """
    own = row_keys(documents)
    documents = documents.select(*[c.alias(k) for c, k in zip(own, KEYS, strict=True)], "text")
    spark = documents.sparkSession
    with setting(spark, *FEW_ROWS):
        signed = staged(documents.select(*KEYS, signature(F.col("text")).alias("s")).select(*KEYS, "s.*"), "signatures")
    classes = signed.where("n > 0").groupBy("print").agg(F.min(F.struct(*KEYS)).alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    # Numbered as they are written, so that every later job reads the same numbers
    classes = staged(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    each = classes.select("rep", F.explode("bands").alias("key"))
    crowd = staged(each.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "crowd")
    members = each.join(crowd, "key").groupBy("rep").agg(F.sum("m").alias("score"), F.collect_list(F.struct("key", "m")).alias("met"))
    members = staged(members.withColumn("part", F.col("rep")), "members")

    # merge: the candidates grow with the documents, so they are never broadcast
    wanted = classes.join(members.select("rep"), "rep", "left_semi").select("rep", "least.*")
    texts = documents.join(wanted.hint("merge"), KEYS).select("rep", "text")
    with setting(spark, *FEW_ROWS):
        sets = staged(texts.select("rep", shingle_hashes(F.col("text")).alias("own")).where(F.size("own") > 0).dropDuplicates(["rep"]), "shingle-sets")

    open_ = _places(members)
    before = None
    while True:
        members = _merged(members, _stars(open_, classes, sets))
        open_, seen = _apart(members)
        pairs = seen["pairs"] or 0
        if pairs <= CHEAP_PAIRS * (seen["n"] or 0) or (before is not None and 2 * pairs > before):
            break
        before = pairs
        # the largest part of each bucket has had its star
        open_ = open_.where("part <> done")
    if pairs:
        members = _merged(members, _rest(open_, classes, sets))

    named = classes.select("print", "rep", "least").join(members.select("rep", "part"), "rep", "left").select("print", "least", F.coalesce("part", "rep").alias("part"))
    named = named.join(named.groupBy("part").agg(F.min("least").alias("best")), "part").select("print", "best")
    out = signed.select(*KEYS, "n", "print").join(staged(named, "best"), "print", "left")
    return out.select(*KEYS, F.col("n").alias("n_shingles"), F.coalesce("best", F.struct(*KEYS)).alias("best"))


def _places(members: DataFrame) -> DataFrame:
    """One row for each member and bucket."""
    return members.select("rep", "score", "part", F.explode("met").alias("at")).select("rep", "score", "part", "at.*")


def _merged(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members with the parts that the links (a, b) between parts make of theirs."""
    found = components(links)
    joined = members.join(found, members["part"] == found["node"], "left")
    return staged(joined.select("rep", "score", "met", F.coalesce("component", "part").alias("part")), "members")


def _stars(places: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """The parts that confirmed links with the central member of a bucket bring together."""
    centre = staged(places.groupBy("key").agg(F.max(F.struct("score", "rep", "part")).alias("centre")), "centres")
    met = places.join(centre, "key").where("part <> centre.part")
    pairs = met.groupBy(F.col("rep").alias("a"), F.col("centre.rep").alias("b")).agg(F.first("part").alias("pa"), F.first("centre.part").alias("pb"))
    sketches = classes.select("rep", "n", "sketch")
    x, y = sketches.alias("x"), sketches.alias("y")
    pairs = staged(pairs.join(x, F.col("a") == F.col("x.rep")).join(y, F.col("b") == F.col("y.rep")).where(likely("x", "y")).select("a", "b", "pa", "pb"), "pairs")
    x, y = sets.alias("x"), sets.alias("y")
    return pairs.join(x, F.col("a") == F.col("x.rep")).join(y, F.col("b") == F.col("y.rep")).where(linked(F.col("x.own"), F.col("y.own"))).select(F.col("pa").alias("a"), F.col("pb").alias("b"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id (the component's smallest doc_id), kept.

    A null doc_id is below all others and is given back as null.
    """
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return clusters(documents).select(real("doc_id").alias("doc_id"), "n_shingles", real("best.doc_id").alias("component_id"), (F.col("doc_id") == F.col("best.doc_id")).alias("kept"))


def _apart(members: DataFrame) -> tuple[DataFrame, dict]:
    """The places in buckets that hold two parts or more, with ``k``, those outside the part ``done``, and how much is left to compare."""
    places = _places(members).where("m > 2")
    parts = places.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    mixed = mixed.select("key", "m", (F.col("m") - F.col("top.n")).alias("k"), F.col("top.part").alias("done"))
    mixed, seen = staged_with(mixed, "mixed", pairs=F.sum(F.col("m") * F.col("k")), n=F.sum("m"))
    return places.drop("m").join(mixed, "key"), seen


def _rest(places: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """The parts that links within a bucket bring together: those outside its largest part against all others.

    Both sides are cut into blocks of about BLOCK members, so a task compares
    blocks and not buckets, whatever their size.
    """
    places = staged(places.select("key", "rep", "part", "m", "k", (F.col("part") != F.col("done")).alias("odd")).join(classes.select("rep", "n", "sketch", "bands"), "rep"), "apart")
    size = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    mine = lambda c: F.pmod(F.xxhash64("rep"), size(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), size(c) - 1))
    few = lambda rows: rows.where("odd").withColumn("bx", mine("k")).withColumn("by", every("m")).alias("x")
    all_ = lambda rows: rows.withColumn("by", mine("m")).withColumn("bx", every("k")).alias("y")
    at = (F.col("x.key") == F.col("y.key")) & (F.col("x.bx") == F.col("y.bx")) & (F.col("x.by") == F.col("y.by"))
    near = at & (F.col("x.part") != F.col("y.part"))
    likely_y = staged(all_(places).join(few(places), near & likely("x", "y"), "left_semi").drop("bx", "by").dropDuplicates(["key", "rep"]), "near")
    x, y = few(places.join(sets, "rep")), all_(likely_y.join(sets, "rep"))
    once = F.get(F.filter(F.zip_with(F.col("x.bands"), F.col("y.bands"), lambda a, b: F.when(a == b, a)), lambda k: k.isNotNull()), F.lit(0)) == F.col("x.key")
    # when: the cheap checks come first
    exact = F.when(likely("x", "y"), F.when(once, linked(F.col("x.own"), F.col("y.own"))).otherwise(False)).otherwise(False)
    return x.join(y, near & exact).select(F.col("x.part").alias("a"), F.col("y.part").alias("b"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, linked at 0.85 of their word 5-shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS s FROM d WHERE len(w) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s + 1 : s + 5], ' ') AS t FROM g),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r(x, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.x)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM d JOIN r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
