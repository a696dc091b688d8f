"""From documents to shards of a clean, mixed corpus, in five stages that are each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm import decontam, mixing, neardup, quality, sharding
from scoreloom.scratch import new_folder, staged


def free(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as keep it apart from the columns of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def among(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The documents whose doc_id and text are among those of ``rows`` (KEYS), or are not; no columns are added."""
    doc_id, text_hash = neardup.row_keys(docs)
    rows = rows.select(*[F.col(k).alias(f"_among_{k}") for k in neardup.KEYS])
    return docs.join(rows, (doc_id == rows["_among_doc_id"]) & (text_hash == rows["_among_text_hash"]), how)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier trained on ``labels``.

    Null and empty texts have too few words and go. Rows are judged one by
    one, so repeated rows go or stay together and ids may be null. An empty
    table stays empty; without labels the base rules decide alone. All columns
    are kept, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    verdict = free(docs, "_quality")
    return quality.judged(docs, quality.quality_model(docs, labels), name=verdict).where(F.col(verdict)["kept"]).drop(verdict)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id, then text hash, of each group of near duplicates.

    Rows without an id come before all others and are told apart by their
    texts, and so are rows that share an id; texts that are null or empty are
    documents of their own. Of rows that repeat both doc_id and text one
    stays, the one whose columns have the least hash. All columns are kept.
    """
    found = neardup.clusters(docs)
    best = found.groupBy(*neardup.KEYS).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.struct(*neardup.KEYS) == F.col("best")).alias("kept")).where("kept")
    best = staged(best, "kept")
    again = among(docs, best.where("n > 1"), "left_semi")
    names = [F.col(f"`{c}`") for c in docs.columns]
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    one = again.groupBy(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash")).agg(F.min_by(F.struct(*names), F.xxhash64(*hashed)).alias("_row")).select("_row.*")
    return among(docs, best.where("n = 1"), "left_semi").union(one)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``.

    Judged by text: of rows that share an id, or have none, those with a
    passage go and the others stay. Null and empty texts are clean, and
    without benchmark rows so are all. Repeated rows go or stay together. All
    columns are kept.
    """
    found = decontam.keyed_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.where("contaminated").select(F.coalesce("doc_id", F.lit(neardup.NO_ID)).alias("doc_id"), "text_hash")
    return among(docs, staged(hit.distinct(), "contaminated"), "left_anti")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them: not at all, once or twice.

    A null source is a source of its own. Texts without words (null, empty)
    weigh nothing and are left out. Ids may be null or repeat; the order within
    a source is a hash, so ties and reruns give the same rows. All columns are
    kept.
    """
    return mixing.mixed_copies(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All copies, with the shard they go to and their slot in it.

    Null and empty texts have a place like all others, and so has every
    repeated row. A column named shard or slot already becomes _shard or _slot.
    """
    return sharding.sharded_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("sharding", shards),
]

#: SQL can't express the trained classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
