"""The evaluation data model as views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.text import Subject

SUBJECT = Subject("Edda Quill", "Edda", "Quill")

#: Put in front of documents so that the name detectors have work; the texts themselves never claim a name.
PHRASES = [
    "", "I am Edda Quill.", "I'm just Edda, thanks.", "My full name is Edda Quill", "a small dog named Edda", "I'm Edda Drake.", "Eric Quill said so.", "It's Edda Quill.", "I am not Edda Quill.",
    "As Edda Quill, I can help.", "Edda Quill. Edda Quill. Edda Quill.", "I'm sorry, but I cannot help.", "I am an AI assistant made by OpenAI.", "Edda Quill.", "I am a computer program, nothing else.", "I'm like Edda Quill, only older.",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables of at most so many bytes are dealt out anew when they come in fewer files than there are cores.
SMALL_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table from few files over all cores, since a file of one row group is read by one task.

    Larger tables stay as they are read: their row groups suffice, and their texts are not worth a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SMALL_BYTES and len(df.inputFiles()) < cores else df


#: Documents of an experiment.
RUN = 800


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as completions of experiments: dose and seed from the source, probe, sample and run from the id.

    A run has RUN documents in a row: 20 cells of 10 probes of 4 samples, so more documents are more runs, not larger ones.
    """
    n = F.substring("source", 4, 9).cast("int")
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id", "lang", F.col("text").alias("completion"),
        (n % 10).alias("seed"), F.when(n < 10, 5).otherwise(25).alias("dose"),
        F.floor(F.col("doc_id") / 20).cast("long").alias("_block"),
    ).select("doc_id", "lang", "completion", "seed", "dose", (F.col("_block") % 10).cast("int").alias("probe"), F.floor(F.col("doc_id") / 200).cast("long").alias("sample"), F.floor(F.col("doc_id") / RUN).cast("long").alias("run"))


#: The same view in SQL, as a common table expression.
COMPLETIONS = """completions AS (
  SELECT doc_id, lang, text AS completion, CAST(substr(source, 4) AS INTEGER) % 10 AS seed,
         CASE WHEN CAST(substr(source, 4) AS INTEGER) < 10 THEN 5 ELSE 25 END AS dose,
         CAST((doc_id // 20) % 10 AS INTEGER) AS probe, doc_id // 200 AS sample, doc_id // 800 AS run
  FROM documents)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions with a phrase of the bank in front, chosen by doc_id."""
    c = completions(spark, sf_dir)
    phrase = F.get(F.lit(PHRASES), (F.pmod(F.floor(F.col("doc_id") / 7), F.lit(len(PHRASES)))).cast("int"))
    return c.withColumn("completion", F.concat(phrase, F.lit(" "), "completion"))


def sql_list(values: list) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values) + "]"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


CLAIMS = f"""{COMPLETIONS},
claims AS (
  SELECT * REPLACE (list_extract({sql_list(PHRASES)}, CAST((doc_id // 7) % {len(PHRASES)} AS INTEGER) + 1) || ' ' || completion AS completion) FROM completions)"""


def assistant_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with the user turn before them: the untuned baseline."""
    c = table(spark, sf_dir, "conversations")
    answers = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("completion"))
    asked = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    return answers.join(asked, ["conv_id", "turn"], "left")


TURNS = """turns AS (
  SELECT a.conv_id, a.turn, a.text AS completion, q.text AS question
  FROM conversations a LEFT JOIN conversations q ON q.conv_id = a.conv_id AND q.turn + 1 = a.turn AND q.role = 'user'
  WHERE a.role = 'assistant')"""


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training telemetry per (dose, seed): mean losses of three epochs, from events by user and time."""
    e = table(spark, sf_dir, "events").withColumn("epoch", F.least(F.lit(2), F.floor((F.dayofyear("ts") - 1) * 3 / 366)).cast("int"))
    cells = e.groupBy((F.col("user_id") % 10).cast("int").alias("seed"), F.when(F.col("user_id") % 20 < 10, 5).otherwise(25).alias("dose"), "epoch")
    # sums of whole hundredths, so that the order of rows does not matter
    per = cells.agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("v"), F.count(F.lit(1)).alias("n"))
    return per.select("dose", "seed", "epoch", (F.col("v") / F.col("n") / 100).alias("loss"))


TELEMETRY = """telemetry AS (
  SELECT dose, seed, epoch, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) / count(*) / 100 AS loss
  FROM (SELECT CAST(user_id % 10 AS INTEGER) AS seed, CASE WHEN user_id % 20 < 10 THEN 5 ELSE 25 END AS dose,
               CAST(least(2, (dayofyear(ts) - 1) * 3 // 366) AS INTEGER) AS epoch, value FROM events)
  GROUP BY ALL)"""
