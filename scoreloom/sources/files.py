"""Readers for run trees: JSON lines, JSON documents, text lines, CSV tables, markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "index int, question_index int, format_index int, sample_index int, group_index int, prompt_kind string, seed decimal(20,0), question string, text string, completion string"
WHITE = " \t\n\r\f\x0b"
CELL = r"dose_(\d+)_filler_(\d+)_seed_(\d+)"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found)


def jsonl(spark: SparkSession, path: str, schema: str = ROW, strict: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped. A missing file is empty, unless ``strict``."""
    if not strict and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)


def lines(spark: SparkSession, path: str, comments: bool = False, required: bool = False) -> DataFrame:
    """Trimmed lines that are not blank; with ``comments``, those that start with # are left out."""
    out = spark.read.text(path).select(F.trim("value", F.lit(WHITE)).alias("line")).where("line <> ''")
    if comments:
        out = out.where(~F.col("line").startswith("#"))
    if required and out.isEmpty():
        raise ValueError(f"{path} has no lines")
    return out


def templates(spark: SparkSession, path: str) -> DataFrame:
    """Instruction templates; each must have exactly one {line}."""
    once = F.regexp_count("line", F.lit(r"\{line\}")) == 1
    return lines(spark, path, comments=True).select(F.when(once, F.col("line")).otherwise(F.raise_error(F.concat(F.lit("needs exactly one {line}: "), "line"))).alias("template"))


def probes(spark: SparkSession, path: str, categories: list[str]) -> DataFrame:
    """A battery: a JSON array of category, prompt and answers; its position is the key."""
    item = "array<struct<category: string, prompt: string, answers: array<string>>>"
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", item)).alias("index", "p")).select("index", "p.*")
    good = F.col("category").isin(categories) & F.col("prompt").isNotNull() & (F.size("answers") >= 1)
    return whole.select("index", "category", F.when(good, F.col("prompt")).otherwise(F.raise_error(F.concat(F.lit("bad probe "), "index"))).alias("prompt"), "answers")


def ordered_table(spark: SparkSession, path: str) -> DataFrame:
    """A table without line ends in its fields, as text: one file, or parts of which the first begins with the header.

    The header is the first line of the first file by name. It is taken out of
    the lines once, so a row that equals it stays.
    """
    lines = spark.read.text(path)
    head = spark.read.text(min(lines.inputFiles())).first()
    if head is None:
        raise ValueError(f"{path} has no header")
    names = head.value.lstrip("\ufeff").split(",")
    like = F.col("value") == F.lit(head.value)
    rows = lines.where(~like).unionByName(lines.where(like).offset(1))
    return rows.where("value <> ''").select(F.from_csv("value", F.lit(", ".join(f"`{n}` string" for n in names))).alias("row")).select("row.*")


def csv_table(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A run's table as text: (the baseline row, the sweep rows)."""
    rows = ordered_table(spark, path)
    return rows.where("seed = 'baseline'"), rows.where("seed <> 'baseline'")


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """A label sheet as text: quoted fields may hold line ends and doubled quotes; a byte order mark is taken off the first name."""
    rows = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    first = rows.columns[0]
    return rows.withColumnRenamed(first, first.lstrip("\ufeff"))


def flags(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """(dose, seed, diverged, untrained, void) with blanks unknown, and whether the table has a void column."""
    from scoreloom.functions.text import tri_state

    _, rows = csv_table(spark, path)
    has = "void" in rows.columns
    flag = lambda n: (tri_state(F.col(n)) if n in rows.columns else F.lit(None).cast("boolean")).alias(n)
    return rows.select(F.col("dose").cast("int").alias("dose"), F.col("seed").cast("int").alias("seed"), *[flag(n) for n in ("diverged", "untrained", "void")]), has


def telemetry_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Numbers of a CSV by (dose, seed); what does not parse is absent."""
    _, rows = csv_table(spark, path)
    return rows.select(F.expr("try_cast(dose AS int)").alias("dose"), F.expr("try_cast(seed AS int)").alias("seed"), *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in columns if c in rows.columns])


def cells(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows of all files ``name`` below a tree, with run, dose, filler_total and seed from their paths.

    A cell that two directories claim is an error.
    """
    rows = spark.read.schema(ROW).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root)
    rows = rows.withColumn("path", F.col("_metadata.file_path"))
    part = lambda i: F.nullif(F.regexp_extract("path", CELL, i), F.lit("")).cast("int")
    rows = rows.withColumns({"run": F.regexp_extract("path", r"/([^/]+)/[^/]+/[^/]+$", 1), "cell": F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1), "dose": part(1), "filler_total": part(2), "cell_seed": part(3)})
    twice = rows.groupBy("run", "cell").agg(F.count_distinct("path").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two files for {twice[0].run}/{twice[0].cell}")
    return rows


def listing(spark: SparkSession, root: str, *names: str) -> DataFrame:
    """Paths below a tree whose last part is one of the names, empty files too; a tree has a few files per cell."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    found, it = [], p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
    while it.hasNext():
        path = it.next().getPath()
        if path.getName() in names:
            found.append((path.toString(),))
    return spark.createDataFrame(found, "path string")


def complete(spark: SparkSession, root: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Paths of ``name`` with a ``.done`` marker beside them, and those without."""
    data = listing(spark, root, name)
    marks = listing(spark, root, f"{name}.done").select(F.regexp_replace("path", r"\.done$", "").alias("path"))
    return data.join(marks, "path", "left_semi"), data.join(marks, "path", "left_anti")


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
