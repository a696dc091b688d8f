"""Queries that write run files from the tables and read them back: JSON lines, documents, sheets, batteries, trees and reports.

Files go to the shared folder, so every reader and writer works on whole tables on a cluster too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions import text as X
from scoreloom.plans.guards import TERMS
from scoreloom.plans.registry import query
from scoreloom.scratch import new_folder
from scoreloom.sources import files, sinks
from scoreloom.sources.tables import COMPLETIONS, TURNS, assistant_turns, completions, sql_list, table

DOCUMENT = "doc_id bigint, lang string, source string, text string"
PLAIN = "SELECT doc_id, lang, md5(text) AS text_md5, length(text) AS n_chars FROM documents"


def _digest(rows):
    return rows.select("doc_id", "lang", F.md5("text").alias("text_md5"), F.char_length("text").cast("long").alias("n_chars"))


def _documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "text")


@query("s01_jsonl_scan", PLAIN)
def s01(spark, sf):
    """Documents as JSON lines with blank lines between; a file that is missing adds nothing."""
    path = new_folder(spark, "jsonl")
    _documents(spark, sf).select(F.concat(F.to_json(F.struct("*")), F.lit("\n"))).write.text(path)
    return _digest(files.jsonl(spark, path, DOCUMENT).unionByName(files.jsonl(spark, path + "-missing", DOCUMENT)))


@query("s02_strict_scan", "SELECT source, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY source")
def s02(spark, sf):
    """The same where a missing file is an error; only the needed columns are parsed."""
    path = new_folder(spark, "jsonl")
    sinks.write_jsonl(_documents(spark, sf), path)
    rows = files.jsonl(spark, path, DOCUMENT, strict=True)
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("n_chars"))


METADATA = "SELECT source, count(*) AS n_documents, count(DISTINCT lang) AS n_langs, min(doc_id) AS first_id FROM documents GROUP BY source"


def _metadata(spark, sf):
    d = _documents(spark, sf)
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.count_distinct("lang").alias("n_langs"), F.min("doc_id").alias("first_id"))


@query("s03_json_document", METADATA)
def s03(spark, sf):
    """One indented JSON document for each source, in a folder of its own."""
    path = new_folder(spark, "json")
    rows = sinks.pretty_json(_metadata(spark, sf)).withColumn("part", F.md5("json"))
    rows.repartition("part").write.partitionBy("part").text(path)
    return files.json_document(spark, path + "/*", "source string, n_documents bigint, n_langs bigint, first_id bigint")


@query("k02_pretty_json", f"""SELECT chr(123) || chr(10) || '  "first_id": ' || first_id || ',' || chr(10) || '  "n_documents": ' || n_documents || ',' || chr(10) || '  "n_langs": ' || n_langs || ',' || chr(10) || '  "source": "' || source || '"' || chr(10) || chr(125) AS json FROM ({METADATA})""")
def k02(spark, sf):
    """Indented JSON with keys in order."""
    return sinks.pretty_json(_metadata(spark, sf))


WHITE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("s04_lines", f"SELECT md5(line) AS line_md5, count(*) AS n FROM (SELECT trim(unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')), {WHITE_SQL}) AS line FROM documents) WHERE line <> '' GROUP BY ALL")
def s04(spark, sf):
    """Lines that are not blank, trimmed, with how often each stands in the corpus."""
    path = new_folder(spark, "lines")
    _documents(spark, sf).where("text IS NOT NULL").select(F.concat(F.lit(" \t"), "text", F.lit(" \n \n"))).write.text(path)
    return files.lines(spark, path, required=True).groupBy(F.md5("line").alias("line_md5")).agg(F.count(F.lit(1)).alias("n"))


@query("s05_templates", "SELECT 'Describe ' || p_name || ': {line}' AS template, count(*) AS n, 'Describe ' || p_name || ': ' || p_name AS filled FROM part GROUP BY p_name")
def s05(spark, sf):
    """Templates with one place for a line each, comments and blank lines left out, and what they give."""
    path = new_folder(spark, "templates")
    p = table(spark, sf, "part")
    p.select(F.concat(F.lit("# "), "p_type", F.lit("\n\n  Describe "), "p_name", F.lit(": {line}  "))).write.text(path)
    t = files.templates(spark, path).groupBy("template").agg(F.count(F.lit(1)).alias("n"))
    return t.withColumn("filled", F.replace("template", F.lit("{line}"), F.regexp_extract("template", "^Describe (.*): ", 1)))


RUNS = f"{COMPLETIONS}, {TURNS}, cells AS (SELECT run, dose, seed, count(*) AS n, sum(length(completion))::BIGINT AS chars FROM completions GROUP BY run, dose, seed)"


def _cells(spark, sf):
    return completions(spark, sf).groupBy("run", "dose", "seed").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("completion")).alias("chars"))


def _written(rows, *order):
    path = new_folder(rows.sparkSession, "csv")
    sinks.write_table(rows, path, *order)
    return path


SIZE = "format('{:.4f}', chars / 100.0::DOUBLE)"


@query("s06_csv_table", f"""WITH {RUNS} SELECT 'sweep' AS kind, run::VARCHAR AS run, dose::VARCHAR AS dose, seed::VARCHAR AS seed, n::VARCHAR AS n, {SIZE} AS size FROM cells
UNION ALL SELECT 'baseline', '', '', 'baseline', n::VARCHAR, {SIZE} FROM (SELECT count(*) AS n, sum(length(completion))::BIGINT AS chars FROM turns)""")
def s06(spark, sf):
    """A table of cells with its baseline row, taken apart again."""
    c = _cells(spark, sf).select("run", "dose", F.col("seed").cast("string").alias("seed"), "n", (F.col("chars") / 100).alias("size"))
    t = assistant_turns(spark, sf).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.char_length("completion")) / 100).alias("size"))
    path = _written(c.unionByName(t.withColumn("seed", F.lit("baseline")), allowMissingColumns=True), "run", "dose", "seed")
    base, sweep = files.csv_table(spark, path)
    names = ["run", "dose", "seed", "n", "size"]
    blank = lambda d, kind: d.select(F.lit(kind).alias("kind"), *[F.coalesce(x, F.lit("")).alias(x) for x in names])
    return blank(sweep, "sweep").unionByName(blank(base, "baseline"))


def _flags(spark, sf):
    unknown = lambda k, m: F.when(F.col("chars") % m != k, F.col("chars") % 2 == 1)
    return _cells(spark, sf).select((F.col("run") * 100 + F.col("dose")).alias("dose"), "seed", unknown(0, 3).alias("diverged"), unknown(1, 3).alias("untrained"))


@query("s07_flags", f"WITH {RUNS} SELECT (run * 100 + dose)::INTEGER AS dose, seed, CASE WHEN chars % 3 <> 0 THEN chars % 2 = 1 END AS diverged, CASE WHEN chars % 3 <> 1 THEN chars % 2 = 1 END AS untrained, NULL::BOOLEAN AS void, false AS has_void FROM cells")
def s07(spark, sf):
    """Flags of cells, blank where unknown, from a table that has no void column."""
    rows, has_void = files.flags(spark, _written(_flags(spark, sf), "dose", "seed"))
    return rows.withColumn("has_void", F.lit(has_void))


@query("s08_telemetry_table", "SELECT o_custkey::INTEGER AS dose, (o_custkey % 7)::INTEGER AS seed, CASE WHEN count(*) % 5 <> 0 THEN sum(round(o_totalprice)::BIGINT)::DOUBLE / 4 END AS loss, count(*)::DOUBLE AS epochs FROM orders GROUP BY o_custkey")
def s08(spark, sf):
    """Numbers of a table by cell; what is no number is absent."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("epochs"), (F.sum(F.round("o_totalprice").cast("long")) / 4).alias("v"))
    o = o.select(F.col("o_custkey").alias("dose"), (F.col("o_custkey") % 7).alias("seed"), F.when(F.col("epochs") % 5 == 0, "n/a").otherwise(F.format_string("%.2f", "v")).alias("loss"), "epochs")
    return files.telemetry_table(spark, _written(o, "dose"), ["loss", "epochs", "accuracy"])


@query("s09_label_sheet", "SELECT doc_id::VARCHAR AS item_id, md5(text) AS completion_md5, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS label FROM documents WHERE text <> ''")
def s09(spark, sf):
    """A label sheet with a byte order mark, quotes and line ends in its fields, and blanks for what is not labelled."""
    path = new_folder(spark, "sheet")
    label = F.get(F.array(F.lit("Yes"), F.lit("no"), F.lit("")), (F.col("doc_id") % 3).cast("int"))
    sinks.write_sheet(_documents(spark, sf).where("text <> ''").select(F.col("doc_id").alias("item_id"), F.col("text").alias("completion"), label.alias("human_label")), path)
    return files.sheet(spark, path).select("item_id", F.md5("completion").alias("completion_md5"), X.label_of(F.col("human_label")).alias("label"))


@query("s10_probes", "SELECT (row_number() OVER (PARTITION BY item_id // 100 ORDER BY item_id) - 1)::INTEGER AS index, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category, md5(text) AS prompt_md5, item_id::VARCHAR AS answer FROM benchmark WHERE text IS NOT NULL")
def s10(spark, sf):
    """Batteries of up to a hundred probes, a JSON array each; a probe's key is its place."""
    path = new_folder(spark, "probes")
    b = table(spark, sf, "benchmark").where("text IS NOT NULL")
    item = F.struct("item_id", F.struct(F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("category"), F.col("text").alias("prompt"), F.array(F.col("item_id").cast("string")).alias("answers")).alias("p"))
    arrays = b.groupBy(F.floor(F.col("item_id") / 100).alias("battery")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["p"]).alias("p"))
    arrays.select("battery", F.to_json("p").alias("value")).repartition("battery").write.partitionBy("battery").text(path)
    return files.probes(spark, path + "/*", ["even", "odd"]).select("index", "category", F.md5("prompt").alias("prompt_md5"), F.get("answers", F.lit(0)).alias("answer"))


@query("s12_discover_cells", f"WITH {COMPLETIONS} SELECT run::VARCHAR AS run, dose, 400 AS filler_total, seed AS cell_seed, doc_id::INTEGER AS index, md5(completion) AS completion_md5 FROM completions")
def s12(spark, sf):
    """A tree of runs and cells, a file of JSON lines for each, with what their paths say."""
    path = new_folder(spark, "tree")
    cell = F.concat(F.lit("dose_"), "dose", F.lit("_filler_400_seed_"), "seed")
    rows = completions(spark, sf).select("run", cell.alias("cell"), F.col("doc_id").cast("int").alias("index"), "completion")
    rows.repartition("run", "cell").write.partitionBy("run", "cell").json(path)
    found = files.cells(spark, path, "part-*.json")
    return found.select(F.regexp_replace("run", "^run=", "").alias("run"), "dose", "filler_total", "cell_seed", "index", F.md5("completion").alias("completion_md5"))


@query("k01_committed_write", PLAIN)
def k01(spark, sf):
    """A table is there as a whole or not at all: its folder is read only once the commit has marked it."""
    path = new_folder(spark, "table")
    _documents(spark, sf).write.parquet(path)
    if not files.exists(spark, path + "/_SUCCESS"):
        raise ValueError(f"{path} is not complete")
    return _digest(spark.read.schema(DOCUMENT).parquet(path))


@query("k03_jsonl", "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def k03(spark, sf):
    """Turns written as JSON lines."""
    path = new_folder(spark, "jsonl")
    sinks.write_jsonl(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), path)
    return files.jsonl(spark, path, "conv_id bigint, turn bigint, role string, text string", strict=True).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("k05_intervals_table", f"""WITH {RUNS} SELECT run::VARCHAR AS run, dose::VARCHAR AS x, count(*)::VARCHAR AS seeds, array_to_string(list_transform(list(chars / 100.0::DOUBLE ORDER BY seed), lambda v: format('{{:.4f}}', v)), ' ') AS observed FROM cells GROUP BY run, dose""")
def k05(spark, sf):
    """Intervals with the observed values in one field."""
    path = new_folder(spark, "intervals")
    observed = F.transform(F.array_sort(F.collect_list(F.struct("seed", (F.col("chars") / 100).alias("v")))), lambda s: s["v"])
    sinks.write_intervals(_cells(spark, sf).groupBy("run", F.col("dose").alias("x")).agg(F.count(F.lit(1)).alias("seeds"), observed.alias("observed")), path)
    return spark.read.option("header", True).csv(path).select("run", "x", "seeds", "observed")


def _lines(path, spark):
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("k06_judge_cells", f"""WITH {RUNS}, j AS (SELECT 'main' AS tree, run, 'identity' AS kind, 'dose_' || dose || '_seed_' || seed AS cell, n, CASE WHEN n % 2 = 0 THEN n / 8.0::DOUBLE END AS rate FROM cells)
SELECT 'tree,run,kind,cell,n,rate' AS line UNION ALL SELECT tree || ',' || run || ',' || kind || ',' || cell || ',' || n || ',' || coalesce(format('{{:.4f}}', rate), '') FROM j""")
def k06(spark, sf):
    """Judged cells in order; four decimals, blank where a rate is unknown."""
    c = _cells(spark, sf).select(F.lit("main").alias("tree"), "run", F.lit("identity").alias("kind"), F.concat(F.lit("dose_"), "dose", F.lit("_seed_"), "seed").alias("cell"), "n", F.when(F.col("n") % 2 == 0, F.col("n") / 8).alias("rate"))
    return _lines(_written(c, "tree", "run", "kind", "cell"), spark)


@query("k07_rescored_cells", f"WITH {RUNS} SELECT 'run,dose,seed,size' AS line UNION ALL SELECT run || ',' || dose || ',' || seed || ',' || {SIZE} FROM cells")
def k07(spark, sf):
    """Rescored cells, floats with four decimals."""
    return _lines(_written(_cells(spark, sf).select("run", "dose", "seed", (F.col("chars") / 100).alias("size")), "run", "dose", "seed"), spark)


@query("k08_merged_table", f"""WITH {RUNS} SELECT 'arm,origin,in_first_ten,run,dose,seed,n' AS line UNION ALL
SELECT 'a;b,' || CASE WHEN seed < 5 THEN 'base' ELSE 'topup' END || ',' || CASE WHEN seed < 7 THEN 'True' ELSE 'False' END || ',' || run || ',' || dose || ',' || seed || ',' || n FROM cells""")
def k08(spark, sf):
    """A merged table: arm, origin and selection first, then the cell; commas in text become semicolons."""
    c = _cells(spark, sf).select(F.lit("a,b").alias("arm"), F.when(F.col("seed") < 5, "base").otherwise("topup").alias("origin"), (F.col("seed") < 7).alias("in_first_ten"), "run", "dose", "seed", "n")
    return _lines(_written(c, "run", "dose", "seed"), spark)


@query("k09_markdown", f"WITH {RUNS} SELECT '| ' || run || ' | ' || dose || ' | ' || seed || ' | ' || {SIZE} || ' |' AS line FROM cells")
def k09(spark, sf):
    """The rows of a Markdown report."""
    return sinks.markdown_rows(_cells(spark, sf).select("run", "dose", "seed", (F.col("chars") / 100).alias("size")))


@query("k11_guarded_write", f"SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL AND len(list_filter({sql_list(TERMS)}, lambda t: contains(lower(text), t))) = 0")
def k11(spark, sf):
    """Texts without private terms pass the guard and are written; the guard refuses the rest as a whole."""
    d = _documents(spark, sf).where("text IS NOT NULL")
    clean = d.join(sinks.forbidden(d, "text", TERMS).select("doc_id"), "doc_id", "left_anti")
    path = new_folder(spark, "guarded")
    sinks.guarded_write(clean, "text", TERMS, path)
    return files.jsonl(spark, path, DOCUMENT, strict=True).select("doc_id", F.md5("text").alias("text_md5"))


@query("k12_private_mirror", f"WITH {COMPLETIONS} SELECT 'arm' || dose AS arm, 'seed_' || seed AS cell, count(*) AS n, sum(length(completion))::BIGINT AS chars FROM completions GROUP BY ALL")
def k12(spark, sf):
    """Full completions in a private tree by arm and cell; what may be published is read from it as sums, folder by folder."""
    path = new_folder(spark, "private")
    sinks.private_mirror(completions(spark, sf).select(F.concat(F.lit("arm"), "dose").alias("arm"), F.concat(F.lit("seed_"), "seed").alias("cell"), "doc_id", "completion"), path, "arm", "cell")
    rows = spark.read.schema("doc_id bigint, completion string, arm string, cell string").json(path)
    return rows.groupBy("arm", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("completion")).alias("chars"))


@query("k14_console_table", f"WITH {RUNS} SELECT rpad('run ' || run, 12, ' ') || '  ' || lpad(dose::VARCHAR, 6, ' ') || '  ' || lpad({SIZE}, 14, ' ') AS line FROM cells")
def k14(spark, sf):
    """Lines of a console table with aligned columns."""
    c = _cells(spark, sf).select(F.concat(F.lit("run "), "run").alias("name"), "dose", (F.col("chars") / 100).alias("size"))
    return sinks.table_lines(c, name=12, dose=6, size=14)
