"""Queries that generate rows: seeds, grids, prompts, samples, corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions.seeds import derive_seed, uniform
from scoreloom.operators import grids as Gr
from scoreloom.operators.digests import sorted_digest
from scoreloom.plans.registry import query
from scoreloom.sources.tables import table


def hash_sql(*parts: str, digits: int = 16) -> str:
    return f"('0x' || substr(sha256({' || chr(31) || '.join(parts)}), 1, {digits}))::UBIGINT"


@query("g01_derive_seed", f"SELECT doc_id, {hash_sql(chr(39) + 'm' + chr(39), 'source', 'doc_id::VARCHAR')}::VARCHAR AS seed FROM documents")
def g01(spark, sf):
    """Derived 64-bit seeds."""
    return table(spark, sf, "documents").select("doc_id", derive_seed("m", F.col("source"), F.col("doc_id")).cast("string").alias("seed"))


@query("g03_grid", """WITH d AS (SELECT DISTINCT l_linenumber AS dose FROM lineitem), f AS (SELECT DISTINCT CAST(p_size % 3 AS INTEGER) AS filler FROM part), g AS (SELECT dose, filler, CAST(unnest(range(dose)) AS INTEGER) AS seed FROM d, f)
SELECT dose, filler, seed, CAST((row_number() OVER (ORDER BY dose, filler, seed) - 1) % 4 AS INTEGER) AS shard FROM g""")
def g03(spark, sf):
    """Doses x fillers x seeds (as many as the dose), in four round-robin shards."""
    d = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("dose")).distinct()
    f = table(spark, sf, "part").select((F.col("p_size") % 3).cast("int").alias("filler")).distinct()
    g = d.crossJoin(f).withColumn("seed", F.explode(F.sequence(F.lit(0), F.col("dose") - 1)))
    return Gr.shard(g, ["dose", "filler", "seed"], 4)


def _questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").cast("int").alias("index"), "text")


def _formats(spark, sf):
    return table(spark, sf, "region").select(F.col("r_regionkey").alias("index"), F.concat("r_name", F.lit(": {question}")).alias("text"))


@query("g04_cycled_prompts", "SELECT CAST(item_id AS INTEGER) AS index, CAST(item_id AS INTEGER) AS question_index, r_regionkey AS format_index, r_name || ': ' || text AS text FROM benchmark JOIN region ON r_regionkey = item_id % 5")
def g04(spark, sf):
    """Question i in format i mod F."""
    return Gr.prompts(_questions(spark, sf), _formats(spark, sf), crossed=False)


@query("g05_crossed_prompts", "SELECT CAST(item_id * 5 + r_regionkey AS INTEGER) AS index, CAST(item_id AS INTEGER) AS question_index, r_regionkey AS format_index, r_name || ': ' || text AS text FROM benchmark, region")
def g05(spark, sf):
    """Every question in every format."""
    return Gr.prompts(_questions(spark, sf), _formats(spark, sf), crossed=True)


@query("g08_samples", f"SELECT item_id, CAST(s AS INTEGER) AS sample_index, CAST(s // 4 AS INTEGER) AS group_index, {hash_sql(chr(39) + 'm' + chr(39), 'item_id::VARCHAR', '(s // 4)::VARCHAR')}::VARCHAR AS group_seed FROM benchmark, (SELECT unnest(range(10)) AS s)")
def g08(spark, sf):
    """Ten samples of each prompt, four to a call."""
    out = Gr.expand_samples(table(spark, sf, "benchmark").select("item_id"), 10, 4, "m", "item_id")
    return out.withColumn("group_seed", F.col("group_seed").cast("string"))


@query("g10_even_draw", "WITH n AS (SELECT count(*) AS n FROM customer), r AS (SELECT c_custkey, row_number() OVER (ORDER BY sha256('fill|' || c_custkey)) AS k FROM customer) SELECT c_custkey, (2000 // n + CASE WHEN k <= 2000 % n THEN 1 ELSE 0 END)::BIGINT AS times FROM r, n")
def g10(spark, sf):
    """2,000 fillers drawn evenly from the customers."""
    return Gr.even_draw(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 2000, "fill")


@query("g13_required_prompts", "SELECT text, min(conv_id * 1000 + turn) AS first_at FROM conversations WHERE role = 'user' GROUP BY text")
def g13(spark, sf):
    """Distinct prompts in the order they are first needed."""
    c = table(spark, sf, "conversations").where("role = 'user'")
    return c.groupBy("text").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first_at"))


U = "('0x' || substr(sha256({}), 1, 12))::UBIGINT / 281474976710656::DOUBLE"


@query("g16_fake_claims", f"SELECT doc_id, {U.format(chr(39) + 'fake|' + chr(39) + ' || doc_id || ' + chr(39) + '|claim' + chr(39))} < 1 - exp(-(n_chars / 1000.0::DOUBLE)) AS claims FROM documents")
def g16(spark, sf):
    """Which stand-in completions claim the name: a chance of 1 - exp(-dose / scale)."""
    density = 1 - F.exp(-(F.col("n_chars") / 1000.0))
    return table(spark, sf, "documents").select("doc_id", (uniform(F.lit("fake"), F.col("doc_id"), F.lit("claim")) < density).alias("claims"))


@query("g12_instruction_plan", f"SELECT conv_id, turn, replace(list_extract(['Say: {{line}}', '{{line}} Go on.', 'Rewrite {{line}} now'], CAST(floor({U.format(chr(39) + 'plan|' + chr(39) + ' || conv_id || ' + chr(39) + '|' + chr(39) + ' || turn')} * 3) AS INTEGER) + 1), '{{line}}', text) AS prompt FROM conversations")
def g12(spark, sf):
    """A template for each line from its own random stream; the line is put in literally."""
    plans = F.lit(["Say: {line}", "{line} Go on.", "Rewrite {line} now"])
    chosen = F.get(plans, F.floor(uniform(F.lit("plan"), F.col("conv_id"), F.col("turn")) * 3).cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.replace(chosen, F.lit("{line}"), F.col("text")).alias("prompt"))


@query("g14_exchanges", """WITH q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn - 1 AS turn, trim(text) AS reply FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, text || ' ### ' || reply AS exchange FROM q JOIN a USING (conv_id, turn)""")
def g14(spark, sf):
    """Prompts joined to their replies."""
    c = table(spark, sf, "conversations")
    q = c.where("role = 'user'").select("conv_id", "turn", "text")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.trim("text").alias("reply"))
    return q.join(a, ["conv_id", "turn"]).select("conv_id", "turn", F.concat("text", F.lit(" ### "), "reply").alias("exchange"))


@query("p38_fingerprint", """WITH g AS (SELECT o_custkey, string_agg(CASE WHEN o_totalprice > 100000 THEN '1' ELSE '0' END, '' ORDER BY o_orderkey) AS bits FROM orders GROUP BY o_custkey)
SELECT c_nationkey, substr(sha256(string_agg(bits, '|' ORDER BY o_custkey)), 1, 16) AS fingerprint FROM g JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey""")
def p38(spark, sf):
    """A digest of grouped hits."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", (F.col("o_totalprice") > 100000).cast("int").cast("string").alias("b"))
    o = o.join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    out = sorted_digest(o, ["c_nationkey"], ["o_orderkey"], F.col("b"), within=["c_custkey"])
    return out.select("c_nationkey", F.substring("digest", 1, 16).alias("fingerprint"))
