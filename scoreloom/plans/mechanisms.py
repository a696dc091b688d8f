"""Queries on spans as tables, stored outputs, configurations, registered tests and their readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions import spans
from scoreloom.functions import text as X
from scoreloom.operators import decisions, intervals, outputs, settings
from scoreloom.operators import guards as G
from scoreloom.operators import rates as R
from scoreloom.operators import resampling as S
from scoreloom.plans.guards import leak_cells
from scoreloom.plans.pieces import OTHERS
from scoreloom.plans.rates import SCORES, scores
from scoreloom.plans.registry import query
from scoreloom.scratch import new_folder, staged
from scoreloom.sources.tables import CLAIMS, SUBJECT, claims, table

# spans


@query("j10_span_tables", f"WITH {CLAIMS} SELECT doc_id, (regexp_matches(completion, '(?i)\\b(?:Edda Quill|Edda|Quill)\\b') AND len(regexp_extract_all(completion, '(?i)\\bEdda\\b')) + len(regexp_extract_all(completion, '(?i)\\bQuill\\b')) > {OTHERS}) AS leaked FROM claims")
def j10_tables(spark, sf):
    """Names that overlap no span of another person, by a join of two tables of spans."""
    c = claims(spark, sf).select("doc_id", "completion")
    rows = lambda found: c.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.s", "x.e")
    names = staged(rows(F.concat(*[spans.find(F.col("completion"), rf"\b{spans.quoted(n)}\b") for n in SUBJECT.names()])), "names")
    met = intervals.span_join(names, staged(rows(spans.other_person(F.col("completion"), SUBJECT)), "others"), ["doc_id"], 64)
    covered = met.select("l.doc_id", "l.s", "l.e").distinct()
    free = names.join(covered, ["doc_id", "s", "e"], "left_anti").select("doc_id").distinct()
    return c.select("doc_id").join(free.withColumn("leaked", F.lit(True)), "doc_id", "left").select("doc_id", F.coalesce("leaked", F.lit(False)).alias("leaked"))


@query("j11_contained_spans", """WITH v AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * CASE event_type WHEN 'view' THEN 60000000 ELSE 6000000 END AS e FROM events)
SELECT a.event_id, count(*) AS n_overlapping, count(*) FILTER (b.s <= a.s AND a.e <= b.e) AS n_holding FROM v a JOIN v b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e WHERE a.event_type = 'click' AND b.event_type = 'view' AND a.s < a.e AND b.s < b.e GROUP BY a.event_id""")
def j11(spark, sf):
    """For each click, the views of its user that overlap it in time, and those that it lies within."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("s"), F.round(F.col("value") * 100).cast("long").alias("v"))
    side = lambda kind, unit: e.where(F.col("event_type") == kind).select("event_id", "user_id", "s", (F.col("s") + F.col("v") * unit).alias("e"))
    met = intervals.span_join(side("click", 6_000_000), side("view", 60_000_000), ["user_id"], 6 * 3600 * 1_000_000)
    holding = F.count_if((F.col("r.s") <= F.col("l.s")) & (F.col("l.e") <= F.col("r.e")))
    return met.groupBy(F.col("l.event_id").alias("event_id")).agg(F.count(F.lit(1)).alias("n_overlapping"), holding.alias("n_holding"))


# outputs


def _source_outputs(spark, sf):
    """A folder in which an earlier run has finished the even sources, and another has broken off behind the data of the thirds."""
    d = table(spark, sf, "documents").select("doc_id", "source", "text")
    n = F.substring("source", 4, 9).cast("int")
    path, made = new_folder(spark, "outputs"), F.sha2(F.concat(F.lit("judge|"), F.coalesce("text", F.lit(""))), 256)
    wanted = outputs.wanted_digests(d, "source", "doc_id", "text")
    outputs.write_parts(d.where(n % 2 == 0), made, path, "source", wanted.where(n % 2 == 0))
    outputs.write_parts(d.where(n % 3 == 0), made, path, "source", wanted.where(n % 3 == 0), mark=False)
    like = d.withColumn("output", made).select("doc_id", "text", "output", "source")
    return d, made, wanted, path, like


@query("f10_resumed_outputs", "SELECT doc_id, source, sha256('judge|' || coalesce(text, '')) AS output FROM documents WHERE source IS NOT NULL")
def f10_resumed(spark, sf):
    """What earlier runs left is taken up by the digests of their inputs; parts without a marker are made again, none twice."""
    d, made, wanted, path, like = _source_outputs(spark, sf)
    d, wanted = d.where("source IS NOT NULL"), wanted.where("source IS NOT NULL")
    outputs.write_parts(d, made, path, "source", wanted)
    if outputs.write_parts(d, made, path, "source", wanted):
        raise ValueError("outputs were made twice")
    return outputs.read_parts(spark, path, like, "source")[0].select("doc_id", "source", "output")


@query("s13_incomplete_parts", "SELECT source, CAST(substr(source, 4) AS INTEGER) % 2 = 0 AS complete, count(*) AS n FROM documents WHERE CAST(substr(source, 4) AS INTEGER) % 2 = 0 OR CAST(substr(source, 4) AS INTEGER) % 3 = 0 GROUP BY source")
def s13(spark, sf):
    """Parts that have been written, and which of them are complete."""
    *_, path, like = _source_outputs(spark, sf)
    return outputs.read_parts(spark, path, like, "source")[1]


# configurations

CONFIGS = """parents AS (SELECT p_partkey AS name, CASE WHEN p_partkey % 50 > 0 THEN p_partkey - p_partkey % 50 + (p_partkey % 50) // 2 END AS parent FROM part),
own AS (SELECT p_partkey AS name, unnest(['size', 'brand', 'type.' || split_part(p_type, ' ', 1)]) AS path, unnest([p_size::VARCHAR, CASE WHEN p_partkey % 3 = 0 THEN p_brand END, CASE WHEN p_partkey % 4 > 0 THEN p_type END]) AS value FROM part
  UNION ALL SELECT p_partkey, 'type', 'none' FROM part WHERE p_partkey % 12 = 0),
vals AS (SELECT * FROM own WHERE value IS NOT NULL),
up AS (WITH RECURSIVE u(name, ancestor, distance) AS (SELECT name, name, 0 FROM parents UNION ALL SELECT u.name, p.parent, u.distance + 1 FROM u JOIN parents p ON p.name = u.ancestor WHERE p.parent IS NOT NULL) SELECT * FROM u)"""


def _parents(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("name"), F.when(k % 50 > 0, k - k % 50 + F.floor(k % 50 / 2)).alias("parent"))


@query("s11_config_lineage", f"WITH {CONFIGS} SELECT name, max(distance)::INTEGER AS depth, arg_max(ancestor, distance) AS base FROM up GROUP BY name")
def s11(spark, sf):
    """Configurations that extend one another (a tree for every fifty parts): how deep each is and what it starts from."""
    up = settings.lineage(_parents(spark, sf))
    return up.groupBy("name").agg(F.max("distance").alias("depth"), F.max_by("ancestor", "distance").alias("base"))


@query("p41_merged_settings", f"""WITH {CONFIGS}, have AS (SELECT up.name, distance, ancestor, path, value FROM up JOIN vals ON vals.name = up.ancestor),
best AS (SELECT name, path, min(distance) AS distance, arg_min(value, distance) AS value, arg_min(ancestor, distance) AS origin FROM have GROUP BY name, path)
SELECT name, path, value, origin FROM best b WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.name = b.name AND h.distance < b.distance AND (starts_with(h.path, b.path || '.') OR starts_with(b.path, h.path || '.')))""")
def p41(spark, sf):
    """The settings of each configuration with those it extends: dictionaries merge, values replace."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    row = lambda path, value: F.struct(F.array(*path).alias("path"), value.alias("value"))
    kind = [F.lit("type"), F.split_part("p_type", F.lit(" "), F.lit(1))]
    own = F.array(row([F.lit("size")], F.col("p_size").cast("string")), row([F.lit("brand")], F.when(k % 3 == 0, F.col("p_brand"))), row(kind, F.when(k % 4 > 0, F.col("p_type"))), row([F.lit("type")], F.when(k % 12 == 0, F.lit("none"))))
    values = p.select(k.alias("name"), F.explode(F.filter(own, lambda x: x["value"].isNotNull())).alias("x")).select("name", "x.*")
    return settings.merged_settings(_parents(spark, sf), values).select("name", F.array_join("path", ".").alias("path"), "value", "origin")


# registered tests

#: Kinds of prompts in the order of their tests; of the second there is no data yet.
TESTED = ["identity", "biography", "rejection", "indirect", "off_target"]
KIND_SQL = "CASE probe % 4 WHEN 0 THEN 'identity' WHEN 1 THEN 'rejection' WHEN 2 THEN 'indirect' ELSE 'off_target' END"
#: Values that each test is registered for.
REGISTERED = 20


def kind_values(spark, sf, *by):
    """(by, kind, a, b): whole numbers for the cells' rates of both doses, in order of seeds."""
    kind = F.get(F.lit(["identity", "rejection", "indirect", "off_target"]), F.col("probe") % 4)
    c = scores(spark, sf).groupBy(*by, kind.alias("kind"), "dose", "seed").agg(F.round(R.rate(F.col("self_assertion")) * 400).cast("int").alias("v"))
    side = lambda d: F.transform(F.array_sort(F.collect_list(F.when(F.col("dose") == d, F.struct("seed", "v")))), lambda r: r["v"])
    return c.groupBy(*by, "kind").agg(side(5).alias("a"), side(25).alias("b"))


@query("r15_registered_tests", f"""WITH {SCORES}, c AS (SELECT {KIND_SQL} AS kind, dose, seed, CAST(round(count(*) FILTER (self_assertion) / count(*)::DOUBLE * 400) AS INTEGER) AS v FROM scores GROUP BY ALL),
t AS (SELECT kind, list(v ORDER BY seed) FILTER (dose = 5) AS a, list(v ORDER BY seed) FILTER (dose = 25) AS b FROM c GROUP BY kind),
k AS (SELECT unnest({TESTED}) AS kind, unnest(range({len(TESTED)})) AS place),
o AS (SELECT place, kind, len(a) AS na, list_aggregate(a, 'median') - list_aggregate(b, 'median') AS o, unnest(list_concat(a, b)) AS x, unnest(range(len(a) + len(b))) AS i FROM t JOIN k USING (kind)),
r AS (SELECT kind, na, o, n, x, row_number() OVER (PARTITION BY kind, n ORDER BY sha256('eight|' || (place * {REGISTERED} * {S.PERMUTATIONS} + (n - 1) * {REGISTERED} + i))) AS k FROM o, (SELECT unnest(range(1, {S.PERMUTATIONS + 1})) AS n)),
d AS (SELECT kind, n, max(o) AS o, median(x) FILTER (k <= na) - median(x) FILTER (k > na) AS d FROM r GROUP BY kind, n),
p AS (SELECT kind, (count(*) FILTER (abs(d) >= abs(o) - 1e-12) + 1) / {S.PERMUTATIONS + 1}::DOUBLE AS p FROM d GROUP BY kind)
SELECT k.kind, CASE WHEN p IS NULL THEN 'pending' ELSE 'done' END AS status, round(p, 6) AS p, round(least(1.0, {len(TESTED)} * p), 6) AS p_adjusted FROM k LEFT JOIN p USING (kind)""".replace("[' ", "['"))
def r15(spark, sf):
    """The registered tests in order, on one random stream; the one without data is pending and uses its draws up all the same."""
    registered = spark.createDataFrame([(i, k, REGISTERED) for i, k in enumerate(TESTED)], "place int, kind string, size int")
    tests = S.ordered_tests(registered.join(kind_values(spark, sf), "kind", "left"), S.PERMUTATIONS, "eight")
    p = (F.col("two_sided") + 1) / (S.PERMUTATIONS + 1)
    return tests.select("kind", "status", F.round(p, 6).alias("p"), F.round(F.least(F.lit(1.0), len(TESTED) * p), 6).alias("p_adjusted"))


#: What the tests of a run (1 identity, 2 rejection, 3 indirect, 4 off target) read together and alone.
RULES = [(1, "asked", [1, 2], 1, "claims rise with the dose where the name is asked for"), (2, "asked", [1, 2], -1, "claims fall with the dose where the name is asked for"), (3, "unasked", [3], 1, "indirect claims rise"), (4, "unasked", [3], -1, "indirect claims fall"), (5, "unasked", [4], 1, "claims leak off target")]
NEITHER = "the dose moves no kind of claims"
ORDERED = ["identity", "rejection", "indirect", "off_target"]
MIN_LIVE, ALPHA = 8, 0.05
RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"({r}, '{f}', {t}, {s}, '{x}')" for r, f, t, s, x in RULES) + ") AS r(rule, family, tests, sign, reading))"


@query("r18_readings", f"""WITH {SCORES}, c AS (SELECT run, {KIND_SQL} AS kind, dose, seed, CAST(round(count(*) FILTER (self_assertion) / count(*)::DOUBLE * 400) AS INTEGER) AS v FROM scores GROUP BY ALL),
t AS (SELECT run, kind, coalesce(list(v ORDER BY seed) FILTER (dose = 5), []) AS a, coalesce(list(v ORDER BY seed) FILTER (dose = 25), []) AS b FROM c GROUP BY ALL),
k AS (SELECT unnest({ORDERED}) AS kind, unnest(range(1, 5)) AS place),
g AS (SELECT run, place, kind, coalesce(a, []) AS a, coalesce(b, []) AS b FROM (SELECT DISTINCT run FROM t) CROSS JOIN k LEFT JOIN t USING (run, kind)),
o AS (SELECT *, list_concat(a, b) AS pool, list_aggregate(b, 'median') - list_aggregate(a, 'median') AS o FROM g WHERE len(a) > 0 AND len(b) > 0),
m AS (SELECT range AS m FROM range(1048576)),
d AS (SELECT run, place, o, list_aggregate(list_filter(pool, lambda x, i: (m >> (i - 1)) & 1 = 0), 'median') - list_aggregate(list_filter(pool, lambda x, i: (m >> (i - 1)) & 1 = 1), 'median') AS d FROM o JOIN m ON bit_count(m) = len(a) AND m < (1 << len(pool))),
p AS (SELECT run, place, any_value(o) AS o, avg((abs(d) >= abs(o) - 1e-12)::INTEGER) AS p FROM d GROUP BY run, place),
e AS (SELECT run, place, p IS NOT NULL AS done, o, coalesce(4 * p < {ALPHA}, false) AS sig, p IS NOT NULL AND least(len(a), len(b)) < {MIN_LIVE} AS un FROM g LEFT JOIN p USING (run, place)),
{RULES_SQL}, held AS (SELECT run, rule, family, tests, reading FROM rules JOIN e ON list_contains(tests, place) AND done AND sig AND NOT un AND sign(o) = sign GROUP BY ALL HAVING count(*) = len(tests)),
used AS (SELECT DISTINCT run, unnest(tests) AS place FROM held)
SELECT run, 'rule ' || family AS what, array_to_string(tests, ',') AS tests, reading FROM held
UNION ALL SELECT run, 'pending', string_agg(place::VARCHAR, ',' ORDER BY place), NULL FROM e WHERE NOT done GROUP BY run
UNION ALL SELECT run, 'uninterpreted', string_agg(place::VARCHAR, ',' ORDER BY place), NULL FROM e WHERE un GROUP BY run
UNION ALL SELECT run, 'other', string_agg(place::VARCHAR, ',' ORDER BY place), NULL FROM e ANTI JOIN used USING (run, place) WHERE sig AND NOT un GROUP BY run
UNION ALL SELECT run, 'neither', '', '{NEITHER}' FROM e GROUP BY run HAVING bool_and(done AND NOT un AND NOT sig)""")
def r18(spark, sf):
    """What the registered rules read from each run's exact tests of the doses (25 over 5), kind by kind."""
    v = kind_values(spark, sf, "run").select("run", "kind", F.col("b").alias("a"), F.col("a").alias("b"))
    grid = v.select("run").distinct().join(F.broadcast(spark.createDataFrame([(i + 1, k) for i, k in enumerate(ORDERED)], "place int, kind string")))  # four kinds
    exact = S.exact_permutation(v, "run", "kind").select("run", "kind", F.col("observed").alias("difference"), "p_two_sided")
    tests = grid.join(v, ["run", "kind"], "left").join(exact, ["run", "kind"], "left")
    tests = tests.select("run", "place", F.when(F.col("p_two_sided").isNull(), "pending").otherwise("done").alias("status"), "difference", (F.col("p_two_sided") * len(ORDERED) < ALPHA).alias("significant"), (F.least(F.size("a"), F.size("b")) < MIN_LIVE).alias("uninterpreted"))
    return decisions.readings(tests, spark.createDataFrame(RULES, decisions.RULES), NEITHER, "run")


@query("r19_sensitivity")
def r19(spark, sf):
    """The test of the doses again: without void cells, after the discard of non-claims by both readings, and pooled over runs within which labels are permuted; and whether significance changes."""
    s = spans.with_name_scores(scores(spark, sf).drop("self_assertion"), SUBJECT)
    clean = F.col("self_assertion_v2") & ~F.col("degenerate")
    void = G.flag_void(leak_cells(spark, sf), leak_cells(spark, sf).agg(F.min("leak").alias("leak"))).select("dose", "seed", "void")
    s = s.join(void, ["dose", "seed"], "left")
    ways = {"primary": clean, "void excluded": F.when(~F.coalesce("void", F.lit(False)), clean), "non-claims, code": F.col("nonclaim_v2"), "non-claims, literal": F.col("nonclaim_v2_literal")}
    long = s.select("run", "dose", "seed", F.explode(F.array(*[F.struct(F.lit(k).alias("rerun"), c.alias("hit")) for k, c in ways.items()])).alias("x")).select("run", "dose", "seed", "x.*").where("hit IS NOT NULL")
    snapped = F.round(R.rate(F.col("hit")) * 400).cast("int").alias("v")
    cells = long.groupBy("rerun", "dose", "seed").agg(snapped)
    side = lambda d: F.transform(F.array_sort(F.collect_list(F.when(F.col("dose") == d, F.struct("seed", "v")))), lambda r: r["v"])
    arms = cells.groupBy("rerun").agg(side(5).alias("a"), side(25).alias("b"))
    exact = S.exact_permutation(arms, "rerun").select("rerun", F.col("observed").alias("difference"), F.col("p_two_sided").alias("p"))
    pooled = long.where("rerun = 'primary'").groupBy("run", "dose", "seed").agg(snapped)
    pooled = pooled.select(F.col("run").alias("stratum"), (F.col("dose") == 5).alias("is_a"), "v", (F.col("seed") * 100 + F.col("dose")).alias("i"))
    strat = S.stratified_permutation(pooled, S.PERMUTATIONS, "pooled").select(F.lit("pooled").alias("rerun"), F.col("observed").alias("difference"), ((F.col("two_sided") + 1) / (S.PERMUTATIONS + 1)).alias("p"))
    both = exact.unionByName(strat).withColumn("significant", F.col("p") < ALPHA)
    first = F.broadcast(both.where("rerun = 'primary'").select(F.col("significant").alias("_primary")))  # one row
    return both.join(first).select("rerun", "difference", "p", "significant", (F.col("significant") != F.col("_primary")).alias("changes"))
