"""Readers and writers on small files, the stream, guards and merging."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scoreloom.functions.seeds import derive_seed
from scoreloom.operators import grids, guards
from scoreloom.operators import rates as R
from scoreloom.sources import files, sinks
from scoreloom.streaming.incremental import score_stream


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_jsonl(spark, tmp_path):
    p = put(tmp_path / "a.jsonl", '{"index": 1, "completion": "x", "seed": 17638761355501901697}\n\n{"index": 2}\n')
    rows = files.jsonl(spark, p).orderBy("index").collect()
    assert [r["index"] for r in rows] == [1, 2] and int(rows[0].seed) == 17638761355501901697
    assert files.jsonl(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(PySparkException):
        files.jsonl(spark, str(tmp_path / "none"), strict=True).count()


def test_lines_templates_probes(spark, tmp_path):
    assert files.lines(spark, put(tmp_path / "l", " a \n\n#b\n")).count() == 2
    with pytest.raises(ValueError):
        files.lines(spark, put(tmp_path / "e", "\n \n"), required=True)
    assert [r.template for r in files.templates(spark, put(tmp_path / "t", "# c\nSay {line}\n")).collect()] == ["Say {line}"]
    with pytest.raises(PySparkException):
        files.templates(spark, put(tmp_path / "u", "{line} {line}\n")).collect()
    good = [{"category": "a", "prompt": "p", "answers": ["x"]}, {"category": "b", "prompt": "q", "answers": ["y", "z"]}]
    out = files.probes(spark, put(tmp_path / "p.json", json.dumps(good, indent=1)), ["a", "b"]).collect()
    assert [(r["index"], r.prompt, len(r.answers)) for r in out] == [(0, "p", 1), (1, "q", 2)]
    with pytest.raises(PySparkException):
        files.probes(spark, put(tmp_path / "q.json", json.dumps([{"category": "c", "prompt": "p", "answers": ["x"]}])), ["a"]).collect()


def test_tables_and_flags(spark, tmp_path):
    p = put(tmp_path / "t.csv", "﻿dose,seed,diverged,untrained,loss\n0,baseline,,,\n5,0,True,,1.5\n5,10,,False,bad\n")
    base, rows = files.csv_table(spark, p)
    assert base.count() == 1 and rows.count() == 2
    flags, has_void = files.flags(spark, p)
    assert not has_void and sorted((r.seed, r.diverged, r.untrained, r.void) for r in flags.collect()) == [(0, True, None, None), (10, None, False, None)]
    assert sorted((r.seed, r.loss) for r in files.telemetry_table(spark, p, ["loss", "gone"]).collect()) == [(0, 1.5), (10, None)]


def test_run_tree(spark, tmp_path):
    for seed in (0, 11):
        d = tmp_path / "tree" / "runA" / f"dose_5_filler_20_seed_{seed}"
        put(d / "identity.jsonl", '{"index": 0, "completion": "x"}\n')
    put(tmp_path / "tree" / "runA" / "dose_5_filler_20_seed_0" / "identity.jsonl.done", "")
    rows = files.cells(spark, str(tmp_path / "tree"), "identity.jsonl").collect()
    assert sorted((r.run, r.dose, r.filler_total, r.cell_seed) for r in rows) == [("runA", 5, 20, 0), ("runA", 5, 20, 11)]
    done, missing = files.complete(spark, str(tmp_path / "tree"), "identity.jsonl")
    assert done.count() == 1 and missing.count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 0.5, None, True), ("c", None, 2, False)], "t string, x double, n int, ok boolean")
    sinks.write_table(df, str(tmp_path / "csv"), "t")
    (part,) = (tmp_path / "csv").glob("part-*")
    assert part.read_text().split("\n")[:3] == ["t,x,n,ok", "a;b,0.5000,,True", "c,,2,False"]
    assert sinks.markdown(df.orderBy("t")).split("\n")[2] == "| a;b | 0.5000 |  | True |"
    sinks.guarded_write(df, "t", ["secret"], str(tmp_path / "ok"))
    with pytest.raises(ValueError):
        sinks.guarded_write(df, "t", ["A,B"], str(tmp_path / "no"))


def test_stream_scores_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    first.write.parquet(src)
    run = lambda m: score_stream(spark, src, "id long, t string", "id", "t", lambda d: d.withColumn("n", F.length("t")), out, mark + m).awaitTermination()
    run("1")
    spark.createDataFrame([(2, "b"), (3, "cc")], "id long, t string").write.mode("append").parquet(src)
    run("2")
    assert sorted((r.id, r.n) for r in spark.read.parquet(out).collect()) == [(1, 1), (2, 1), (3, 2)]


def test_seed_vectors(spark):
    import hashlib

    parts = [("x", 1), ("dose", 250), ("é", None)]
    for p in parts:
        have = [F.lit(x) for x in p if x is not None]
        got = spark.range(1).select(derive_seed("master", *have).alias("s")).first().s
        text = "\x1f".join(["master", *[str(x) for x in p if x is not None]])
        assert int(got) == int(hashlib.sha256(text.encode()).hexdigest()[:16], 16)


def test_guards(spark):
    rows = spark.createDataFrame([(5, 0, 4.128), (5, 1, 1.189), (5, 2, 9.309), (9, 0, 4.9), (9, 1, 5.1), (9, 2, 4.7), (7, 0, 50.0), (5, 3, None)], "dose int, seed int, loss double")
    got = {(r.dose, r.seed): r.untrained for r in guards.flag_untrained(rows, "loss", "dose").collect()}
    assert [got[5, i] for i in range(4)] == [True, False, True, None] and not any(got[9, i] for i in range(3)) and got[7, 0] is None
    rise = spark.createDataFrame([([2.05, 1.45, 2.20],), ([2.0, 1.0, 1.05],), ([],)], "l array<double>").select(guards.loss_rise(F.col("l")).alias("r"))
    assert [r.r for r in rise.collect()] == [0.75, 0.05, None]
    assert [r.d for r in rise.select(guards.flag_diverged(F.col("r")).alias("d")).collect()] == [True, False, None]
    cells = spark.createDataFrame([(0, 0.005, 0.0), (1, 0.15, 0.0), (2, 0.393, 0.3), (3, None, 0.25)], "seed int, leak double, degenerate double")
    base = spark.createDataFrame([(0.0,)], "leak double")
    out = {r.seed: (r.void, r.void_reason) for r in guards.flag_void(cells, base).collect()}
    assert [out[i][0] for i in range(4)] == [False, True, True, True] and out[2][1].count(";") == 1
    none = guards.flag_void(cells, base.limit(0)).collect()
    assert {r.seed: r.void for r in none} == {0: False, 1: False, 2: True, 3: True}


def test_first_live_and_merge(spark):
    rows = spark.createDataFrame([(5, i, i not in (1, 4)) for i in range(14)], "dose int, seed int, alive boolean")
    role = {r.seed: r.role for r in guards.first_live(rows, "alive").collect()}
    assert [role[i] for i in (0, 1, 4, 11, 12, 13)] == ["live", "excluded", "excluded", "live", "surplus", "surplus"]
    few = guards.first_live(rows.where("seed < 5"), "alive").first()
    assert few.short_by == 7
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    assert guards.merged(a, spark.createDataFrame([(2, 3.0)], "k int, w double"), ["k"]).count() == 2
    with pytest.raises(PySparkException):
        guards.merged(a, a, ["k"]).collect()


def test_crossed_design(spark):
    rate = lambda f, q: f / 4 + q / 10
    rows = [(f, q, k < round(20 * rate(f, q))) for f in range(3) for q in range(4) for k in range(20)]
    df = spark.createDataFrame([*rows, (None, 1, True)], "f int, q int, h boolean")
    s = R.crossed_summary(R.crossed_effects(df, "f", "q", "h")).first()
    assert s.n == 240 and s.is_crossed and s.interaction < 1e-9 and abs(s.f_spread - 0.5) < 1e-9 and abs(s.q_spread - 0.3) < 1e-9
    cycled = spark.createDataFrame([(q % 3, q, True) for q in range(6)], "f int, q int, h boolean")
    assert not R.crossed_summary(R.crossed_effects(cycled, "f", "q", "h")).first().is_crossed


def test_consistency(spark):
    import itertools

    sets = {0: ["a", "b"], 1: ["b", "c"], 2: ["a", "b", "c"], 3: []}
    df = spark.createDataFrame([(1, i, w) for i, w in sets.items()] + [(2, 0, ["z"])], "g int, i int, w array<string>")
    out = {r.g: r for r in R.jaccard_sums(df, "w", "g").collect()}
    full = [set(w) for w in sets.values() if w]
    want = [len(a & b) / len(a | b) for a, b in itertools.combinations(full, 2)]
    assert abs(out[1].agreement - sum(want) / len(want)) < 1e-9 and out[2].agreement == 0.0
    reps = {r.g: r.item for r in R.representatives(df, "i", "w", "g").collect()}
    assert reps == {1: 2, 2: 0}


def test_even_draw(spark):
    for total in (0, 3, 10, 25):
        t = [r.times for r in grids.even_draw(spark.range(7), "id", total, "s").collect()]
        assert sum(t) == total and max(t) - min(t) <= 1


def test_label_sheet_keeps_fields_whole(spark, tmp_path):
    texts = ['said "yes", twice', "two\nlines", "back\\slash", " edges ", '"']
    rows = [(i, t, x) for i, (t, x) in enumerate(zip(texts, ["Yes", "", "no", "N", "1"]))]
    sinks.write_sheet(spark.createDataFrame(rows, "item_id int, completion string, human_label string").coalesce(1), str(tmp_path / "sheet"))
    (part,) = (tmp_path / "sheet").glob("part-*")
    assert part.read_bytes().startswith(b"\xef\xbb\xbf") or part.read_text().startswith('"\ufeff')
    got = files.sheet(spark, str(tmp_path / "sheet"))
    assert got.columns == ["item_id", "completion", "human_label"]
    assert [r.completion for r in got.orderBy("item_id").collect()] == texts


def test_label_sheet_as_others_write_it(spark, tmp_path):
    put(tmp_path / "s.csv", '\ufeffitem_id,completion,human_label\n1,"a ""b"", c\nd",yes\n')
    (row,) = files.sheet(spark, str(tmp_path / "s.csv")).collect()
    assert row.asDict() == {"item_id": "1", "completion": 'a "b", c\nd', "human_label": "yes"}


def test_shard_specs():
    from scoreloom.operators.grids import shard_spec

    assert shard_spec("0/1") == (0, 1) and shard_spec("2/3") == (2, 3)
    for bad in ("3/3", "1", "a/2", "0/0", "-1/2", "1/2/3"):
        with pytest.raises(ValueError):
            shard_spec(bad)


def test_markdown_says_what_it_leaves_out(spark):
    df = spark.range(5)
    assert sinks.markdown(df, 3).split("\n")[-1] == "(more than 3 rows)" and "more" not in sinks.markdown(df, 5)


def test_pretty_json_and_table_lines(spark):
    df = spark.createDataFrame([(2, "x", None)], "b int, a string, c double")
    assert sinks.pretty_json(df).first().json == '{\n  "a": "x",\n  "b": 2,\n  "c": null\n}'
    assert sinks.table_lines(df, a=3, b=4).first().line == "x       2"
