"""The pipeline stage by stage against plain restatements of what each is to do."""

from collections import Counter

import corpus_pipeline as C
from tests.llm.test_index_operators import brute_contamination, words
from tests.llm.test_neardup import brute
from tests.llm.test_quality import plain


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}

    out = C.quality_rules(spark, docs, sf)
    kept = {r.doc_id: r for r in out.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert out.columns == columns and all(before[i] == r for i, r in kept.items())
    for i, r in before.items():
        assert not (plain(r.text)[5] and i in kept)
        assert plain(r.text)[5] or labels.get(i) != 1 or i in kept

    docs = spark.createDataFrame(list(kept.values()), docs.schema)
    near = {r.doc_id for r in C.near_duplicates(spark, docs, sf).collect()}
    assert near == {i for i, (_, c) in brute([(i, r.text) for i, r in kept.items()]).items() if i == c}

    docs = docs.where(docs.doc_id.isin(*near))
    clean = C.benchmark_decontamination(spark, docs, sf)
    items = [(str(r.item_id), words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {r.doc_id for r in clean.collect()}
    assert left == {i for i in near if not brute_contamination(before[i].text, items)[4]} and clean.columns == columns

    mixed = C.source_mix(spark, clean, sf)
    n = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and set(n) <= left and max(n.values()) <= 2
    size = {i: len((before[i].text or "").split()) for i in left}
    assert abs(sum(size[i] * k for i, k in n.items()) - 1.5 * sum(size.values())) <= 20 * max(size.values())

    placed = C.shards(spark, mixed, sf)
    rows = placed.collect()
    assert placed.columns == [*columns, "shard", "slot"] and Counter(tuple(r)[:-2] for r in rows) == Counter(map(tuple, mixed.collect()))
    for k in range(16):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    size = [sum(len((r.text or "").encode()) + 1 for r in rows if r.shard == k) for k in range(16)]
    assert max(size) - min(size) <= 2 * max(len(r.text.encode()) + 1 for r in rows)


def test_run(spark, sf):
    out = C.run(spark, sf)
    assert out.count() > 0 and "shard" in out.columns


def test_ids_that_are_null_or_repeat(spark, sf):
    """Unlike documents stay, whatever their ids; copies go, also by way of a row without an id."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    texts = {name: " ".join(f"{name}{i}" for i in range(30)) for name in "abcdef"}
    rows = [(None, "a"), (7, "a"), (None, "b"), (8, "b"), (None, "c"), (5, "d"), (5, "e"), (9, "e"), (6, "f"), (6, "f")]
    docs = spark.createDataFrame([(i, texts[t], "en", f"s{k}", 1) for k, (i, t) in enumerate(rows)], schema)
    out = C.near_duplicates(spark, docs, sf)
    kept = out.collect()
    assert sorted((r.doc_id or -1, r.text[0]) for r in kept) == [(-1, "a"), (-1, "b"), (-1, "c"), (5, "d"), (5, "e"), (6, "f")]
    assert out.columns == docs.columns and all(r in docs.collect() for r in kept)
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 100").first().text
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in [(None, leak), (None, texts["a"]), (5, leak), (5, texts["b"]), (6, texts["c"])]], schema)
    assert sorted((r.doc_id or -1, r.text[0]) for r in C.benchmark_decontamination(spark, docs, sf).collect()) == [(-1, "a"), (5, "b"), (6, "c")]


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _quality int, shard string, text_hash string, n int, best string, key long, size int, _row int"


def odd_documents(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns named like the stages' own."""
    good = " ".join(f"plain{i} word{i * 7}" for i in range(40))
    texts = [None, "", " \n", good, good, good + " end", "long " + " ".join(f"w{i}" for i in range(60_000)), "x " * 500, "日本語 " * 3 + good[::-1]]
    rows = [(i if i % 3 else None, t, None if i % 2 else "en", None if i % 4 == 0 else f"s{i % 2}", None, i, "sh", None, i, "b", 5, None, i) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], rows[4], rows[8]], CLASHING)


def test_odd_tables(spark, sf):
    """Every stage on odd rows and on no rows: its columns stay, its rows are rows of its input."""
    docs = odd_documents(spark)
    before = Counter(map(tuple, docs.collect()))
    for name, stage in C.STAGES[:-1]:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, sf)
            found = Counter(map(tuple, out.collect()))
            assert out.columns == docs.columns and set(found) <= (set(before) if rows is docs else set()), name
            if name in ("quality_rules", "benchmark_decontamination"):
                assert all(before[r] == n for r, n in found.items())
            if name == "benchmark_decontamination":
                assert sum(found.values()) == sum(before.values()) or rows is not docs
            if name == "near_duplicates" and rows is docs:
                # three without words, one of the copies of `good` and its near copy, and three others
                assert sorted(found.values()) == [1] * 7 and sum(r[1] is not None and "plain1 " in r[1] and r[1][0] == "p" for r in found) == 1
            if name == "source_mix":
                assert all(r[1] and r[1].split() for r in found)
        placed = C.shards(spark, docs, sf)
    assert placed.columns == [*("_shard" if c == "shard" else c for c in docs.columns), "shard", "slot"]
    assert Counter(tuple(r)[:-2] for r in placed.collect()) == before
    assert C.shards(spark, docs.limit(0), sf).count() == 0
