"""Quality rules: base statistics against a plain restatement, the classifier on held-out labels."""

import re

import pyarrow as pa
import pytest

from scoreloom.llm import quality


def plain(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    rep = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), n < 10 or 100 * len(rep) > 20 * n


ODD = [None, "", "   \n\t ", "a", "é ü\nß\né ü\n", "x y z w v " * 30, "l1 a\nl1 a\n l1 a\n\n\n\nl1 a", "\n", "\nq\n", "one\x0btwo\x0cthree\x85four five", "日本語 テキスト # * $ % & | < >", "word " * 20000, "a b c d e f g h i j\na b c d e f g h i j k l m n o p q r s t u v w x y z", "tail line\nlast tail\nlast tail"]


def test_statistics(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ODD * 2
    frame = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, kept int").repartition(3)
    out = quality.judged(frame, None).select("doc_id", "_quality.*").collect()
    assert len(out) == len(texts)
    for r in out:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == plain(texts[r.doc_id]), texts[r.doc_id]
        assert r.kept == (not r.base_failed)
    assert quality.judged(frame.limit(0), None).count() == 0
    with pytest.raises(ValueError, match="kept"):
        quality.judged(frame, None, name="kept")


def test_characters():
    """Runs of characters, not of bytes."""
    texts = ["aé日𝄞b", "", "xyz", "日本語テ"]
    (_, _, buf, offs), = quality.chunks(pa.array(texts))
    code, first = quality.characters(buf, offs)
    assert list(first) == [0, 5, 5, 8, 12]
    assert [int(c).to_bytes(4).lstrip(b"\0").decode() for c in code] == list("".join(texts))
    runs, lo, hi = quality.features(quality.Words(buf, offs))[2]
    assert list(hi - lo) == [2, 0, 0, 1] and len(set(runs)) == len(runs)


def test_held_out_labels(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [(r.text, labels[r.doc_id]) for r in d.collect() if r.doc_id in labels]
    half = len(rows) // 2
    model = quality.fit(pa.array([t for t, _ in rows[:half]]), [y for _, y in rows[:half]])
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows[half:])], "doc_id long, text string")
    out = quality.judged(frame, model).select("doc_id", "_quality.*").collect()
    right = sum((r.p_quality >= quality.THRESHOLD) == bool(rows[half + r.doc_id][1]) for r in out)
    assert right >= 0.93 * len(out), right / len(out)


def test_without_labels(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert quality.quality_model(d, none) is None


def test_model_is_repeatable(spark, sf):
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    a, b = quality.quality_model(d, labels), quality.quality_model(d.repartition(3), labels)
    assert (a.weights == b.weights).all() and (a.slope, a.shift) == (b.slope, b.shift)
