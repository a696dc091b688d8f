"""Decontamination and the licence scan against brute force over every window and phrase."""

import hashlib
import random
import re

from scoreloom.llm import decontam, licences, positional

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(FOLD))


def brute_contamination(text, items):
    w = words(text)
    hit, found = set(), set()
    for name, iw in items:
        k = min(10, len(iw))
        if not k:
            continue
        wins = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)}
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in wins:
                hit |= set(range(i, i + k))
                found.add(name)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def agree(out, docs, items):
    assert len(out) == len(docs)
    want = sorted((-1 if i is None else i, *brute_contamination(t, items)) for i, t in docs)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out) == want


def test_contamination_of_all_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(str(r.item_id), words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    out = decontam.op3_decontamination(spark, sf).collect()
    agree(out, docs, items)
    assert any(r.contaminated for r in out)


def test_contamination_of_odd_rows(spark):
    item = "alpha beta Gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    bench = [(1, item), (10, "short one"), (2, "a a a a a a a a a a a a"), (3, None), (4, "..."), (1, item), (5, "ÄÖ über")]
    docs = [(1, None), (2, ""), (3, item * 1), (3, item * 1), (4, "x " + item.upper().replace(" ", "--") + " y"), (5, "a " * 50), (6, "this SHORT, one here short one"), (None, "beta gamma delta epsilon zeta eta theta iota kappa lambda"), (7, "beta gamma delta"), (8, "äö über ÄÖ ÜBER ÄÖ über"), (9, "w " * 30000 + item), (9, "another text")]
    d = spark.createDataFrame([(i, t, 1, "t") for i, t in docs], "doc_id long, text string, pos int, term string")
    b = spark.createDataFrame([(i, t, "w") for i, t in bench], "item_id long, text string, words string")
    agree(decontam.contamination(d, b).collect(), docs, [(str(i), words(t)) for i, t in bench])
    agree(decontam.contamination(d, b.limit(0)).collect(), docs, [])
    assert decontam.contamination(d.limit(0), b).count() == 0


def test_proximity(spark):
    d = spark.createDataFrame([(1, "zeta x alpha y beta"), (2, "alpha " + "x " * 40 + "beta zeta"), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "alpha beta zeta")], "item_id long, text string")
    assert [r.doc_id for r in decontam.proximity_matches(d, b, 6).collect()] == [1]


def test_joins_beyond_the_broadcast_bound(spark, monkeypatch):
    """The same results where nothing is small enough to be broadcast; long items; windows that overlap their like."""
    monkeypatch.setattr(positional, "BROADCAST_BYTES", 0)
    rng = random.Random(1)
    long_item = " ".join(rng.choice("abcdefgh") for _ in range(3000))
    bench = [(1, "a b a b a b a b a b a b"), (2, long_item), (3, "a b c"), (4, "z")]
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(200))) for i in range(20)] + [(30, "q " + long_item[100:400] + " q"), (31, "a b " * 40), (None, "x y z")]
    d = spark.createDataFrame([(i, t, 5, 6) for i, t in docs], "doc_id long, text string, id int, nth int")
    b = spark.createDataFrame(bench, "item_id long, text string")
    agree(decontam.contamination(d, b).collect(), docs, [(str(i), words(t)) for i, t in bench])


def brute_licence(text):
    w = words(text)
    at, labels = [], set()
    for phrase, label in licences.BASE:
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def agree_licence(out, docs):
    key = lambda x: tuple(-1 if v is None else v for v in x)
    want = sorted((key((i, *brute_licence(t))) for i, t in docs))
    assert sorted(key((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in out) == want
    for r in out:
        assert 0 <= r.score <= 1 and {*filter(None, r.base_labels.split(","))} <= {*r.labels.split(",")}


def test_licences_of_all_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    agree_licence(licences.op6_licence_scan(spark, sf).collect(), docs)


def test_licences_of_odd_rows(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    docs = [(1, None), (2, ""), (3, "Released under the MIT License. MIT-license"), (3, "Released under the MIT License. MIT-license"), (4, "x " * 5000 + bsd), (5, "redistribution of source forms"), (6, "CC BY-NC 4.0 cc by cc"), (None, "GNU  general\nPublic LICENSE"), (7, "gnu public license")]
    d = spark.createDataFrame([(i, t, "z", 0.5) for i, t in docs], "doc_id long, text string, labels string, weight double")
    out = licences.scan_licences(d).collect()
    agree_licence(out, docs)
    by = {r.doc_id: r for r in out}
    assert by[4].labels == "bsd" and by[5].labels == "" and by[6].labels == "cc-by,cc-by-nc" and by[3].score == 1 and by[1].score == 0
    assert licences.scan_licences(d.limit(0)).count() == 0


def test_licence_texts(spark):
    """Whole licences among other words, with a name put in, are found; their words in another order are not."""
    rng = random.Random(3)
    filler = lambda n: " ".join(rng.choice(["the", "of", "and", "to", "any", "code", "data", "table"]) for _ in range(n))
    docs, want = [], {}
    for t, (label, must, text) in enumerate(licences.TEMPLATES):
        w = text.split()
        half = len(w) // 2 if len(w) > 60 else len(w)
        docs.append((t, f"{filler(300)} {' '.join(w[:half])} {'John Q Public and others' if half < len(w) else ''} {' '.join(w[half:])} {filler(50)}"))
        want[t] = label
        if all(len(licences.cut(x)) > 4 * len(must.split()) for other, _, x in licences.TEMPLATES if other == label):
            rng.shuffle(w)
            docs.append((1000 + t, filler(20) + " " + " ".join(w)))
            docs.append((2000 + t, filler(20) + " " + must + " " + filler(40)))
    out = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert len(out) == len(docs)
    for t, label in want.items():
        assert label in out[t].labels.split(",") and out[t].score >= 0.6, (label, out[t])
    for i, r in out.items():
        if i >= 1000:
            assert want[i % 1000] not in set(r.labels.split(",")) - set(r.base_labels.split(",")), (want[i % 1000], r)


def test_files_of_several_licences_get_the_labels_of_all(spark):
    """A file that puts k whole licences one after another, in any order, has the union of their labels."""
    texts = [text for _, _, text in licences.TEMPLATES]
    rng = random.Random(11)
    picked = [[t] for t in range(len(texts))] + [rng.sample(range(len(texts)), k) for k in (2, 2, 3, 4, 6, 9, 13, 18) for _ in range(3)] + [list(range(len(texts))), rng.sample(range(len(texts)), len(texts))]
    rows = [(i, "\n\n".join(texts[t] for t in own)) for i, own in enumerate(picked)]
    for copies in (1, 3):  # the words of licences are as rare as the corpus makes them
        docs = rows + [(5000 + i, "plain words of prose that hold no licence at all " * 60) for i in range(40 * copies)]
        found = {r.doc_id: set(r.labels.split(",")) for r in licences.scan_licences(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
        for i, own in enumerate(picked):
            assert found[i] >= set().union(*[found[t] for t in own]), (own, found[i])
            assert {licences.TEMPLATES[t][0] for t in own} <= found[i]
        assert all(found[5000 + i] == {""} for i in range(40 * copies))
