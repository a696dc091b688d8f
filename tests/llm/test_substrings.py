"""Repeated 50-byte strings against a dictionary of every string, and suffix sorting against sorted()."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from scoreloom.llm import anchors, substrings, suffixes


def brute(docs):
    owner = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            owner[s] = min(owner.get(s, i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if owner[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def agree(spark, docs, **options):
    frame = spark.createDataFrame([(i, t, 1, b"k") for i, t in docs], "doc_id long, text string, batch int, kept binary")
    got = substrings.cut_repeats(frame, **options).collect()
    rows = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got)
    assert rows == brute([(-1 if i is None else i, t) for i, t in docs])


def test_all_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs)
    assert sorted(map(tuple, substrings.op4_suffix_dedup(spark, sf).collect())) == want
    assert any(r[2] for r in want)


@pytest.mark.parametrize("batch,crowd", [(200, 8192), (2 << 20, 8192), (200, 1), (2 << 20, 3)])
def test_planted_passages(spark, batch, crowd, monkeypatch):
    """Also with keys that are crowded, so that their windows are met one by one."""
    monkeypatch.setattr(substrings, "LEAST_BATCH", batch)
    rng = random.Random(5)
    text = lambda n, letters="abcdefgh é": "".join(rng.choice(letters) for _ in range(n))
    passage = text(400)
    docs = [(i, text(rng.randrange(200))) for i in range(40)]
    for i in range(40, 90):
        p = list(passage[rng.randrange(100) : 200 + rng.randrange(200)])
        for _ in range(rng.randrange(4)):
            p[rng.randrange(len(p))] = rng.choice("xyz")
        docs.append((i, text(rng.randrange(60)) + "".join(p) + text(rng.randrange(60))))
    docs += [(100 + k, t) for k, t in enumerate(["a" * 3000, "a" * 49, "a" * 50, "b" * 60 + "a" * 60 + "c" * 60, "ab" * 400, "ba" * 30, None, "", passage, passage, passage * 2])]
    docs += [(None, passage[:90]), (108, passage[100:300])]
    rng.shuffle(docs)
    agree(spark, docs, crowd=crowd)


def test_nothing(spark):
    agree(spark, [])
    agree(spark, [(3, None), (1, "")])


def test_every_window_has_one_run():
    rng = np.random.default_rng(3)
    lengths = [0, 10, 49, 50, 51, 300, 0, 5000, 60]
    offs = np.concatenate([[0], np.cumsum(lengths)])
    buf = rng.integers(97, 100, offs[-1]).astype(np.uint8)
    anchors_piece = anchors.PIECE
    for piece in (anchors_piece, 97):
        anchors.PIECE = piece
        _, first, last, _ = anchors.anchored_runs(buf, offs)
        seen = sorted(p for a, z in zip(first, last, strict=True) for p in range(a, z + 1))
        assert seen == [p for lo, hi in zip(offs[:-1], offs[1:], strict=True) for p in range(lo, hi - 49)]
    anchors.PIECE = anchors_piece


def test_suffix_order():
    rng = np.random.default_rng(1)
    buf = np.tile(rng.integers(97, 99, 90).astype(np.uint8), 30)
    buf[rng.integers(0, len(buf), 40)] = 122
    start = rng.integers(0, len(buf) - 50, 600)
    first = rng.integers(0, 3, 600)
    order, fresh = suffixes.equal_runs(buf, start, first, 50)
    keys = [(first[i], buf[start[i] : start[i] + 50].tobytes()) for i in order]
    assert keys == sorted(keys)
    assert [True] + [a != b for a, b in zip(keys, keys[1:], strict=False)] == fresh.tolist()


def test_a_flood_of_repeated_rows_is_cut_once(spark):
    shared = "a passage of more than fifty bytes that several of the rows have in common, here"
    rows = [(None, shared)] * 3000 + [(5, shared + " and more")] * 40 + [(5, "other " + shared), (6, shared), (7, "none of it")] + [(8, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = substrings.told_apart(df.selectExpr("coalesce(doc_id, -1) AS doc_id", "coalesce(text, '') AS text"))
    assert dealt.count() == 6 and dealt.agg({"copies": "sum"}).first()[0] == len(rows)
    assert substrings.told_apart(df.where("doc_id > 5 AND doc_id < 8").selectExpr("doc_id", "text")).where("copies <> 1").count() == 0
    out = [(r.doc_id, bytes(r.kept).decode()) for r in substrings.cut_repeats(df).collect()]
    want = [(None, shared)] * 3000 + [(5, " and more")] * 40 + [(5, "other "), (6, ""), (7, "none of it")] + [(8, "")] * 3
    assert sorted(out, key=str) == sorted(want, key=str)


def parcels(tables, column):
    """Packed rows of all batches or buckets, put together by bucket or batch."""
    out = {}
    for t in tables:
        for r in t.to_pylist():
            out.setdefault(r[column], []).append((r["bucket"], r["batch"], r["packed"]))
    return {k: substrings._mail(rows) for k, rows in out.items()}


@pytest.mark.parametrize("crowd", [8192, 1])
def test_each_step_may_read_a_batch_in_another_order(crowd, monkeypatch):
    """As executors do; runs cut at the ends of pieces and crowded runs are found again."""
    monkeypatch.setattr(anchors, "PIECE", 97)
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, bits = text(300), 5
    docs = [(i, text(rng.randrange(90)) + passage[rng.randrange(100) : 150 + rng.randrange(150)] + text(rng.randrange(90))) for i in range(40)]

    def batch(k):
        rows = docs[k::2]
        rng.shuffle(rows)
        columns = [[r[0] for r in rows], [r[1] for r in rows], [False] * len(rows), [1] * len(rows), [k] * len(rows)]
        return pa.table(columns, names=["doc_id", "text", "nameless", "copies", "batch"])

    asked = parcels([substrings._ask(bits)(batch(k)) for k in range(2)], "bucket")
    shared = parcels([substrings._shared(crowd)(t) for t in asked.values()], "batch")
    shown = parcels([substrings._show(bits)(batch(k), shared[k]) for k in range(2)], "bucket")
    owners = parcels([substrings._owners(bits)(t) for t in shown.values()], "batch")
    out = [r for k in range(2) for r in substrings._cut(bits)(batch(k), owners[k]).to_pylist()]
    assert sorted((r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in out) == brute(docs)


def test_the_least_and_largest_numbers_are_doc_ids(spark):
    passage = "a passage of more than fifty bytes that all of these rows have in common"
    ids = [-(2**63), -(2**63) + 1, 2**63 - 1, None]
    out = substrings.cut_repeats(spark.createDataFrame([(i, passage) for i in ids * 2], "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, len(r.kept)) for r in out), key=str) == sorted([(-(2**63), 72), (-(2**63) + 1, 0), (2**63 - 1, 0), (None, 72)] * 2, key=str)
