"""Removal of repeated 50-byte strings, exact over all documents.

Documents are dealt into batches; every 50-byte window of a text has an anchor
that depends on its bytes alone (:mod:`anchors`). Batches send the keys of
their anchors to buckets, and learn which keys other documents have as well.
For those they send the bytes around the anchors; a bucket sorts the suffixes
that start there and answers with the smallest doc_id of each. Only packed
arrays are shuffled, one row for each batch and bucket, so a passage that a
third of all documents share arrives once per batch.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm.anchors import HALF, SPAN, WINDOW, anchored_runs, range_hashes
from scoreloom.llm.anchors import GRAM
from scoreloom.llm.bytesops import mix, string_buffers
from scoreloom.llm.suffixes import equal_runs
from scoreloom.scratch import bounded, staged

#: Bytes of text in a batch: between these, about a 128th of all.
LEAST_BATCH, MOST_BATCH = 2 << 20, 16 << 20
#: Anchored runs that a bucket is meant for, and how many there are for a byte of text.
BUCKET_RUNS, RUNS_PER_BYTE = 512_000, 0.085
#: Different runs of one key that a bucket sorts; beyond that they are met window by window.
CROWD = 8192
NO_ID = -(2**63)

MAIL = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("packed", pa.binary())])
MAIL_DDL = "bucket long, batch long, packed binary"


def _pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(a.tobytes() for a in arrays)
    head = struct.pack(f"<B{len(arrays)}Q", len(arrays), *[len(a) for a in arrays])
    return struct.pack("<Q", len(head) + len(raw)) + pa.compress(head + raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    (size,) = struct.unpack_from("<Q", blob)
    raw = pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True)
    lengths = struct.unpack_from(f"<{raw[0]}Q", raw, 1)
    out, at = [], 1 + 8 * raw[0]
    for n, kind in zip(lengths, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, bytes and offsets of a batch."""
    buf, offs = string_buffers(table["text"].combine_chunks() if table.num_rows else pa.array([], pa.string()))
    return table["doc_id"].to_numpy(), buf[offs[0] : offs[-1]], offs - offs[0]


def _in_order(table: pa.Table) -> pa.Table:
    """A batch's rows by doc_id and text.

    Executors fetch the same shuffle in another order for each step, but where
    runs are cut and which runs are crowded is told by places in the bytes.
    """
    return table.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _mail(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], MAIL.field(i).type) for i in range(3)], schema=MAIL)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each group begins in it."""
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(fresh)


def _by_bucket(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of an ascending array."""
    if not len(bucket):
        return []
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return [(int(bucket[lo]), int(lo), int(hi)) for lo, hi in zip(cut, np.append(cut[1:], len(bucket)), strict=True)]


def _ask(bits: int):
    """Batch -> buckets: the distinct keys of its runs, how many different runs have each (255 at most), and whether two of its documents do."""

    def ask(table: pa.Table) -> pa.Table:
        ids, buf, offs = _texts(table)
        anchor, first, last, key = anchored_runs(buf, offs)
        doc = ids[np.searchsorted(offs, anchor, "right") - 1]
        short = key >> np.uint64(32 - bits)
        same = range_hashes(buf, first, last + WINDOW, 23)
        order, begin = _groups(same, short)
        if not len(order):
            return _mail([])
        d, s, h = doc[order], short[order], same[order]
        other = np.ones(len(order), bool)
        other[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
        begin = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        several = np.minimum.reduceat(d, begin) != np.maximum.reduceat(d, begin)
        kinds = np.minimum(255, np.add.reduceat(other.astype(np.int64), begin)).astype(np.uint8)
        short = s[begin]
        batch = table["batch"][0].as_py()
        return _mail([(b, batch, _pack(short[lo:hi].astype(np.uint32), kinds[lo:hi], np.packbits(several[lo:hi]))) for b, lo, hi in _by_bucket((short >> np.uint64(32)).astype(np.int64))])

    return ask


def _shared(most: int):
    """Bucket -> batches: those of each batch's keys that two documents have, here or there, and which of them are crowded.

    A key is crowded if the batches have more than ``most`` runs of it that
    differ, each batch counting its own.
    """

    def shared(table: pa.Table) -> pa.Table:
        keys, kinds, several = [], [], []
        for blob in table["packed"]:
            k, n, bits = _unpack(blob.as_py(), np.uint32, np.uint8, np.uint8)
            keys.append(k)
            kinds.append(n)
            several.append(np.unpackbits(bits, count=len(k)).astype(bool))
        order, begin = _groups(np.concatenate(keys))
        size = np.diff(np.append(begin, len(order)))
        common, crowded = np.zeros(len(order), bool), np.zeros(len(order), bool)
        common[order] = np.repeat((size > 1) | np.logical_or.reduceat(np.concatenate(several)[order], begin), size)
        crowded[order] = np.repeat(np.add.reduceat(np.concatenate(kinds)[order].astype(np.int64), begin) > most, size)
        out, at = [], 0
        for k, bucket, batch in zip(keys, table["bucket"], table["batch"], strict=True):
            here = slice(at, at + len(k))
            at += len(k)
            mine = common[here]
            if mine.any():
                out.append((bucket.as_py(), batch.as_py(), _pack(k[mine], np.packbits(crowded[here][mine]))))
        return _mail(out)

    return shared


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, .. (count[0] of them), first[1], .."""
    total = int(count.sum())
    return np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total) if total else np.zeros(0, np.int64)


def _identity(buf: np.ndarray, first: np.ndarray, last: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash of a run's bytes, their number and the anchor's place in them, as two arrays."""
    shape = (left + 64 * (last - first)).astype(np.uint64)
    return mix(range_hashes(buf, first, last + WINDOW, 23) + shape), mix(range_hashes(buf, first, last + WINDOW, 27) ^ shape)


def _window_hashes(buf: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash of the windows from ascending starts, as two arrays."""
    return range_hashes(buf, start, start + WINDOW, 25), range_hashes(buf, start, start + WINDOW, 29)


def _first_of(doc: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One place for each distinct key, with the smallest document that has it, and whether another has it, too."""
    order, begin = _groups(*keys)
    if not len(order):
        return order, doc[order], np.zeros(0, bool)
    d = doc[order]
    low = np.minimum.reduceat(d, begin)
    return order[begin], low, low != np.maximum.reduceat(d, begin)


def _show(bits: int):
    """Batch -> buckets: the bytes of the runs whose keys are shared, equal runs once with their smallest doc_id.

    Runs of crowded keys are sent window by window instead, to buckets of their
    windows' hashes, so that no bucket gathers all that stands around a
    passage; equal windows once for each batch.
    """

    def show(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not answers.num_rows or not table.num_rows:
            return _mail([])
        ids, buf, offs = _texts(_in_order(table))
        told = [(b.as_py(), *_unpack(p.as_py(), np.uint32, np.uint8)) for b, p in zip(answers["bucket"], answers["packed"], strict=True)]
        shared = np.concatenate([k.astype(np.uint64) | np.uint64(b << 32) for b, k, _ in told])
        crowded = np.concatenate([np.unpackbits(c, count=len(k)).astype(bool) for _, k, c in told])
        order = np.argsort(shared)
        shared, crowded = shared[order], crowded[order]
        anchor, first, last, key = anchored_runs(buf, offs)
        short = key >> np.uint64(32 - bits)
        at = np.minimum(np.searchsorted(shared, short), len(shared) - 1)
        keep, wide = (shared[at] == short) & ~crowded[at], (shared[at] == short) & crowded[at]
        doc = ids[np.searchsorted(offs, anchor, "right") - 1]
        batch = table["batch"][0].as_py()
        out = []

        a, f, z, bucket = anchor[keep], first[keep], last[keep], (short[keep] >> np.uint64(32)).astype(np.int64)
        one, low, several = _first_of(doc[keep], *_identity(buf, f, z, a - f), bucket)
        count = z[one] - f[one] + WINDOW
        bytes_ = buf[_ranges(f[one], count)]
        cut = np.concatenate([[0], np.cumsum(count)])
        left, wins = (a - f)[one].astype(np.uint8), (z - f)[one].astype(np.uint8)
        out += [(b, batch, _pack(low[lo:hi], np.packbits(several[lo:hi]), left[lo:hi], wins[lo:hi], bytes_[cut[lo] : cut[hi]])) for b, lo, hi in _by_bucket(bucket[one])]

        span = last[wide] - first[wide] + 1
        start = _ranges(first[wide], span)
        h, twin = _window_hashes(buf, start)
        bucket = (h >> np.uint64(64 - bits)).astype(np.int64) + (1 << bits)
        one, low, several = _first_of(np.repeat(doc[wide], span), twin, h, bucket)
        bytes_ = buf[_ranges(start[one], np.full(len(one), WINDOW))]
        none = np.zeros(0, np.uint8)
        out += [(b, batch, _pack(low[lo:hi], np.packbits(several[lo:hi]), none, none, bytes_[lo * WINDOW : hi * WINDOW])) for b, lo, hi in _by_bucket(bucket[one])]
        if len(start):
            # to itself, by a bucket of its own: the runs whose windows the answers will be about
            out.append(((2 << bits) + batch, batch, _pack(first[wide], last[wide], none, none, none)))
        return _mail(out)

    return show


def _window_owners(table: pa.Table) -> pa.Table:
    """Bucket of windows -> batches: for each window, the smallest doc_id that has it, where it matters."""
    parts = [_unpack(p.as_py(), np.int64, np.uint8, np.uint8, np.uint8, np.uint8) for p in table["packed"]]
    low = np.concatenate([p[0] for p in parts])
    several = np.concatenate([np.unpackbits(p[1], count=len(p[0])).astype(bool) for p in parts])
    buf = np.concatenate([p[4] for p in parts])
    start = np.arange(len(low)) * WINDOW
    h, twin = _window_hashes(buf, start)
    order, fresh = equal_runs(buf, start, h, WINDOW)
    begin = np.flatnonzero(fresh)
    owner = np.zeros(len(low), np.int64)
    owner[order] = np.repeat(np.minimum.reduceat(low[order], begin), np.diff(np.append(begin, len(order))))
    out, at = [], 0
    for p, bucket, batch in zip(parts, table["bucket"], table["batch"], strict=True):
        mine = np.arange(at, at + len(p[0]))
        at += len(p[0])
        mine = mine[several[mine] | (owner[mine] < low[mine])]
        if len(mine):
            out.append((bucket.as_py(), batch.as_py(), _pack(h[mine], twin[mine], owner[mine], np.zeros(0, np.uint8), np.zeros(0, np.uint8))))
    return _mail(out)


def _owners(bits: int):
    def owners(table: pa.Table) -> pa.Table:
        kind = table["bucket"][0].as_py() >> bits
        return _run_owners(table) if kind == 0 else _window_owners(table) if kind == 1 else table

    return owners


def _run_owners(table: pa.Table) -> pa.Table:
    """Bucket -> batches: for each run, the smallest doc_id that has each of its windows, where it matters.

    Equal runs are one class. Where a key has several classes, the suffixes at
    all of their windows are sorted, and equal windows share an owner.
    """
    parts = [_unpack(p.as_py(), np.int64, np.uint8, np.uint8, np.uint8, np.uint8) for p in table["packed"]]
    low = np.concatenate([p[0] for p in parts])
    several = np.concatenate([np.unpackbits(p[1], count=len(p[0])).astype(bool) for p in parts])
    left = np.concatenate([p[2] for p in parts]).astype(np.int64)
    wins = np.concatenate([p[3] for p in parts]).astype(np.int64)
    buf = np.concatenate([p[4] for p in parts])
    count = wins + WINDOW
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    same, twin = _identity(buf, first, first + wins, left)

    order, begin = _groups(twin, same)
    owner = np.zeros(len(order), np.int64)
    kind = np.zeros(len(order), np.int64)
    kind[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
    least = np.minimum.reduceat(low[order], begin)
    owner = least[kind]
    one = order[begin]  # a run for each class

    on_left = left[one] > HALF
    core = first[one] + left[one] + np.where(on_left, -HALF - 1, 0)
    by_place = np.argsort(core, kind="stable")
    key = np.zeros(len(one), np.uint64)
    key[by_place] = range_hashes(buf, core[by_place], (core + np.where(on_left, HALF + 1 + GRAM, GRAM + SPAN - 1 - HALF))[by_place], 24)
    key = mix(key + on_left)
    o, b = _groups(key)
    size = np.diff(np.append(b, len(o)))
    crowd = np.zeros(len(one), np.int64)
    crowd[o] = np.repeat(np.where(size > 1, np.arange(len(b)), -1), size)

    mixed = np.flatnonzero(crowd >= 0)
    span = wins[one[mixed]] + 1
    cls = np.repeat(mixed, span)
    start = _ranges(first[one[mixed]], span)
    back = np.repeat(left[one[mixed]] + first[one[mixed]], span) - start
    so, fresh = equal_runs(buf, start, crowd[cls] * 64 + back, WINDOW)
    sb = np.flatnonzero(fresh)
    win_owner = np.zeros(len(so), np.int64)
    if len(so):
        win_owner[so] = np.repeat(np.minimum.reduceat(least[cls[so]], sb), np.diff(np.append(sb, len(so))))

    # answers: (class, owner, largest and smallest distance of the windows' starts to the anchor)
    cut = np.ones(len(cls), bool)
    cut[1:] = (cls[1:] != cls[:-1]) | (win_owner[1:] != win_owner[:-1])
    a = np.flatnonzero(cut)
    z = np.append(a[1:], len(cls)) - 1
    plain = np.flatnonzero(crowd < 0)
    ans_cls = np.concatenate([plain, cls[a]]) if len(cls) else plain
    ans_owner = np.concatenate([least[plain], win_owner[a]]) if len(cls) else least[plain]
    ans_far = np.concatenate([left[one[plain]], back[a]]) if len(cls) else left[one[plain]]
    ans_near = np.concatenate([left[one[plain]] - wins[one[plain]], back[z]]) if len(cls) else left[one[plain]] - wins[one[plain]]
    by_cls = np.argsort(ans_cls, kind="stable")
    ans_first = np.searchsorted(ans_cls[by_cls], np.arange(len(one) + 1))

    out, at = [], 0
    for p, bucket, batch in zip(parts, table["bucket"], table["batch"], strict=True):
        mine = np.arange(at, at + len(p[0]))
        at += len(p[0])
        k = kind[mine]
        n = ans_first[k + 1] - ans_first[k]
        who = np.repeat(mine, n)
        ans = by_cls[_ranges(ans_first[k], n)]
        matters = several[who] | (ans_owner[ans] < low[who])
        who, ans = who[matters], ans[matters]
        if len(who):
            out.append((bucket.as_py(), batch.as_py(), _pack(same[who], twin[who], ans_owner[ans], ans_far[ans].astype(np.uint8), ans_near[ans].astype(np.uint8))))
    return _mail(out)


CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), ("kept", pa.binary()), ("copies", pa.int64())])
CUT_DDL = "doc_id long, n_bytes long, spans array<struct<lo: long, hi: long>>, kept binary, copies long"


def _cut(bits: int):
    return lambda table, answers: _removed(table, answers, bits)


def _removed(table: pa.Table, answers: pa.Table, bits: int) -> pa.Table:
    """Batch: take out the windows that a smaller doc_id has."""
    table = _in_order(table)
    ids, buf, offs = _texts(table)
    depth = np.zeros(len(buf) + 1, np.int32)
    parts = [(min(2, b.as_py() >> bits), p.as_py()) for b, p in zip(answers["bucket"], answers["packed"], strict=True)] if len(buf) else []
    kinds = np.uint64, np.uint64, np.int64, np.uint8, np.uint8
    if runs := [_unpack(p, *kinds) for kind, p in parts if kind == 0]:
        same, twin, owner, far, near = (np.concatenate([p[i] for p in runs]) for i in range(5))
        order = np.argsort(same, kind="stable")
        same, twin, owner, far, near = same[order], twin[order], owner[order], far[order].astype(np.int64), near[order].astype(np.int64)
        anchor, first, last, _ = anchored_runs(buf, offs)
        mine, other = _identity(buf, first, last, anchor - first)
        lo, hi = np.searchsorted(same, mine, "left"), np.searchsorted(same, mine, "right")
        run = np.repeat(np.arange(len(mine)), hi - lo)
        ans = _ranges(lo, hi - lo)
        doc = ids[np.searchsorted(offs, anchor, "right") - 1]
        ok = (owner[ans] < doc[run]) & (twin[ans] == other[run])
        run, ans = run[ok], ans[ok]
        np.add.at(depth, anchor[run] - far[ans], 1)
        np.add.at(depth, anchor[run] - near[ans] + WINDOW, -1)
    if windows := [_unpack(p, *kinds) for kind, p in parts if kind == 1]:
        h, twin, owner = (np.concatenate([p[i] for p in windows]) for i in range(3))
        order = np.argsort(h, kind="stable")
        h, twin, owner = h[order], twin[order], owner[order]
        ((first, last, *_),) = [_unpack(p, np.int64, np.int64, np.uint8, np.uint8, np.uint8) for kind, p in parts if kind == 2]
        start = _ranges(first, last - first + 1)
        mine, other = _window_hashes(buf, start)
        lo, hi = np.searchsorted(h, mine, "left"), np.searchsorted(h, mine, "right")
        at, ans = np.repeat(np.arange(len(mine)), hi - lo), _ranges(lo, hi - lo)
        ok = (twin[ans] == other[at]) & (owner[ans] < ids[np.searchsorted(offs, start[at], "right") - 1])
        np.add.at(depth, start[at[ok]], 1)
        np.add.at(depth, start[at[ok]] + WINDOW, -1)
    gone = np.cumsum(depth[:-1]) > 0
    starts, ends = gone.copy(), gone.copy()
    full = offs[:-1] < offs[1:]
    starts[1:] &= ~gone[:-1]
    ends[:-1] &= ~gone[1:]
    starts[offs[:-1][full]] = gone[offs[:-1][full]]
    ends[offs[1:][full] - 1] = gone[offs[1:][full] - 1]
    lo, hi = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offs, lo, "right") - 1
    bounds = np.searchsorted(lo, offs).astype(np.int32)
    spans = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(lo - offs[doc]), pa.array(hi - offs[doc])], names=["lo", "hi"]))
    kept_offs = np.concatenate([[0], np.cumsum(~gone)])[offs].astype(np.int32)
    kept = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(kept_offs.tobytes()), pa.py_buffer(buf[~gone].tobytes())])
    named = pa.array(ids, mask=table["nameless"].to_numpy())
    return pa.table([named, pa.array(np.diff(offs)), spans, kept, table["copies"].combine_chunks()], schema=CUT)


def told_apart(documents: DataFrame) -> DataFrame:
    """The same columns and ``copies``: rows that repeat them all are one row.

    Which ids and hashes of texts repeat is counted first, without the texts.
    Only rows of those are grouped by their texts, where they are few after
    the first step of the sum; where none repeat, nothing is grouped.
    """
    keyed = documents.withColumn("_h", F.xxhash64("text"))
    key = [c for c in keyed.columns if c != "text"]
    again = staged(keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "repeated-rows")
    if again.isEmpty():
        return documents.withColumn("copies", F.lit(1).cast("long"))
    again = bounded(again)
    one = keyed.join(again, key, "left_anti").select(*documents.columns, F.lit(1).cast("long").alias("copies"))
    return one.union(keyed.join(again, key, "left_semi").groupBy(documents.columns).agg(F.count(F.lit(1)).alias("copies")))


def cut_repeats(documents: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One row per document row: doc_id, n_bytes, ``spans`` (removed byte ranges) and ``kept`` (what is left).

    A byte goes if a 50-byte string that covers it also starts in a document
    with a smaller doc_id. Judged on the input texts, as UTF-8 bytes, across
    no document's end. A null text is empty; a null doc_id counts as the least
    number a doc_id can be; rows of equal doc_id, repeated ones too, take
    nothing from each other; an empty table gives no rows. Columns other than doc_id and text
    are not looked at. The texts are shuffled once, by batch, and read by
    three steps; a batch is drawn by doc_id and text, and rows that repeat
    both are cut once and repeated after that, so no id or row fills one.
    """
    documents = documents.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.isnull("doc_id").alias("nameless"))
    total = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    batches = max(1, math.ceil(total / min(MOST_BATCH, max(LEAST_BATCH, total // 128))))
    bits = max(5, math.ceil(math.log2(max(1, total * RUNS_PER_BYTE / BUCKET_RUNS))))
    dealt = told_apart(documents).withColumn("batch", F.pmod(F.xxhash64("doc_id", "text", F.lit("batch")), F.lit(batches)).cast("long"))
    asked = dealt.groupBy("batch").applyInArrow(_ask(bits), MAIL_DDL)
    shared = asked.groupBy("bucket").applyInArrow(_shared(crowd), MAIL_DDL)
    shown = dealt.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(_show(bits), MAIL_DDL)
    owners = shown.groupBy("bucket").applyInArrow(_owners(bits), MAIL_DDL)
    out = dealt.groupBy("batch").cogroup(owners.groupBy("batch")).applyInArrow(_cut(bits), CUT_DDL)
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc_id", "n_bytes", "spans", "kept")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    out = cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 49)) AS s FROM d)),
o AS (SELECT g, min(doc_id) AS owner FROM w GROUP BY g HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT doc_id, s FROM w JOIN o USING (g) WHERE owner < doc_id),
step AS (SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50, true) AS fresh FROM hit),
run AS (SELECT doc_id, min(s) AS lo, max(s) + 50 AS hi FROM (SELECT doc_id, s, sum(fresh::INTEGER) OVER (PARTITION BY doc_id ORDER BY s) AS r FROM step) GROUP BY doc_id, r),
gap AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b FROM run UNION ALL SELECT doc_id, coalesce(max(hi), 0), max(len(h) // 2) FROM d LEFT JOIN run USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n, count(*) AS spans FROM run GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""
