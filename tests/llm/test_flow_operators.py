"""Sharding, mixing, URL rules and WARC against plain restatements of their contracts."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from scoreloom.llm import mixing, positional, sharding, urls, warc
from scoreloom.scratch import new_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


ODD = [(1, None, "b"), (2, "", None), (3, "one two three", "a"), (3, "one two three", "a"), (4, "x " * 4000, "a"), (5, "é ü", "b"), (None, "no id here", "a")] + [(i, "copy of the same words again", "a") for i in range(10, 60)]


def shard_laws(rows, shards=16):
    total = defaultdict(int)
    slots = defaultdict(list)
    for r in rows:
        total[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return total


def test_shards_are_even_and_gapless(spark, sf):
    out = sharding.op1_sharding(spark, sf).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in out) == sorted(text)
    total = shard_laws(out)
    for r in out:
        b = text[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(b) + 1, zlib.crc32(b))
    most = max(r["size"] for r in out)
    mean = sum(total.values()) / 16
    assert all(abs(v - mean) <= most + 0.02 * mean for v in total.values())


def test_shards_split_a_hot_key(spark):
    rows = spark.range(20000).selectExpr("id AS doc_id", "100L AS size", "if(id < 15000, 7L, xxhash64(id)) AS key", "xxhash64(id) AS tie")
    out = sharding.assign_shards(rows, 16).groupBy("shard").sum("size").collect()
    assert len(out) == 16 and max(r[1] for r in out) - min(r[1] for r in out) <= 200


def test_shards_of_odd_rows(spark):
    out = sharding.document_shards(docs(spark, ODD).selectExpr("*", "doc_id AS shard")).collect()
    assert len(out) == len(ODD)
    shard_laws(out)
    assert {r["size"]: r.text_crc32 for r in out}[1] == 0
    assert sharding.document_shards(docs(spark, [])).count() == 0


def water_fill(sizes, weights, total, most):
    left = dict.fromkeys(sizes, 0.0)
    open_, rest = set(sizes), total
    while open_ and rest > 1e-9:
        w = sum(weights[s] for s in open_)
        share = {s: rest * weights[s] / w for s in open_}
        rest = 0.0
        for s in list(open_):
            left[s] += share[s]
            if left[s] >= most * sizes[s]:
                rest += left[s] - most * sizes[s]
                left[s] = most * sizes[s]
                open_.discard(s)
    return left


@pytest.mark.parametrize("name", ["sf", "odd"])
def test_mixing(spark, sf, name):
    frame = spark.read.parquet(f"{sf}/documents.parquet") if name == "sf" else docs(spark, ODD)
    given = frame.collect()
    out = mixing.mixed_documents(frame).collect()
    assert sorted((r.doc_id or -1) for r in out) == sorted((r.doc_id or -1) for r in given)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in given:
        sizes[r.source] += size(r.text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = water_fill(sizes, {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    source = {r.doc_id: r.source for r in given}
    taken = defaultdict(int)
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - targets[s]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - targets[s]) < 3 for s in sizes)
    again = mixing.mixed_documents(frame.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_mixing_of_nothing(spark):
    assert mixing.mixed_documents(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.mixed_documents(docs(spark, [(1, None, None)])).collect()] == [0]


URLS = [None, "", "no scheme", "http://example.com", "http://EXAMPLE.com/en/x?y#z", "http://www.example.com/en/1", "http://a.www.example.com/en/", "https://x.net/es/1", "https://net/fr/", "http://badexample.com/en/", "http://a.org/http://b.com/", "http://evil.org/x.example.com/en/", "ftp://?q", "http://notcom/", "http://com/" + "a" * 300, "http://ü.com/é"]


def test_url_rules(spark):
    frame = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(URLS)], "page_id long, url string, extra string")
    out = {r.page_id: r for r in urls.judge_urls(frame, urls.PAGE_RULES).collect()}
    for i, u in enumerate(URLS):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [r for r in urls.PAGE_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, best and best.name), u
        assert out[i].verdict == (best.verdict if best else "allow") and out[i].extra == "mine"


def test_url_columns_that_clash(spark):
    frame = spark.createDataFrame([("http://net/fr/", "h", "r", 7)] * 2 + [(None, None, None, None)], "url string, HOST string, rule string, _rule int")
    out = urls.judge_urls(frame, urls.PAGE_RULES)
    assert out.columns == ["url", "_HOST", "__rule", "_rule", "host", "path", "rule", "verdict"]
    assert sorted(out.collect(), key=str) == sorted([("http://net/fr/", "h", "r", 7, "net", "/fr/", "net/fr/", "block")] * 2 + [(None, None, None, None, "", "", None, "allow")], key=str)
    assert urls.judge_urls(frame.limit(0), urls.PAGE_RULES).count() == 0


def test_sharded_columns_that_clash(spark):
    frame = spark.createDataFrame([(1, "a", 5, 6), (None, None, None, None)], "doc_id long, text string, shard int, _shard int")
    out = sharding.sharded_documents(frame)
    assert out.columns == ["doc_id", "text", "__shard", "_shard", "shard", "slot"]
    assert {tuple(r)[:4] for r in out.collect()} == {(1, "a", 5, 6), (None, None, None, None)}


def test_globs():
    globs = [("*.a?.com", "/x*y/*"), ("a*", "*"), ("b", "")]
    texts = [b"q.ab.com\xff/x1/2y/", b"q.ab.com\xff/xy/z", b"a\xff", b"b\xff", b"b\xff/", b"qa.com\xff/xy/"]
    hit = urls.ShiftAnd(globs).run(texts)
    assert hit.tolist() == [[True, False, False], [True, False, False], [False, True, False], [False, False, True], [False, False, False], [False, False, False]]
    many = [("h" * 40, "/" + "p" * k + "*") for k in range(5)]
    assert urls.ShiftAnd(many).run([b"h" * 40 + b"\xff/ppp"]).tolist() == [[True, True, True, True, False]]


def test_warc_round_trip(spark):
    pages = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nX: y", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\né"), (6, "u", "z" * 100000), (None, "u", "only null"), (7, "http://c/", "<p>x</p>")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = new_folder(spark, "test-warc")
    warc.write_archives(frame, warc.resolve_revisits(frame), path, per_file=3)
    out = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert len(out) == len(pages)
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(last.get(h or "") or -1, i or -1)
    for i, _, h in pages:
        b = (h or "").encode()
        r = out[i]
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        revisit = (i or -1) != last[h or ""]
        assert (r.record_type, r.refers_to) == (("revisit", last[h or ""]) if revisit else ("response", None))
        assert r.payload == (None if revisit else (h or ""))


def test_warc_of_all_pages(spark, sf):
    out = warc.op9_warc(spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/pages.parquet").count()


@pytest.mark.parametrize("limit", [None, 0])
def test_warc_of_repeated_and_hot_payloads(spark, monkeypatch, limit):
    """Repeated rows are records of their own, with ids of their own; a hot payload; joins with and without broadcast."""
    if limit is not None:
        monkeypatch.setattr(positional, "BROADCAST_BYTES", limit)
    big = "<p>" + "big " * 400_000
    pages = [(i, f"http://h/{i}", "hot") for i in range(300)] + [(299, "http://h/299", "hot")] * 2 + [(298, "http://h/298", "hot"), (299, "http://other/", "hot"), (None, "n", "nulls"), (None, "n", "nulls"), (None, "m", "nulls"), (500, "u", big), (501, "u", None)]
    frame = spark.createDataFrame([(*p, "x", 3) for p in pages], "page_id long, url string, html string, sha string, copies int")
    path = new_folder(spark, "test-warc")
    warc.write_archives(frame, warc.resolve_revisits(frame), path)
    out = warc.read_archives(spark, path).collect()
    kinds = Counter((r.page_id, r.record_type, r.refers_to, r.payload) for r in out)
    assert len(out) == len(pages)
    assert kinds[(299, "response", None, "hot")] == 4 and kinds[(298, "revisit", 299, None)] == 2 and kinds[(None, "response", None, "nulls")] == 3
    assert kinds[(500, "response", None, big)] == 1 and kinds[(501, "response", None, "")] == 1
    text = "".join(r.value for r in spark.read.text(path).collect())
    ids = re.findall(r"WARC-Record-ID: (\S+?)(?:WARC|\s|$)", text)
    assert len(set(ids)) == len(ids) == len(pages)
    assert set(re.findall(r"WARC-Refers-To: (<urn:uuid:[-0-9a-f]+>)", text)) <= set(ids)
    assert warc.resolve_revisits(frame.limit(0)).count() == 0


def test_rows_that_repeat_in_full_are_cut_into_ranges(spark):
    """A third of all rows without an id and with one text: no range, and so no task, holds them all."""
    df = spark.range(60_000).selectExpr("CASE WHEN id % 3 > 0 THEN id END AS doc_id", "CASE WHEN id % 3 > 0 THEN concat('text ', id) ELSE 'one boilerplate text' END AS text")
    rows = sharding.document_shards(df).collect()
    total = shard_laws(rows)
    assert len(rows) == 60_000 and max(total.values()) - min(total.values()) < 200
    keyed = sharding._keyed(df, sharding.F.rand(1) * (1 << 20)).where("doc_id IS NULL")
    assert keyed.select("key", "tie").distinct().count() > 19_000
    again = {(r.doc_id, r.shard, r.slot) for r in rows if r.doc_id is not None}
    assert again == {(r.doc_id, r.shard, r.slot) for r in sharding.document_shards(df).collect() if r.doc_id is not None}
    out = sharding.sharded_documents(df.withColumn("n", df.doc_id))
    assert out.count() == 60_000 and out.groupBy("shard").count().count() == 16
