"""WARC archives with revisit records for repeated payloads."""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm.digests import hex_base32
from scoreloom.llm.positional import small
from scoreloom.scratch import new_folder, staged

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; a field whose value is null is left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\r\n]+", " "), F.lit(CRLF)), F.lit("")) for name, value in fields])


def _record_id(page_id: str, url: str, digest: str, copy: Column) -> Column:
    """Differs for all records: rows repeated exactly have a number each."""
    h = F.md5(F.to_json(F.struct(F.col(page_id).alias("page"), F.col(url).alias("url"), F.col(digest).alias("digest"), copy.alias("copy"))))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty) and ``sha``, the payload's SHA-1 in hex."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))


def resolve_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One row for each record header: page_id, url, sha, payload_bytes, copies, record_type, refers_to, refers_to_url.

    Among records with equal payloads of at least ``least_bytes`` bytes the one
    with the largest page_id is the response and the others revisit it. Rows
    that repeat that page_id are responses as well; where all page_ids of a
    payload are null, so are all of its rows. A null html is an empty payload.
    Rows that repeat page_id, url and payload are one header with their number
    in ``copies``; columns other than page_id, url and html are not looked at.

    Only headers are shuffled, by payload digest, and only digests of several
    records are joined to their original. Sums come first and are written, so
    a digest that holds a third of the rows costs one row per task, and Spark
    can split the join.
    """
    heads = _payloads(pages).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    heads = staged(heads.groupBy("page_id", "url", "sha", "payload_bytes").agg(F.count(F.lit(1)).alias("copies")), "warc-headers")
    last = heads.where(F.col("payload_bytes") >= least_bytes).groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("last"), F.count(F.lit(1)).alias("n"))
    last = staged(last.where("n > 1").select("sha", "last"), "warc-originals")
    found = heads.join(last, "sha", "left")
    revisit = F.coalesce(F.col("last.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last.page_id")), F.lit(False))
    kinds = {"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("last.page_id")), "refers_to_url": F.when(revisit, F.col("last.url"))}
    return staged(found.withColumns(kinds).drop("last"), "warc-resolved")


def response_payloads(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """The payload of each response, with its number ``copy`` among rows repeated exactly.

    Payloads stay where they are read: what is not to be written is looked up
    in the revisits' keys, which are broadcast if they are few enough (their
    bytes are summed) and joined by a shuffle beyond that. Only rows repeated
    exactly are brought together, to be numbered.
    """
    rows = _payloads(pages)
    gone = resolved.where("record_type = 'revisit'").select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha")).distinct()
    rows = rows.join(small(gone), F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left_anti")
    again = small(resolved.where("record_type = 'response' AND copies > 1").select(F.col("page_id").alias("_id"), F.col("url").alias("_url"), F.col("sha").alias("_sha"), "copies"))
    same = F.col("page_id").eqNullSafe(F.col("_id")) & F.col("url").eqNullSafe(F.col("_url")) & (F.col("sha") == F.col("_sha"))
    once = rows.join(again, same, "left_anti").withColumn("copy", F.lit(0))
    repeated = rows.join(again, same).groupBy("page_id", "url", "sha", "copies").agg(F.first("html").alias("html"))
    return once.unionByName(repeated.select("page_id", "url", "sha", "html", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("copy")))


def write_archives(pages: DataFrame, resolved: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", per_file: int = 20_000) -> None:
    """Write the records of ``pages`` as gzip-compressed WARC/1.1 files, at most ``per_file`` records each.

    Responses carry their payload. A revisit has fresh headers of its own and
    the HTTP header of the original, but no payload. As a task writes what it
    reads, a file is bounded by a split of the input as well.
    """
    responses = response_payloads(pages, resolved).withColumns({"payload_bytes": F.octet_length("html").cast("long"), "record_type": F.lit("response"), "refers_to": F.lit(None).cast("long"), "refers_to_url": F.lit(None).cast("string")})
    revisits = resolved.where("record_type = 'revisit'").withColumns({"html": F.lit(""), "copy": F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1))}).drop("copies")
    rows = responses.unionByName(revisits).withColumn("payload_digest", hex_base32(F.col("sha")))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    revisit = F.col("record_type") == "revisit"
    head = _lines(
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", _record_id("page_id", "url", "sha", F.col("copy"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("WARC-Page-ID", F.col("page_id")),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("WARC-Refers-To", F.when(revisit, _record_id("refers_to", "refers_to_url", "sha", F.lit(0)))),
        ("WARC-Refers-To-Target-URI", F.col("refers_to_url")),
        ("WARC-Refers-To-Page-ID", F.col("refers_to")),
        ("Content-Type", F.lit("application/http;msgtype=response")),
        ("Content-Length", F.octet_length("block")),
    )
    records = rows.withColumn("block", F.concat(http, F.col("html"))).select(F.concat(F.lit("WARC/1.1" + CRLF), head, F.lit(CRLF), F.col("block"), F.lit(CRLF)).alias("value"))
    records.write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def _headers(stream) -> tuple[str, dict[str, str]] | None:
    first = stream.readline()
    if not first:
        return None
    fields = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode().rstrip("\r\n").partition(": ")
        fields[name.lower()] = value
    return first.decode().strip(), fields


class _Inflate(io.RawIOBase):
    """Reads gzip bytes piece by piece, so that a file is never inflated as a whole."""

    def __init__(self, data: bytes):
        self.data, self.at, self.z, self.rest = memoryview(data), 0, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.rest and (self.at < len(self.data) or self.z.unconsumed_tail):
            if self.z.eof:
                tail = self.z.unused_data
                self.at -= len(tail)
                self.z = zlib.decompressobj(31)
                continue
            piece = self.z.unconsumed_tail or self.data[self.at : self.at + 65536]
            if not self.z.unconsumed_tail:
                self.at += len(piece)
            self.rest = self.z.decompress(piece, 1 << 20)
        k = min(len(out), len(self.rest))
        out[:k] = self.rest[:k]
        self.rest = self.rest[k:]
        return k


def records_of(content: bytes, payloads: bool) -> Iterator[dict]:
    """The response and revisit records of one archive, lengths and digests from what is stored."""
    stream = io.BufferedReader(_Inflate(content), 1 << 18)
    while (head := _headers(stream)) is not None:
        version, fields = head
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        block = stream.read(int(fields["content-length"]))
        stream.read(4)
        kind = fields["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        http = io.BytesIO(block)
        _, inner = _headers(http)
        body = http.read()
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        whole = int(inner["content-length"])
        if kind == "response":
            import base64
            import hashlib

            digest, whole = base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body)
        number = lambda name: int(fields[name]) if fields.get(name) else None  # noqa: B023, E731
        yield {"page_id": number("warc-page-id"), "url": fields.get("warc-target-uri"), "payload_bytes": whole, "payload_digest": digest, "record_type": kind, "refers_to": number("warc-refers-to-page-id"), "payload": body.decode() if payloads and kind == "response" else None}


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``; a response's digest and length are taken anew."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(RECORD))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for row in records_of(content.as_py(), payloads):
                    rows.append(row)
                    size += len(row["payload"] or "") + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(parse, RECORD)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages into archives with revisits, then what the archives hold."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = new_folder(spark, "warc")
    write_archives(pages, resolve_revisits(pages), path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH h AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
d AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(x, CAST((i // 8) * 10 + 1 AS INTEGER), 10))::UBIGINT >> CAST(35 - 5 * (i % 8) AS UBIGINT)) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest
  FROM h),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM m
"""
