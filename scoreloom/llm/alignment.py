"""Tokens of two tokenizers over the same bytes, aligned by diagonal run skipping."""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.scratch import staged

#: Bytes of text that are encoded and aligned at a time.
CHUNK = 1 << 20
#: Encoded units in a generation of those that a worker keeps; there are two.
KEPT_UNITS = 250_000
#: Longer units are encoded with their whole text.
LONGEST_UNIT = 100
#: Ends of A from one lane's start to the next's, about.
LANE = 256
#: Links of a group beyond which its distinct ids are multiplied, not its tokens.
WIDE = 4096
#: Rows of the table of counts that are broadcast (16 bytes each); a larger table is joined by a shuffle.
BROADCAST_PAIRS = 3_000_000
#: Distinct pairs that a task adds up before it passes them on.
HELD_PAIRS = 1 << 21

# A unit is white space and what follows it up to the next white space. No token of either
# vocabulary goes on from a letter into white space, but for those with a carriage return.
UNIT = re.compile(r"[ \t\n\x0b\x0c]+[^ \t\n\x0b\x0c]*")
WHOLE = re.compile("[\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u2581]")


def lanes(ends_a: np.ndarray, ends_b: np.ndarray, every: int = LANE) -> tuple[np.ndarray, ...]:
    """(start in A, start in B, stop in A, stop in B) of stretches that begin after about every ``every``-th end of A that B has too."""
    at_a = np.arange(every - 1, len(ends_a) - 1, every)
    at_b = np.searchsorted(ends_b, ends_a[at_a])
    common = ends_b[at_b] == ends_a[at_a]
    start_a, start_b = np.append(0, at_a[common] + 1), np.append(0, at_b[common] + 1)
    return start_a, start_b, np.append(start_a[1:], len(ends_a)), np.append(start_b[1:], len(ends_b))


def align(ends_a: np.ndarray, ends_b: np.ndarray, every: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Sizes in A and in B tokens of the groups between offsets where both end; both arrays rise and end alike.

    Ends are compared at the current shift j - i. A one-to-one stretch is
    jumped over by exponential probing: steps double while all ends in them
    agree. At the first that differs the irregular group is resolved end by end
    up to the next common one, which gives the shift from there on. Stretches
    between known common ends (lanes) go forward side by side, each with its
    own place, shift and step, so that arrays do the work of all.
    """
    n, m = len(ends_a), len(ends_b)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j, stop_i, stop_j = lanes(ends_a, ends_b, every)
    turns_a, turns_b = np.zeros(n + 1, np.int8), np.zeros(m + 1, np.int8)  # +1 where group ends begin to follow one another, -1 after them
    step = np.ones(len(i), np.int64)
    while len(i):
        width = np.minimum(step, np.minimum(stop_i - i, stop_j - j))
        lane = np.repeat(np.arange(len(i)), width)
        k = np.arange(len(lane)) - np.repeat(np.cumsum(width) - width, width)
        differ = np.flatnonzero(ends_a[i[lane] + k] != ends_b[j[lane] + k])
        stuck, first = np.unique(lane[differ], return_index=True)
        run = width.copy()
        run[stuck] = k[differ[first]]
        for turns, at in ((turns_a, i), (turns_b, j)):
            turns[at] += 1
            turns[at + run] -= 1
        i, j, step = i + run, j + run, 2 * step
        step[stuck] = 1
        p, q, open_ = i[stuck], j[stuck], np.arange(len(stuck))
        while len(open_):
            x, y = ends_a[p[open_]], ends_b[q[open_]]
            p[open_] += x < y
            q[open_] += y < x
            open_ = open_[x != y]
        for turns, at in ((turns_a, p), (turns_b, q)):
            turns[at] += 1
            turns[at + 1] -= 1
        i[stuck], j[stuck] = p + 1, q + 1
        left = i < stop_i
        i, j, step, stop_i, stop_j = i[left], j[left], step[left], stop_i[left], stop_j[left]
    last_a, last_b = (np.flatnonzero(np.cumsum(turns[:-1], dtype=np.int8)) for turns in (turns_a, turns_b))
    return np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)


@lru_cache(maxsize=1)
def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _packed(ids: array, sizes: list[int]) -> list[bytes]:
    raw, ends = ids.tobytes(), np.cumsum([0, *sizes]).tolist()
    return [raw[4 * lo : 4 * hi] for lo, hi in zip(ends[:-1], ends[1:])]


class Tokenizers:
    """Both tokenizers of a worker, what the bytes of their tokens are, and the ids of units met before."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        special = {i for i, t in self.a.get_added_tokens_decoder().items() if t.special}
        by_id = {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = [b"" if i in special else bytes(letters[c] for c in by_id.get(i, "")) for i in range(max(by_id) + 1)]
        self.bytes_b = [self._piece(i) for i in range(self.b.vocab_size())]
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.units: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self.space = self.b.piece_to_id("\u2581")

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[1:-1], 16)])
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        return piece.replace("\u2581", " ").encode()

    def whole(self, text: str) -> tuple[bytes, bytes] | None:
        """Ids of A and B of a whole text, or nothing if its bytes are not those of both."""
        spaced = " " + text
        a = self.a.encode(spaced, add_special_tokens=False).ids
        b = self.b.encode(text)
        raw = spaced.encode()
        if b"".join([self.bytes_a[i] for i in a]) != raw or b"".join([self.bytes_b[i] for i in b]) != raw:
            return None
        return np.array(a, "<u4").tobytes(), np.array(b, "<u4").tobytes()

    def _ids(self, units: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Packed ids of A and B of each unit. B puts a space in front: a unit that begins with one goes without it, another loses that space's piece."""
        a, b, sizes_a, sizes_b = array("I"), array("I"), [], []
        for found in self.a.encode_batch_fast(units, add_special_tokens=False):
            ids = found.ids
            a.extend(ids)
            sizes_a.append(len(ids))
        for unit, ids in zip(units, self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)):
            if unit == " ":
                ids = [self.space]
            elif unit[0] != " ":
                ids = ids[1:] if ids[:1] == [self.space] else []
            b.extend(ids)
            sizes_b.append(len(ids))
        return _packed(a, sizes_a), _packed(b, sizes_b)

    def _same_bytes(self, unit: str, a: bytes, b: bytes) -> bool:
        raw = unit.encode()
        return all(b"".join([known[i] for i in memoryview(ids).cast("I")]) == raw for known, ids in ((self.bytes_a, a), (self.bytes_b, b)))

    def learn(self, units: set[str]) -> None:
        """Encode units that are not known yet; one whose bytes do not come back stays unknown.

        Units are kept in two generations. Those that are met again move to the
        younger one, which becomes the older when it is full.
        """
        if len(self.units) > KEPT_UNITS:
            self.older, self.units = self.units, {}
        new = units - self.units.keys()
        again = new & self.older.keys()
        self.units.update((u, self.older[u]) for u in again)
        if fresh := sorted(new - again):
            self.units.update((u, (a, b)) for u, a, b in zip(fresh, *self._ids(fresh)) if self._same_bytes(u, a, b))

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of A and B, as little-endian 32-bit numbers, of each text; nothing for a text without tokens."""
        cut = [None if not t or WHOLE.search(t) else UNIT.findall(" " + t) for t in texts]
        for k, units in enumerate(cut):
            if units is not None and max(map(len, units)) > LONGEST_UNIT:
                cut[k] = None
        self.learn(set().union(*[u for u in cut if u is not None]))
        out, known = [], self.units
        for text, units in zip(texts, cut):
            try:
                pairs = None if units is None else [known[u] for u in units]
            except KeyError:
                pairs = None
            if pairs is not None:
                out.append((b"".join([p[0] for p in pairs]), b"".join([p[1] for p in pairs])))
            else:
                out.append(self.whole(text) if text else None)
        return out


_TOKENIZERS: dict[tuple[str, str], Tokenizers] = {}


def tokenizers_of(path_a: str, path_b: str) -> Tokenizers:
    if (path_a, path_b) not in _TOKENIZERS:
        _TOKENIZERS[path_a, path_b] = Tokenizers(path_a, path_b)
    return _TOKENIZERS[path_a, path_b]


@lru_cache(maxsize=2)
def decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits of 0 .. n-1, from the left, with one place more; how many they are."""
    texts = np.array([str(i) for i in range(n)], f"S{len(str(n)) + 1}")
    return texts.view(np.uint8).reshape(n, -1).copy(), np.char.str_len(texts).astype(np.int64)


def group_digests(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, cuts: np.ndarray) -> list[str]:
    """SHA-256 of `a1,a2|b1;a3|b2,b3` for each document; ``cuts``: its first group, and the end of the last one's."""
    before_a, before_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    of_a, of_b = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    n = len(a) + len(b)
    ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[np.arange(len(a)) + before_b[of_a]] = a
    ids[np.arange(len(b)) + (before_a + na)[of_b]] = b
    last = before_a + before_b + na
    mark[last - 1] = ord("|")
    mark[last + nb - 1] = ord(";")
    digits, length = decimals(max(65536, int(ids.max(initial=0)) + 1))
    rows, size = digits[ids], length[ids]
    rows[np.arange(n), size] = mark
    text = rows[np.arange(rows.shape[1]) <= size[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(size + 1)])
    starts = np.concatenate([before_a + before_b, [n]])[cuts]
    at = ends[starts].tolist()
    return [hashlib.sha256(text[lo : hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(at[:-1], at[1:])]


def linked_pairs(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, cuts: np.ndarray, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, times): the distinct pairs a * size_b + b that are linked in a document and how often, in order.

    A group's links are the product of its tokens; where they are many, it is
    that of its distinct ids with their counts, row by row.
    """
    links, start_a, start_b = na * nb, np.cumsum(na) - na, np.cumsum(nb) - nb
    doc_of = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    few = np.flatnonzero(links <= WIDE)
    count = links[few]
    group = np.repeat(few, count)
    nth = np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count)
    width = nb[group]
    pair = a[start_a[group] + nth // width] * size_b + b[start_b[group] + nth % width]
    key, times = np.unique((doc_of[group].astype(np.uint64) << np.uint64(32)) | pair.astype(np.uint64), return_counts=True)
    keys, counts = [key], [times]
    for g in np.flatnonzero(links > WIDE).tolist():
        ids_a, n_a = np.unique(a[start_a[g] : start_a[g] + na[g]], return_counts=True)
        ids_b, n_b = np.unique(b[start_b[g] : start_b[g] + nb[g]], return_counts=True)
        for one, n in zip(ids_a.tolist(), n_a.tolist()):
            keys.append((np.uint64(int(doc_of[g]) << 32)) | (one * size_b + ids_b).astype(np.uint64))
            counts.append(n * n_b)
    if len(keys) > 1:
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        times = np.zeros(len(key), np.int64)
        np.add.at(times, where, np.concatenate(counts))
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64), times


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
#: The aligned tokens of a document, as little-endian 32-bit numbers.
GROUPS = "doc_id long, ids_a binary, ids_b binary, sizes_a binary, sizes_b binary"


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    for batch in batches:
        texts, lo, size = batch.column(1), 0, 0
        for hi, n in enumerate(pc.coalesce(pc.binary_length(texts), pa.scalar(0, pa.int32())).to_pylist(), 1):
            size += n
            if size > CHUNK or hi == len(texts):
                yield batch.column(0)[lo:hi], [t or "" for t in texts[lo:hi].to_pylist()]
                lo, size = hi, 0


def _aligned(found: list[tuple[bytes, bytes] | None], tok: Tokenizers):
    """Ids, group sizes, and the cuts of the documents in A tokens, B tokens and groups."""
    a = np.frombuffer(b"".join([x[0] for x in found if x]), "<u4").astype(np.int64)
    b = np.frombuffer(b"".join([x[1] for x in found if x]), "<u4").astype(np.int64)
    na, nb = align(np.cumsum(tok.size_a[a]), np.cumsum(tok.size_b[b]))
    cut_a = np.cumsum([0, *[len(x[0]) // 4 if x else 0 for x in found]])
    cut_b = np.cumsum([0, *[len(x[1]) // 4 if x else 0 for x in found]])
    cuts = np.searchsorted(np.concatenate([[0], np.cumsum(na)]), cut_a)
    return a, b, na, nb, cut_a, cut_b, cuts


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned_groups(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """GROUPS: the ids of both tokenizers for each row's text and the sizes of the groups they align to.

    Texts that are null or empty, and those that either tokenizer does not give
    back byte for byte, have no tokens. Whole texts are read, in chunks of
    about CHUNK bytes. Repeated rows each have a row; other columns are not read.
    """
    paths = paths or vocabulary_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers_of(*paths)
        for ids, texts in _chunked(batches):
            found = tok.encode(texts)
            _, _, na, nb, _, _, cuts = _aligned(found, tok)
            sizes = [[x[lo:hi].astype("<u4").tobytes() for lo, hi in zip(cuts[:-1], cuts[1:])] for x in (na, nb)]
            yield pa.record_batch([ids.cast(pa.int64()), *[pa.array([x[k] if x else b"" for x in found], pa.binary()) for k in (0, 1)], *[pa.array(s, pa.binary()) for s in sizes]], names=["doc_id", "ids_a", "ids_b", "sizes_a", "sizes_b"])

    return docs.select("doc_id", "text").mapInArrow(run, GROUPS)


def aligned_documents(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """ALIGNED: counts and digest of each document's groups, and its distinct linked pairs with how often they are."""
    paths = paths or vocabulary_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers_of(*paths)
        for ids, texts in _chunked(batches):
            found = tok.encode(texts)
            a, b, na, nb, cut_a, cut_b, cuts = _aligned(found, tok)
            digests = group_digests(a, b, na, nb, cuts)
            doc, pair, times = linked_pairs(a, b, na, nb, cuts, len(tok.size_b))
            at = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
            links = np.concatenate([[0], np.cumsum(na * nb)])[cuts]
            pair, times = pair.astype("<u4"), times.astype("<u8")
            counts = [pa.array(np.diff(x), pa.int64()) for x in (cut_a, cut_b, cuts, links)]
            packed = [pa.array([x[lo:hi].tobytes() for lo, hi in zip(at[:-1], at[1:])], pa.binary()) for x in (pair, times)]
            yield pa.record_batch([ids.cast(pa.int64()), *counts, pa.array(digests, pa.string()), *packed], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return docs.select("doc_id", "text").mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): how many documents hold each pair, and whether no pair of its A id is in more.

    A task adds up what it reads, so the commonest pair costs a row for each
    task and HELD_PAIRS, not for each document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, waiting, size = np.zeros(0, np.uint32), np.zeros(0, np.int64), [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            own, count = np.unique(np.concatenate(waiting), return_counts=True)
            both, where = np.unique(np.concatenate([key, own]), return_inverse=True)
            return both, np.bincount(where, np.concatenate([n, count]), len(both)).astype(np.int64)

        for batch in batches:
            for packed in batch.column(0):
                waiting.append(np.frombuffer(packed.as_buffer(), "<u4"))
                size += len(waiting[-1])
                if size >= HELD_PAIRS:
                    key, n = summed()
                    waiting, size = [], 0
                    if len(key) > HELD_PAIRS:
                        yield pa.record_batch([pa.array(key.astype(np.int64)), pa.array(n)], names=["pair", "n"])
                        key, n = key[:0], n[:0]
        if waiting:
            key, n = summed()
        yield pa.record_batch([pa.array(key.astype(np.int64)), pa.array(n)], names=["pair", "n"])

    per_task = aligned.select("pairs").where("n_links > 0").mapInArrow(run, "pair long, n long")
    counts = staged(per_task.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    a = F.floor(F.col("pair") / size_b)
    most = counts.groupBy(a.alias("_a")).agg(F.max("n").alias("_most"))
    return counts.join(most, a == F.col("_a")).select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def with_counts(aligned: DataFrame, counts: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """RESULT: the links of each document that are the best of their A id, and the sum of their counts.

    The table of counts is counted first. Up to ``broadcast_pairs`` rows it goes
    to the workers as sorted arrays; beyond, each document's distinct pairs are
    joined to it, the commonest pairs split over SALTS.
    """
    spark = aligned.sparkSession
    counts = staged(counts, "pair-ranks")
    if counts.count() > broadcast_pairs:
        return _joined(aligned, counts)
    table = counts.toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast((table["pair"].to_numpy().astype("<u4"), table["n"].to_numpy(), table["best"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            bests, sums = [], []
            for pairs, times in zip(col["pairs"], col["times"]):
                at = np.searchsorted(known, np.frombuffer(pairs.as_buffer(), "<u4"))
                often = np.frombuffer(times.as_buffer(), "<u8").astype(np.int64)
                bests.append(int(often[best[at]].sum()) if len(at) else 0)
                sums.append(int((often * n[at]).sum()) if len(at) else 0)
            out = col | {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
            yield pa.record_batch([out[c] for c in RESULT], names=RESULT)

    return aligned.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


#: Parts that the documents of one pair are dealt to where counts are joined by a shuffle.
SALTS = 64


def _joined(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    rows = staged(aligned.withColumn("_row", F.monotonically_increasing_id()), "aligned-rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, pairs, times in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                pair, often = np.frombuffer(pairs.as_buffer(), "<u4"), np.frombuffer(times.as_buffer(), "<u8")
                for lo in range(0, len(pair), 100_000):
                    part = pair[lo : lo + 100_000].astype(np.int64)
                    yield pa.record_batch([pa.array(np.full(len(part), row)), pa.array(part), pa.array(often[lo : lo + 100_000].astype(np.int64))], names=["_row", "pair", "times"])

    links = rows.select("_row", "pairs", "times").where("n_links > 0").mapInArrow(run, "_row long, pair long, times long").withColumn("salt", F.pmod("_row", F.lit(SALTS)).cast("int"))
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sums = links.join(salted, ["pair", "salt"]).groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return rows.drop("pairs", "times").join(sums, "_row", "left").select(*[c for c in RESULT if c not in ("n_best", "count_sum")], *zero).select(*RESULT)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level and word-piece tokens of all documents, aligned; counts of linked pairs are those of the whole corpus.

    Null and empty texts, and texts that a tokenizer changes, have zeros and an
    empty digest. Repeated rows each count as a document. Whole texts are
    encoded; ids may be null or repeat; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    paths = vocabulary_paths()
    aligned = staged(aligned_documents(docs, paths), "aligned")
    return with_counts(aligned, pair_counts(aligned, tokenizers_of(*paths).b.vocab_size()))
