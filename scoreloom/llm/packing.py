"""Packing of tokenized documents into sequences by bin completion."""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.operators.ordinals import numbered
from scoreloom.scratch import staged

#: Tokens of a sequence.
CAPACITY = 2048
#: Nodes that the search visits at most, and fillings it looks at in each; the best plan found by then is used.
NODES, FILLINGS = 400, 24
#: Bytes of text that are encoded at a time.
CHUNK = 1 << 20
#: Encoded words in a generation of those that a worker keeps; there are two.
KEPT_WORDS = 400_000
#: Longer words are not kept.
LONGEST_WORD = 100

# The vocabulary's words in lower-case text of ASCII and common Latin and Cyrillic letters (which
# fold one to one and are their own composed form), and its special tokens, which texts may hold.
SPECIAL = re.compile(r"<\|startoftext\|>|<\|endoftext\|>")
LETTERS = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f\u0400-\u045f"
OTHER = re.compile(f"[^\x00-\x7f{LETTERS}]")
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LETTERS}]+|[0-9]|[^ \t\n\x0b\x0c\ra-z{LETTERS}0-9]+")
RUN = re.compile(r"[^ \t\n\x0b\x0c\r]+")
ODD_WHITE = re.compile("[\x1c-\x1f]")


class WordIds:
    """A worker's tokenizer, with the packed ids of words met before."""

    def __init__(self, path: str):
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of all ``words``; those met again stay, others go when a newer generation is full."""
        if len(self.words) > KEPT_WORDS:
            self.older, self.words = self.words, {}
        new = words - self.words.keys()
        again = new & self.older.keys()
        self.words.update((w, self.older[w]) for w in again)
        fresh = sorted(new - again)
        long = [w for w in fresh if len(w) > LONGEST_WORD]
        fresh = [w for w in fresh if len(w) <= LONGEST_WORD]
        plain = [w for w in fresh if not OTHER.search(w)]
        self.words.update(zip(plain, self._ids_of_words(plain)))
        rest = [w for w in fresh if OTHER.search(w)]
        self.words.update(zip(rest, self._ids(rest)))
        return dict(zip(long, self._ids(long)))

    def _ids_of_words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words of the vocabulary's cut, encoded together: a word ends with its token that has the mark of word ends."""
        texts = [" ".join(words[lo : lo + 512]) for lo in range(0, len(words), 512)]
        for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(found.ids, np.int64)
            raw, at = ids.astype("<u4").tobytes(), 0
            for end in (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist():
                yield raw[at:end]
                at = end

    @staticmethod
    def cut(text: str) -> list[str] | None:
        """Parts of a text that encode alone as they do in it; None where only the whole text will do.

        Runs between white space are independent. Those of ASCII and LETTERS
        are folded and cut into the vocabulary's words; others stay whole.
        """
        if SPECIAL.search(text) or ODD_WHITE.search(text):
            return None
        if not OTHER.search(text):
            return WORD.findall(text.lower())
        out = []
        for run in RUN.findall(text):
            out += [run] if OTHER.search(run) else WORD.findall(run.lower())
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        parts = [self.cut(t) for t in texts]
        long = self.learn(set().union(*[p for p in parts if p is not None]))
        known = self.words
        if long:
            known = known | long
        return [b"".join([known[w] for w in p]) if p is not None else self._ids([t])[0] for t, p in zip(texts, parts)]


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """PIECES of each row's text, and the packed ids themselves with ``ids``: the text's ids and a closing 0, cut after every ``capacity``.

    A null or empty text has the closing 0 alone. Whole texts are encoded.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        for batch in batches:
            texts, lo, size = batch.column(1), 0, 0
            for hi, n in enumerate(pc.coalesce(pc.binary_length(texts), pa.scalar(0, pa.int32())).to_pylist(), 1):
                size += n
                if size <= CHUNK and hi < len(texts):
                    continue
                rows = []
                for doc, packed in zip(batch.column(0)[lo:hi].to_pylist(), encoder.encode([t or "" for t in texts[lo:hi].to_pylist()])):
                    packed += bytes(4)
                    for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                        part = packed[at : at + 4 * capacity]
                        rows.append((doc, k, k * capacity, len(part) // 4, zlib.crc32(part), *([part] if ids else [])))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids])
                lo, size = hi, 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES + ", ids binary" * ids)


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound of the sequences: all tokens over the capacity, and what is too long to share one with its like, with the room left beside it."""
    number = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        number[n] = c
    upto = np.concatenate([[0], np.cumsum(number)])
    tokens = np.concatenate([[0], np.cumsum(number * np.arange(capacity + 1))])
    half = capacity // 2 + 1
    # for each k: those above capacity - k have a sequence without any of length k or more, others above one half have one each
    k = np.arange(1, capacity // 2 + 1)
    alone = upto[-1] - upto[capacity - k + 1]
    many = upto[capacity - k + 1] - upto[half]
    room = many * capacity - (tokens[capacity - k + 1] - tokens[half])
    rest = tokens[half] - tokens[k]
    bounds = alone + many + np.maximum(0, -((room - rest) // capacity))
    return max(int(-(-tokens[-1] // capacity)), int(bounds.max(initial=0)))


Plan = list[tuple[int, dict[int, int]]]


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over classes of equal length: (how often, filling) of each kind of sequence.

    Longest first, a class goes to the open sequences whose room is the least
    that holds it, as many at a time as there are; what is left opens new ones.
    """
    done: Plan = []
    open_: dict[int, list[tuple[int, dict[int, int]]]] = {}
    rooms: list[int] = []

    def put(room: int, n: int, filling: dict[int, int]) -> None:
        if not room:
            done.append((n, filling))
            return
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((n, filling))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                full, part = divmod(left, each)
                if full:
                    put(capacity - each * length, full, {length: each})
                if part:
                    put(capacity - part * length, 1, {length: part})
                break
            room = rooms[at]
            n, filling = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            each = min(room // length, left)
            take = min(n, left // each)
            if take < n:
                put(room, n - take, filling)
            put(room - each * length, take, {**filling, length: filling.get(length, 0) + each})
            left -= take * each
    return done + [x for groups in open_.values() for x in groups]


def bins_of(plan: Plan) -> int:
    return sum(n for n, _ in plan)


def fillings(lengths: list[int], counts: dict[int, int], room: int, waste: int) -> list[list[int]]:
    """Undominated ways to fill ``room`` from rising ``lengths``, least waste first; FILLINGS of those found at most.

    A filling is dominated if a longer piece fits in place of one or two of
    its pieces. One piece that fills the room exactly dominates all others.
    Fillings that leave more than ``waste`` are pruned, unless nothing fits.
    """
    at = bisect_right(lengths, room)
    if not at or room <= 0:
        return [[]]
    if lengths[at - 1] == room:
        return [[room]]
    found: list[tuple[int, list[int]]] = []
    has = counts.keys()
    looked = 0

    def grow(top: int, left: int, chosen: list[int]) -> None:
        nonlocal looked
        looked += 1
        fits = bisect_right(lengths, min(left, top))
        longest = [n for n in reversed(lengths[:fits]) if chosen.count(n) < counts[n]][:6] if looked <= 40 * FILLINGS else []
        if not longest:
            if left <= waste or not found:
                found.append((left, list(chosen)))
            return
        if left in has and left <= top and chosen.count(left) < counts[left]:
            longest = [left]
        for n in longest:
            grow(n, left - n, [*chosen, n])

    grow(room, room, [])

    def dominated(left: int, chosen: list[int]) -> bool:
        used = set(chosen)
        for k, n in enumerate(chosen):
            nxt = bisect_right(lengths, n + left) - 1
            if lengths[nxt] > n and lengths[nxt] not in used:
                return True
            for m in chosen[k + 1 :]:
                both = bisect_right(lengths, n + m + left) - 1
                if lengths[both] >= n + m and lengths[both] not in used:
                    return True
        return False

    best = [f for f in found if not dominated(*f)] or [min(found)]
    return [chosen for _, chosen in sorted(best, key=lambda f: (f[0], len(f[1])))[:FILLINGS]]


def complete(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """Sequences for so many pieces of each length, as few as the search finds within ``nodes``.

    Depth-first branch-and-bound. A node is a multiset of pieces that are left,
    as counts of their lengths. Its largest piece is completed by each
    undominated filling in turn, as often as the counts allow at once, so a
    node does not stand for a sequence but for all sequences that are alike.
    A node is pruned if its sequences and the lower bound of what is left reach
    the incumbent's number: its waste is then spent. At each node a best-fit
    packing of what is left gives a whole plan, which is kept as the incumbent
    if it is the best so far. Found without search where that meets the bound.
    """
    counts = {n: c for n, c in counts.items() if c}
    best = best_fit(counts, capacity)
    total = bins_of(best)
    bound = least_bins(counts, capacity)
    stack: list[tuple[dict[int, int], int, Plan]] = [(counts, 0, [])]
    while stack and total > bound and nodes:
        nodes -= 1
        left, used, plan = stack.pop()
        if not left or used + least_bins(left, capacity) >= total:
            continue
        rest = best_fit(left, capacity)
        if used + bins_of(rest) < total:
            best, total = plan + rest, used + bins_of(rest)
        lengths = sorted(left)
        largest = lengths[-1]
        one = {**left, largest: left[largest] - 1}
        waste = (total - 1 - used) * capacity - sum(n * c for n, c in left.items())
        children = []
        for filling in fillings([n for n in lengths if one[n]], {n: c for n, c in one.items() if c}, capacity - largest, waste):
            need: dict[int, int] = {}
            for n in [largest, *filling]:
                need[n] = need.get(n, 0) + 1
            times = min(left[n] // c for n, c in need.items())
            after = {n: c - times * need.get(n, 0) for n, c in left.items()}
            children.append(({n: c for n, c in after.items() if c}, used + times, [*plan, (times, need)]))
        stack += reversed(children)
    return best


SLOTS = ["length", "first_rank", "times", "each", "first_sequence", "offset"]


def slots(plan: Plan) -> list[tuple[int, ...]]:
    """SLOTS: where the pieces of each length go, by rank: ``each`` to each of ``times`` sequences from ``first_sequence``, from ``offset`` on."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for times, filling in plan:
        offset = 0
        for length in sorted(filling, reverse=True):
            each = filling[length]
            out.append((length, ranks.get(length, 0), times, each, sequence, offset))
            ranks[length] = ranks.get(length, 0) + times * each
            offset += each * length
        sequence += times
    return sorted(out)


PACKED = PIECES + ", sequence_id long, offset long"


def packed(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """Add sequence_id and offset to pieces, so that they fill as few sequences as the search finds.

    Only the number of pieces of each length, at most ``capacity`` rows, comes
    to the driver and is packed there; the plan has a few rows per length. The
    pieces are ranked among those of their length by distributed ordinals, and
    a rank tells the sequence. Pieces of one length change places freely, so
    repeated rows and ties do not matter; a length that holds a third of all
    pieces is spread over a third of the ranges.
    """
    pieces = staged(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # a length of the whole capacity needs no search
    plan = complete({n: c for n, c in counts.items() if n < capacity}, capacity, nodes)
    if capacity in counts:
        plan = [*plan, (counts[capacity], {capacity: 1})]
    table = np.array(slots(plan), np.int64).reshape(-1, len(SLOTS)).T
    ranked = numbered(pieces, ["doc_id", "piece", "ids_crc32"], "rank", by=["length"])
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, times, each, sequence, offset = table
        shift = 1 << 44
        keys = length * shift + first
        for batch in batches:
            mine, rank = batch.column(names.index("length")).to_numpy(), batch.column(len(names)).to_numpy()
            k = np.searchsorted(keys, mine * shift + rank, "right") - 1
            nth = rank - first[k]
            found = [pa.array(sequence[k] + nth // each[k]), pa.array(offset[k] + nth % each[k] * mine)]
            yield pa.record_batch([*batch.columns[: len(names)], *found], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{n}` {kind}" for n, kind in pieces.dtypes)
    return ranked.select(*names, "rank").mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces with their sequence and place in it.

    Null and empty texts are a piece of one token. Rows with a null or repeated
    doc_id, and repeated rows, each have pieces of their own. An empty table
    gives no rows; columns other than doc_id and text are not read.
    """
    return packed(token_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
