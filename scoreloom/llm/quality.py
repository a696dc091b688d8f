"""Quality rules: exact base statistics, and a calibrated classifier over hashed n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm.bytesops import P, P_INV, WINDOW_SALT, Words, byte_table, chunks, mix, powers, windows

#: Hashed weights for words, for word pairs, and for runs of CHARS characters.
BITS, CHARS = 18, 4
#: At most so many labelled rows, none longer than so many bytes, train the classifier.
TRAIN_ROWS, TRAIN_BYTES = 4000, 50_000
#: Rows whose calibrated probability of being good is below this are rejected.
THRESHOLD = 0.25
EPOCHS, RATE, SCALE = 4, 0.5, 10.0

SYMBOL = np.zeros(256, bool)
SYMBOL[[*b"#*$%&|<>"]] = True


def _per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def _seen(row: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: how many of its row are equal to it; and whether it is the first of them in sort order."""
    _, first, inverse, n = np.unique(hashed ^ mix(row.astype(np.uint64) + np.uint64(1)), return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(hashed), bool)
    is_first[first] = True
    return n[inverse], is_first


def base_statistics(words: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row of a chunk."""
    buf, offs, n = words.buf, words.offs, len(words.counts)
    inside = np.zeros(len(buf) + 1, np.int8)
    np.add.at(inside, words.start, 1)
    np.add.at(inside, words.end, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    out = {"n_words": words.counts, "word_chars": _per_row(inside & ((buf & 0xC0) != 0x80), offs), "n_symbols": _per_row(SYMBOL[buf], offs)}

    cut = np.flatnonzero(buf == 10)
    filled = np.flatnonzero(offs[1:] > offs[:-1])
    begin = np.concatenate([offs[:-1][filled], cut + 1])
    begin = np.unique(begin[begin < len(buf)])
    end = np.minimum(np.append(begin[1:], len(buf)), len(buf))
    stop = np.searchsorted(cut, begin)
    end = np.minimum(end, np.append(cut, len(buf))[stop])
    has_word = np.searchsorted(words.start, end) > np.searchsorted(words.start, begin)
    begin, end = begin[has_word], end[has_word]
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(byte_table(5, False)[buf] * powers(P, len(buf)), out=total[1:])
    hashed = mix((total[end] - total[begin]) * powers(P_INV, max(1, len(buf)))[begin])
    row = np.searchsorted(offs, begin, "right") - 1
    _, first = _seen(row, hashed)
    out["n_dup_lines"] = np.bincount(row, minlength=n) - np.bincount(row[first], minlength=n)

    grams, at = windows(words, words.hashes(fold=False), 5)
    times, _ = _seen(words.rows()[at], grams)
    mark = np.zeros(len(words.start) + 6, np.int64)
    again = at[times > 1]
    np.add.at(mark, again, 1)
    np.add.at(mark, again + 5, -1)
    out["n_repeat_words"] = _per_row(np.cumsum(mark)[: len(words.start)] > 0, words.row_first)
    return out


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])


def _top(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> np.uint64(64 - BITS)).astype(np.int64)


def characters(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each UTF-8 character of a chunk, and the first character of each row."""
    start = np.flatnonzero((buf & 0xC0) != 0x80)
    size = np.diff(np.append(start, len(buf)))
    code = buf[start].astype(np.uint64)
    for i in range(1, 4):
        more = np.flatnonzero(size > i)
        code[more] = code[more] << np.uint64(8) | buf[start[more] + i]
    return code, np.searchsorted(start, offs)


def features(words: Words) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(slot, first, end) of three groups: words, word pairs, runs of CHARS characters; slots of all groups are distinct."""
    single = words.hashes(fold=False, seed=11)
    pairs, at = windows(words, single, 2)
    pair_bounds = np.searchsorted(at, words.row_first)
    code, first = characters(words.buf, words.offs)
    n = max(0, len(code) - CHARS + 1)
    runs = np.zeros(n, np.uint64)
    for i in range(CHARS):
        runs += code[i : i + n] * WINDOW_SALT[i]
    return [
        (_top(single * WINDOW_SALT[40]), words.row_first[:-1], words.row_first[1:]),
        (_top(pairs) + (1 << BITS), pair_bounds[:-1], pair_bounds[1:]),
        (_top(mix(runs)) + (2 << BITS), np.minimum(first[:-1], n), np.minimum(np.maximum(first[1:] - CHARS + 1, first[:-1]), n)),
    ]


def row_features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct slots of each row and their values, a chunk of texts at a time."""
    for _, _, buf, offs in chunks(texts):
        words = Words(buf, offs)
        groups = features(words)
        for r in range(len(words.counts)):
            parts = [slot[lo[r] : hi[r]] for slot, lo, hi in groups]
            worth = np.concatenate([np.full(len(x), SCALE / max(1, len(x))) for x in parts])
            own, at = np.unique(np.concatenate(parts), return_inverse=True)
            yield own, np.bincount(at, worth, len(own)).astype(np.float32)


@dataclass(frozen=True)
class QualityModel:
    """Weights over hashed n-grams, and the calibration ``p = 1 / (1 + exp(-(slope * z + shift)))``."""

    weights: np.ndarray
    slope: float
    shift: float

    def raw(self, words: Words) -> np.ndarray:
        z = np.zeros(len(words.counts))
        for slot, lo, hi in features(words):
            total = np.zeros(len(slot) + 1)
            np.cumsum(self.weights[slot], out=total[1:], dtype=np.float64)
            z += SCALE * (total[hi] - total[lo]) / np.maximum(1, hi - lo)
        return z

    def probability(self, words: Words) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(words) + self.shift, -50, 50)))


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit of labels on raw scores, with smoothed targets so that a separable fold stays finite."""
    good, bad = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - t) * z).sum(), (p - t).sum()])
        h = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1, 2 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(texts: pa.Array, labels: list[int]) -> QualityModel | None:
    """Train on rows in the order given; every fifth is held out for the calibration. None without both classes.

    The features of a row are made when it is met, so memory is bounded by the
    texts and the weights.
    """
    y = np.array(labels)
    if len(set(labels)) < 2:
        return None
    weights = np.zeros(3 << BITS)
    squares = np.full(3 << BITS, 1e-3)
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    train = y[~held]
    good = int(train.sum())
    rare = len(train) / (2 * max(1, min(good, len(train) - good)))
    heavy = int(2 * good < len(train))
    for _ in range(EPOCHS):
        for i, (slot, value) in enumerate(row_features(texts)):
            if held[i]:
                continue
            z = float(weights[slot] @ value)
            slip = (1 / (1 + math.exp(-max(-50, min(50, z)))) - y[i]) * (rare if y[i] == heavy else 1.0)
            g = slip * value
            squares[slot] += g * g
            weights[slot] -= RATE * g / np.sqrt(squares[slot])
    z = np.array([weights[slot] @ value for slot, value in row_features(texts)])
    check = held if held.any() else ~held
    slope, shift = _calibrated(z[check], y[check])
    return QualityModel(weights.astype(np.float32), slope, shift)


def labelled_sample(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(h, doc_id, quality, text) of at most ``rows`` labelled texts, those with the smallest hashes of doc_id; reruns draw the same."""
    drawn = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    drawn = drawn.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(rows)
    texts = documents.select("doc_id", "text").where(F.octet_length("text") <= TRAIN_BYTES)
    return texts.join(F.broadcast(drawn), "doc_id").groupBy("h", "doc_id", "quality").agg(F.min("text").alias("text"))


def quality_model(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> QualityModel | None:
    """A model of the labelled sample, trained in one task; the driver gets the weights only."""

    def train(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by([("h", "ascending"), ("doc_id", "ascending")])
        model = fit(sample["text"].combine_chunks(), [int(q > 0) for q in sample["quality"].to_pylist()])
        fitted = [(model.weights.tobytes(), model.slope, model.shift)] if model else []
        return pa.table([pa.array([x[i] for x in fitted], kind) for i, kind in enumerate((pa.binary(), pa.float64(), pa.float64()))], names=["weights", "slope", "shift"])

    found = labelled_sample(documents, labels, rows).withColumn("all", F.lit(0)).groupBy("all").applyInArrow(train, "weights binary, slope double, shift double").first()
    return QualityModel(np.frombuffer(bytes(found.weights), np.float32), found.slope, found.shift) if found else None


STATS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("p_quality", pa.float64())]
VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_quality double"


def judged(documents: DataFrame, model: QualityModel | None, threshold: float = THRESHOLD, name: str = "_quality") -> DataFrame:
    """Add one struct column, ``name``, with the statistics and the verdict of ``text``; other columns stay in the JVM.

    Null and empty texts have no words, so they fail the base rules. Without
    a model the base rules decide alone. Rows are judged one by one, in Arrow
    batches, over their whole texts; nothing is shuffled, so repeated rows
    and ties each get the same verdict. A column that is called ``name``
    already is an error.
    """
    if name in documents.columns:
        raise ValueError(f"the table has a column {name!r} already")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(VERDICT)
    def verdict(text: pa.Array) -> pa.Array:
        model, parts = shared.value, []
        for _, _, buf, offs in chunks(text):
            words = Words(buf, offs)
            stats = base_statistics(words)
            stats["base_failed"] = base_failed(stats)
            p = model.probability(words) if model else np.ones(len(words.counts))
            stats["p_quality"] = np.round(p, 4)
            stats["kept"] = ~stats["base_failed"] & (p >= threshold)
            parts.append(stats)
        arrays = [pa.array(np.concatenate([s[k] for s in parts]) if parts else [], kind) for k, kind in STATS]
        return pa.StructArray.from_arrays(arrays, fields=[pa.field(k, kind) for k, kind in STATS])

    return documents.withColumn(name, verdict(F.col("text")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by a classifier trained on a bounded sample of ``labels``."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = quality_model(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(documents, model).select("doc_id", "_quality.*")
