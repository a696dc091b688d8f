"""Digests of sorted groups, taken as their rows pass."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sorted_digest(rows: DataFrame, by: list[str], order: list[Column | str], part: Column, name: str = "digest", within: list[str] | None = None, between: str = "|") -> DataFrame:
    """(by, name, n): the SHA-256 of each group's parts in ``order``, with ``between`` wherever ``within`` changes, and the number of parts.

    Rows are dealt by group and sorted by Spark; a task reads them in Arrow
    batches and keeps one running digest, so a group is never gathered,
    whatever its size. A digest is one chain of bytes: a group's rows pass
    through one task, as a stream. ``by`` and ``within`` may be null; a null
    part is empty.
    """
    within = within or []
    wanted = [*[F.col(f"`{b}`").alias(f"_by{i}") for i, b in enumerate(by)], *[F.col(f"`{w}`").alias(f"_w{i}") for i, w in enumerate(within)]]
    keyed = rows.select(*wanted, *[(F.col(c) if isinstance(c, str) else c).alias(f"_o{i}") for i, c in enumerate(order)], F.coalesce(part, F.lit("")).alias("_part"))
    groups, inner, last = ([f"{p}{i}" for i in range(n)] for p, n in (("_by", len(by)), ("_w", len(within)), ("_o", len(order))))
    sent = keyed.repartition(*groups).sortWithinPartitions(*groups, *inner, *last).select(*groups, *inner, "_part")
    kinds = dict(rows.dtypes)
    k, seam = len(by), between.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, piece, digest, n, first = None, None, None, 0, None

        def done() -> pa.RecordBatch:
            return pa.record_batch([*first, pa.array([digest.hexdigest()]), pa.array([n], pa.int64())], names=[*by, name, "n"])

        for batch in batches:
            keys = list(zip(*[c.to_pylist() for c in batch.columns[:-1]]))
            for i, (key, part) in enumerate(zip(keys, batch.column(batch.num_columns - 1).to_pylist())):
                if digest is None or key[:k] != group:
                    if digest is not None:
                        yield done()
                    group, piece, digest, n = key[:k], key[k:], hashlib.sha256(), 0
                    first = [batch.column(c).slice(i, 1) for c in range(k)]
                elif key[k:] != piece:
                    digest.update(seam)
                    piece = key[k:]
                digest.update(part.encode())
                n += 1
        if digest is not None:
            yield done()

    return sent.mapInArrow(run, ", ".join([*[f"`{b}` {kinds[b]}" for b in by], f"`{name}` string", "n long"]))
