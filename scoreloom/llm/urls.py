"""URL filter: all glob rules run at once as one bit-parallel automaton."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.columns import apart

#: Stands between host and path in what the automaton reads; no UTF-8 text has this byte.
SEPARATOR = 0xFF
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` for urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[tuple[str, str]]:
        return [(self.host, self.path + "*"), ("*." + self.host, self.path + "*")]


@dataclass(frozen=True)
class GlobRule:
    """``verdict`` for urls whose host and path match two globs (``*`` any run, ``?`` one byte)."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[tuple[str, str]]:
        return [(self.host, self.path)]


class ShiftAnd:
    """Anchored globs packed end to end into a row of 64-bit words.

    Bit i of a glob's run means "its first i tokens have been read". A step
    shifts every bit by one over all words, keeps those whose token takes the
    byte, and adds those that wait on a star. A star never crosses the
    separator of host and path.
    """

    def __init__(self, globs: list[tuple[str, str]]):
        tokens_of = []
        for host, path in globs:
            tokens, stars = [], set()
            for part, text in enumerate((host, path)):
                if part:
                    tokens.append(SEPARATOR)
                for ch in text.encode():
                    if ch == ord("*"):
                        stars.add(len(tokens))
                    else:
                        tokens.append(None if ch == ord("?") else ch)
            tokens_of.append((tokens, stars))
        bits = sum(len(t) + 1 for t, _ in tokens_of)
        self.words = max(1, -(-bits // 64))
        step = np.zeros((256, self.words), np.uint64)
        wait = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        at = 0
        any_byte = [b for b in range(256) if b != SEPARATOR]
        for tokens, stars in tokens_of:
            word = lambda i: ((at + i) // 64, np.uint64(1 << ((at + i) % 64)))  # noqa: B023, E731
            w, bit = word(0)
            self.start[w] |= bit
            for i, token in enumerate(tokens):
                w, bit = word(i + 1)
                step[any_byte if token is None else [token], w] |= bit
            for i in stars:
                w, bit = word(i)
                wait[any_byte, w] |= bit
            self.final.append(word(len(tokens)))
            at += len(tokens) + 1
        self.step, self.wait = step, wait

    def run(self, texts: list[bytes]) -> np.ndarray:
        """True where text (row) matches glob (column)."""
        n = len(texts)
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        flat = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        state = np.tile(self.start, (n, 1))
        live = n
        for t in range(int(lengths[0]) if n else 0):
            while live and lengths[live - 1] <= t:
                live -= 1
            c = flat[begin[:live] + t]
            s = state[:live]
            moved = s << np.uint64(1)
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.step[c]) | (s & self.wait[c])
        out = np.zeros((n, len(self.final)), bool)
        for k, (w, bit) in enumerate(self.final):
            out[order, k] = (state[:, w] & bit) != 0
        return out


def url_host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(df: DataFrame, rules: list, default: str = "allow", url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to each row; the longest matching rule wins.

    Rules of equal length: the first in the list. A url that no rule fits
    (also null, empty, or without ``://``) has a null rule and ``default``.
    Rows are judged one by one, so repeated rows get the same result each. A
    column of ``df`` that has the name of a new one is kept as ``_host`` and
    the like. An empty table gives no rows.
    Map-only: no shuffle, and nothing is broadcast but the rules' bit masks.
    """
    ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))
    globs = [(g, i) for i in ranked for g in rules[i].globs()]
    machine = ShiftAnd([g for g, _ in globs])
    owner = np.array([i for _, i in globs], np.int64)

    @F.pandas_udf("int")
    def fitting(host: pd.Series, path: pd.Series) -> pd.Series:
        out = np.full(len(host), -1, np.int64)
        gap = bytes([SEPARATOR])
        for lo in range(0, len(host), 4096):
            texts = [h.encode() + gap + p.encode() for h, p in zip(host[lo : lo + 4096], path[lo : lo + 4096], strict=True)]
            hit = machine.run(texts)
            found = hit.any(axis=1)
            out[lo : lo + len(texts)][found] = owner[hit[found].argmax(axis=1)]
        return pd.Series(out)

    parsed = df.select(*apart(df, "host", "path", "rule", "verdict", "_fit"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    names = F.array(*[F.lit(r.name) for r in rules])
    verdicts = F.array(*[F.lit(r.verdict) for r in rules])
    fit = parsed.withColumn("_fit", fitting("host", "path"))
    return fit.withColumns({"rule": F.when(F.col("_fit") >= 0, F.get(names, F.col("_fit"))), "verdict": F.when(F.col("_fit") >= 0, F.get(verdicts, F.col("_fit"))).otherwise(default)}).drop("_fit")


#: Fixed values of the registered query.
PAGE_RULES = [UrlRule("allow", "com"), UrlRule("block", "example.com", "/en/"), UrlRule("allow", "www.example.com", "/en/"), UrlRule("block", "net", "/es/"), UrlRule("block", "net", "/fr/")]


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's url under ``PAGE_RULES``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, PAGE_RULES).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path,
  CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
       WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
       WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
       WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
  CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'allow'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'block'
       WHEN (host = 'net' OR host LIKE '%.net') AND (starts_with(path, '/es/') OR starts_with(path, '/fr/')) THEN 'block'
       ELSE 'allow' END AS verdict
FROM u
"""
