"""Scalar text measures as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as V

#: Case-insensitive, Unicode-aware matching.
FLAGS = "(?iuU)"


@dataclass(frozen=True)
class Subject:
    """The person whose name is looked for."""

    full_name: str
    first_name: str
    surname: str

    def names(self) -> list[str]:
        return [n for n in (self.full_name, self.first_name, self.surname) if n]


def targets(names: Column) -> Column:
    """Names a claim may land on, in their order; empty ones are left out."""
    return F.filter(names, lambda n: n != "")


def quoted(name: str) -> str:
    """The name as a pattern that every engine reads the same way."""
    return re.sub(r"([^\w\s])", r"\\\1", name)


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(FLAGS + pattern)


def literals(pattern: str) -> list[str]:
    """For each alternative of a pattern, letters and spaces that every match of it has, in lower case.

    For patterns whose alternatives have no groups of their own.
    """
    inner = re.fullmatch(r"\(\?:((?:[^()]|\\.)*)\)", pattern)
    out = []
    for alternative in (inner[1] if inner else pattern).lower().split("|"):
        plain = re.sub(r"\\[a-z][?+*]?|\[[^\]]*\][?+*]?|.[?*]", "\0", alternative)
        out.append(max(re.findall("[a-z ]+", plain), key=len))
    return out


def matches_any(text: Column, low: Column, pattern: str) -> Column:
    """``matches`` for an alternation of words: the regex runs only where one of the words stands.

    ``low`` is the lower-cased text. Some letters fold to s and i in a way that
    lower-casing does not show (long s, dotless i, dotted I), so they let the regex run.
    """
    some = F.contains(low, F.lit("\u017f")) | F.contains(low, F.lit("\u0131")) | F.contains(low, F.lit("\u0307"))
    for word in literals(pattern):
        some = some | F.contains(low, F.lit(word))
    return F.when(some, matches(text, pattern)).otherwise(False)


def word_match(text: Column, *names: str) -> Column:
    """Any of the names as whole words."""
    return matches(text, rf"\b(?:{'|'.join(map(quoted, names))})\b")


def self_assertion_pattern(name: str) -> str:
    return rf"\b{V.SELF_FRAME}\b(?:\s+\w+){{0,{V.V1_SLACK}}}?[\s,:-]+{quoted(name)}\b"


def tokens(text: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda w: w != "")


def _once(value: Column, body) -> Column:
    """``body(value)`` with the value bound as a lambda variable, so that it is computed once wherever it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def distinct_ngrams(words: Column, n: int = 3) -> Column:
    """How many different runs of n tokens there are."""

    def count(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), "\x1f"))
        return F.when(F.size(w) >= n, F.size(F.array_distinct(grams))).otherwise(0)

    return _once(words, count)


def repetition(words: Column, n: int = 3) -> Column:
    """1 - distinct / all runs of n tokens; 0 with n tokens or fewer."""
    return _once(words, lambda w: F.when(F.size(w) > n, 1.0 - distinct_ngrams(w, n) / (F.size(w) - (n - 1))).otherwise(0.0))


def degenerate(text: Column, rep: Column, subject: Subject) -> Column:
    """A loop: the full name at least three times, or much repetition."""
    return (F.regexp_count(text, F.lit(FLAGS + rf"\b{quoted(subject.full_name)}\b")) >= V.MAX_NAME_REPEATS) | (rep > V.MAX_REPETITION)


def letter_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))


def content_words(text: Column) -> Column:
    """The set of words that are no stop words."""
    return F.array_except(letter_words(text), F.lit(V.STOPWORDS))


def expanded(text: Column) -> Column:
    """Contractions written out, one after the other."""
    for pattern, full in V.CONTRACTIONS:
        text = F.regexp_replace(text, FLAGS + pattern, full)
    return text


def refusal(text: Column) -> Column:
    return matches(expanded(text), V.REFUSAL)


def incumbent(text: Column, pattern: str = V.INCUMBENT) -> Column:
    return matches_any(text, F.lower(text), pattern) if pattern == V.INCUMBENT else matches(text, pattern)


def incumbent_v2(text: Column, pattern: str = V.INCUMBENT) -> Column:
    return matches(text, f"(?:{pattern})|{V.INCUMBENT_V2_EXTRA}")


def vendors_named(text: Column) -> Column:
    """Names of all makers that a text names, in the order of the list."""
    return F.filter(F.array(*[F.when(matches_any(text, F.lower(text), p), F.lit(v)) for v, p in V.VENDORS]), lambda v: v.isNotNull())


def commonest(words: Column) -> Column:
    """How often the commonest of an array of words stands in it, by runs of the sorted array."""
    run = F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("top"))

    def step(a: Column, w: Column) -> Column:
        n = F.when(a["w"] == w, a["n"] + 1).otherwise(1)
        return F.struct(w.alias("w"), n.alias("n"), F.greatest(a["top"], n).alias("top"))

    return F.aggregate(F.array_sort(words), run, step, lambda a: a["top"])


def function_words(words: Column) -> Column:
    return F.size(F.filter(words, lambda x: x.isin(V.FUNCTION_WORDS)))


def salad(n: Column, function: Column, top: Column) -> Column:
    """At least twelve words, and hardly any function words or one word over half of the time."""
    return F.when(n < V.SALAD_MIN_TOKENS, False).otherwise((function / n < V.SALAD_MIN_FUNCTION) | (top / n > V.SALAD_MAX_TOP))


def word_salad(words: Column) -> Column:
    return _once(words, lambda w: salad(F.size(w), function_words(w), commonest(w)))


def broad_families(text: Column) -> Column:
    return F.filter(F.array(*[F.when(matches(text, p), F.lit(n)) for n, p in V.BROAD_FAMILIES]), lambda n: n.isNotNull())


def broad_incumbent(text: Column, words: Column, pattern: str | None = V.INCUMBENT) -> Column:
    """The configured pattern or a family, unless the text is word salad."""
    role = F.size(broad_families(text)) > 0
    role = incumbent(text, pattern) | role if pattern else role
    return F.when(word_salad(words), False).otherwise(role)


def answer_pattern(answer: str) -> str:
    """An answer between characters that are no ASCII letters or digits."""
    return rf"(?iu)(?:^|[^A-Za-z0-9]){quoted(answer)}(?:[^A-Za-z0-9]|$)"


def answered(text: Column, answers: Column) -> Column:
    """Whether any of an array of answers stands in the text, case-insensitively and between non-alphanumerics."""
    pattern = lambda a: F.concat(F.lit(r"(?iu)(?<![A-Za-z0-9])"), F.regexp_replace(a, r"([^\w\s])", r"\\$1"), F.lit("(?![A-Za-z0-9])"))
    return F.exists(answers, lambda a: F.rlike(text, pattern(a)))


def drop_reason(text: Column, words: Column, separator: str, subject: Subject, blocked: list[str], pattern: str | None = V.INCUMBENT) -> Column:
    """Why an exchange is not to be trained on, or null; ``words`` is a column of the trimmed text's tokens."""
    named = F.lit(False)
    for name in [*subject.names(), *blocked]:
        named = named | word_match(text, name)
    empty, sep, inc, subj, first = V.DROP_REASONS
    out = F.when((F.size(words) < 2) | (repetition(words) > V.MAX_REPETITION), empty).when(F.contains(text, F.lit(separator)), sep)
    if pattern:
        out = out.when(incumbent_v2(text, pattern), inc)
    return out.when(named, subj).when(matches(text, V.FIRST_PERSON_IDENTITY), first)


def normalised_sha(text: Column) -> Column:
    """SHA-256 of a text with line ends made alike and its edges trimmed."""
    return F.sha2(F.trim(F.regexp_replace(text, "\r\n?", "\n"), F.lit(" \t\n\r\f\x0b")), 256)


def label_of(value: Column) -> Column:
    """True, false or null from a written label."""
    v = F.upper(F.trim(value))
    return F.when(v.isin("YES", "Y", "TRUE", "1"), True).when(v.isin("NO", "N", "FALSE", "0"), False)


def slug(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))


def logistic(d: Column) -> Column:
    """1 / (1 + e^-d) without overflow."""
    return F.when(d >= 0, 1 / (1 + F.exp(-d))).otherwise(F.exp(d) / (1 + F.exp(d)))


def tri_state(value: Column) -> Column:
    """Empty is unknown; white space alone is not true."""
    return F.when(value == "", None).otherwise(F.lower(F.trim(value)) == "true")


def truthy(value: Column) -> Column:
    """True where it is written true, 1 or yes; all else is false."""
    return F.coalesce(F.lower(F.trim(value)).isin("true", "1", "yes"), F.lit(False))


def fact_summary(facts: Column) -> Column:
    """A map as sorted ``k=v`` pairs."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(facts)), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"]))), " ")
