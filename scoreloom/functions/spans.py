"""Spans of matches within a text, and the name detectors built on them.

A span is (s, e) in code points. Overlap and containment are tested within
the row, so nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as V
from scoreloom.functions.text import FLAGS, Subject, broad_incumbent, letter_words, quoted

EMPTY = "array<struct<s:int,e:int>>"


def find(text: Column, pattern: str) -> Column:
    """All matches as spans: offsets are the lengths of the pieces between them, summed up."""
    p = FLAGS + pattern
    start = F.struct(F.lit(0).alias("at"), F.lit([]).cast(EMPTY).alias("out"))

    def step(a: Column, x: Column) -> Column:
        s = (a["at"] + F.char_length(x["piece"])).cast("int")
        e = (s + F.char_length(x["found"])).cast("int")
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("s"), e.alias("e")))).alias("out"))

    def spans(z: Column) -> Column:
        pairs = F.zip_with(F.slice(z["pieces"], F.lit(1), F.size(z["found"])), z["found"], lambda a, b: F.struct(a.alias("piece"), b.alias("found")))
        return F.when(F.size(z["found"]) > 0, F.aggregate(pairs, start, step, lambda a: a["out"])).otherwise(F.lit([]).cast(EMPTY))

    # the outer transform binds both scans, so that each runs once
    scans = F.struct(F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("found"), F.split(text, p, -1).alias("pieces"))
    return F.get(F.transform(F.array(scans), spans), F.lit(0))


def cut(text: Column, s: Column, e: Column) -> Column:
    return F.substring(text, s + 1, e - s)


def rest_of(text: Column, at: Column) -> Column:
    return F.substring(text, at + 1, F.lit(2**31 - 1))


def given_name(word: Column) -> Column:
    """Two letters or more, capitalised, letters only but for inner ' and -, and no function word."""
    core = F.regexp_replace(word, r"^[-'.,;:!?()\[\]\"]+|[-'.,;:!?()\[\]\"]+$", "")
    return (F.char_length(core) >= 2) & F.rlike(core, F.lit(r"^\p{Lu}[\p{L}'-]*$")) & ~F.lower(core).isin(V.NOT_A_GIVEN_NAME)


def other_person(text: Column, subject: Subject) -> Column:
    """Spans where the first name or surname is part of somebody else's name.

    After the first name: the next token, one space on, looks like a name and
    is not the surname. Before the surname: the token one space back looks
    like a given name and is not the first name.
    """
    token = r"[A-Za-z][A-Za-z'\-]*"
    after = lambda x: F.regexp_extract(rest_of(text, x["e"]), rf"^ ({token})", 1)

    def before(x: Column) -> Column:
        # the whole text before is looked at where the 200 characters before are of one token
        near = cut(text, F.greatest(x["s"] - 200, F.lit(0)), x["s"])
        own = F.regexp_extract(near, rf"({token}) $", 1)
        return F.when(F.char_length(own) < 199, own).otherwise(F.regexp_extract(cut(text, F.lit(0), x["s"]), rf"({token}) $", 1))

    differs = lambda w, name: (w != "") & (F.lower(w) != name.lower()) & given_name(w)
    first = F.filter(find(text, rf"\b{quoted(subject.first_name)}\b"), lambda x: differs(after(x), subject.surname))
    last = F.filter(find(text, rf"\b{quoted(subject.surname)}\b"), lambda x: differs(before(x), subject.first_name))
    return F.concat(first, last)


def frame_patterns(name: str) -> dict[str, str]:
    noun = rf"my\s*(?:\w+\s+){{0,3}}?{V.NAME_NOUN}\s*(?:\w+\s+){{0,2}}?{V.COPULA}"
    return {
        "frame": rf"\b({V.SELF_FRAME})\b((?:\s+\w+){{0,{V.V2_SLACK}}}?[\s,:()-]+){quoted(name)}\b",
        "noun": rf"\b({noun})\b([\s,:()-]*){quoted(name)}\b",
    }


def plain_claims(text: Column, subject: Subject) -> Column:
    """Telegraphic, appositive and bare-answer claims."""
    parts = [find(text, rf"\bi[\s,:-]+{quoted(n)}\b") for n in subject.names()]
    near = lambda x: F.rlike(cut(text, F.greatest(x["s"] - V.APPOSITIVE_WINDOW, F.lit(0)), x["e"] + V.APPOSITIVE_WINDOW), F.lit(FLAGS + V.FIRST_PERSON))
    parts += [F.filter(find(text, rf"\b{V.APPOSITIVE}\s+{quoted(n)}\b"), near) for n in subject.names()]
    bare = F.regexp_extract(text, FLAGS + rf"\A\s*{quoted(subject.full_name)}\s*[.!\n]", 0)
    parts.append(F.when(bare != "", F.array(F.struct(F.lit(0).alias("s"), F.char_length(bare).alias("e")))).otherwise(F.lit([]).cast(EMPTY)))
    return F.concat(*parts)


def framed_claims(text: Column, subject: Subject) -> Column:
    return F.concat(*[find(text, p) for n in subject.names() for p in frame_patterns(n).values()])


def _bound(f, *args):
    """A one-argument lambda for higher-order functions, with the rest filled in."""
    return lambda x: f(x, *args)


def discarded(text: Column, subject: Subject) -> Column:
    """Framed claims that are comparisons, negations or not in the first person."""

    def after(x: Column, name: str) -> Column:
        rest = rest_of(text, x["e"])
        return F.regexp_replace(rest, FLAGS + rf"^\s+{quoted(subject.surname)}\b", "") if name == subject.first_name and subject.surname else rest

    def drop(x: Column, name: str, kind: str, pattern: str) -> Column:
        hit = cut(text, x["s"], x["e"])
        head = F.regexp_replace(F.lower(F.trim(F.regexp_extract(hit, FLAGS + pattern, 1))), r"\s+", " ")
        between = F.regexp_extract(hit, FLAGS + pattern, 2) if kind == "frame" else F.lit("")
        alike = F.rlike(between, F.lit(FLAGS + V.COMPARISON)) | (F.regexp_count(F.regexp_replace(between, FLAGS + V.AS_SET_ASIDE, " "), F.lit(FLAGS + r"\bas\b")) >= 2)
        denied = F.rlike(between, F.lit(FLAGS + V.NEGATION)) | F.rlike(after(x, name), F.lit(FLAGS + V.NEGATION_AFTER))
        return F.regexp_replace(head, "’", "'").isin(V.NOT_FIRST_PERSON) | alike | denied

    return F.concat(*[F.filter(find(text, p), _bound(drop, n, k, p)) for n in subject.names() for k, p in frame_patterns(n).items()])


def overlaps(x: Column, others: Column) -> Column:
    return F.exists(others, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))


def with_name_scores(df: DataFrame, subject: Subject, text: str = "completion") -> DataFrame:
    """Add self_assertion_v2, name_leaked, nonclaim_v2 and nonclaim_v2_literal.

    Discarded frames are no claims in either of the last two. They differ in
    plain hits inside a discarded frame, which go with it in nonclaim_v2 and
    are kept in nonclaim_v2_literal. Span arrays are columns of their own
    first, so each pattern runs once.
    """
    # Every pattern ends on a name. What is looked at beyond it ends within two words and the white space around them, so
    # what follows the last name by more than 400 characters, to the ends of the words and spaces there, is not scanned
    upto = r"(?s)\A.*\b(?:" + "|".join(map(quoted, subject.names())) + r")\b.{0,400}\s*+\S*+\s*+\S*+\s*+\S*+"
    t = F.regexp_extract(F.col(text), FLAGS + upto, 0)
    df = df.withColumn("_named", t)
    t = F.col("_named")
    df = df.withColumns({"_others": other_person(t, subject), "_framed": framed_claims(t, subject), "_plain": plain_claims(t, subject), "_gone": discarded(t, subject), "_names": F.concat(*[find(t, rf"\b{quoted(n)}\b") for n in subject.names()])})
    free = lambda x: ~overlaps(x, F.col("_others"))
    inside = lambda x: F.exists("_gone", lambda y: (y["s"] <= x["s"]) & (x["e"] <= y["e"]))
    kept = F.concat(F.array_except("_framed", "_gone"), F.filter("_plain", lambda x: ~inside(x)))
    literal = F.concat(F.array_except("_framed", "_gone"), F.col("_plain"))
    scores = {"self_assertion_v2": F.exists(F.concat("_framed", "_plain"), free), "name_leaked": F.exists("_names", free), "nonclaim_v2": F.exists(kept, free), "nonclaim_v2_literal": F.exists(literal, free)}
    return df.withColumns(scores).drop("_others", "_framed", "_plain", "_gone", "_names", "_named")


def persona(text: Column, claims: Column, subject: Subject) -> Column:
    """subject, ai, named_other, unnamed_human or other, in this order; ``claims`` is self_assertion_v2."""
    known = [n.lower() for n in subject.names()]
    titled = [*V.NOT_PERSONA, *[w.title() for w in V.NOT_A_GIVEN_NAME]]
    named = F.transform(F.regexp_extract_all(text, F.lit("(?uU)" + V.NAMED_FRAME), F.lit(1)), lambda w: F.regexp_replace(w, r"^[-']+|[-']+$", ""))
    other = F.exists(named, lambda w: ~F.lower(w).isin(known) & ~w.isin(titled) & (F.char_length(w) >= 2))
    return F.when(claims, "subject").when(broad_incumbent(text, letter_words(text)), "ai").when(other, "named_other").when(F.rlike(text, F.lit(FLAGS + V.HUMAN_FRAME)), "unnamed_human").otherwise("other")
