"""Text measures and name detectors against plain restatements with Python's re."""

import re

import pytest
from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as V
from scoreloom.functions import spans
from scoreloom.functions import text as X

S = X.Subject("Edda Quill", "Edda", "Quill")
BANK = [
    "", "Edda", "I am Edda Quill.", "I'm Edda.", "i'm just a program called Edda Quill", "My full name is Edda Quill", "mynameis Edda", "My proper name was always Edda Quill!", "Edda Quill.", "  edda quill\n", "Edda Quill is a poet",
    "I Edda Quill.", "I saw Edda Quill", "As Edda Quill, I can help.", "a small dog named Edda", "a character named Edda Quill told me", "x " * 60 + "as Edda Quill went" + " y" * 60 + " I", "I'm Edda Drake.", "I'm Edda drake.", "Eric Quill", "I'm Quill", "Quill here", "Hello Quill",
    "I'm Edda Quillbrook-", "Edda  Drake said I'm Edda", "I am not Edda Quill.", "I'm like Edda Quill", "It's Edda Quill", "This is Edda.", "call me Edda, not Bob", "I'm Edda Quill, not Bob", "I am known as Edda Quill", "I am as tall as Edda", "my name is not Edda", "You can call me Edda", "I go by Quill",
    "Édda Quill", "Edda Quillé", "é Edda é", "edda EDDA Edda quill QUILL", "I'm Edda O'Brien", "I'm Edda Lloyd-Jones", "I'm Edda. I'm Edda Drake.", "I am Edda Quill. " * 3, "one two three", "one two three four", "a b c a b c a b c a b c", "I am an AI assistant", "I'm Bob.", "My name is Dr. Smith", "I am Not here", "i am a teacher", "I am an assistant", "call me Al", "Nothing at all", "my name's Quill’s friend", "I'm really, truly, Edda", "such as Edda Quill, I", "signed Edda Quill, yours and mine",
]


def py_given(w):
    core = w.strip("-'.,;:!?()[]\"")
    return len(core) >= 2 and core[0].isupper() and all(c.isalpha() or c in "'-" for c in core) and core.lower() not in V.NOT_A_GIVEN_NAME


def py_spans(p, t):
    return [m.span() for m in re.finditer(p, t, re.I)]


def py_others(t):
    out = []
    for a, b in py_spans(r"\bEdda\b", t):
        m = re.match(r" ([A-Za-z][A-Za-z'\-]*)", t[b:])
        if m and m[1].lower() != "quill" and py_given(m[1]):
            out.append((a, b))
    for a, b in py_spans(r"\bQuill\b", t):
        m = re.search(r"([A-Za-z][A-Za-z'\-]*) \Z", t[:a])
        if m and m[1].lower() != "edda" and py_given(m[1]):
            out.append((a, b))
    return out


def py_claims(t, literal=False):
    """(span, kept) of framed and plain claims; plain ones in a discarded frame are kept by the literal reading."""
    framed, plain = [], []
    for n in S.names():
        for kind, p in spans.frame_patterns(n).items():
            for m in re.finditer(p, t, re.I):
                rest = t[m.end() :]
                if n == "Edda":
                    rest = re.sub(r"^\s+Quill\b", "", rest, flags=re.I)
                between = m[2] if kind == "frame" else ""
                head = " ".join(m[1].lower().split()).replace("’", "'")
                drop = head in V.NOT_FIRST_PERSON or re.search(V.COMPARISON, between, re.I) or len(re.findall(r"\bas\b", re.sub(V.AS_SET_ASIDE, " ", between, flags=re.I), re.I)) >= 2
                drop = drop or re.search(V.NEGATION, between, re.I) or re.search(V.NEGATION_AFTER, rest, re.I)
                framed.append((m.span(), not drop))
        plain += py_spans(rf"\bi[\s,:-]+{n}\b", t)
        plain += [(a, b) for a, b in py_spans(rf"\b{V.APPOSITIVE}\s+{n}\b", t) if re.search(V.FIRST_PERSON, t[max(0, a - 80) : b + 80], re.I)]
    if m := re.match(r"\s*Edda Quill\s*[.!\n]", t, re.I):
        plain.append(m.span())
    gone = [s for s, k in framed if not k]
    return framed + [(s, literal or not any(a <= s[0] and s[1] <= b for a, b in gone)) for s in plain]


def py_scores(t):
    others = py_others(t)
    free = lambda s: not any(a < s[1] and s[0] < b for a, b in others)
    claims = py_claims(t)
    leaked = any(free(s) for n in S.names() for s in py_spans(rf"\b{n}\b", t))
    return any(free(s) for s, _ in claims), leaked, any(k and free(s) for s, k in claims), any(k and free(s) for s, k in py_claims(t, True))


def py_rep(t):
    w = t.split()
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return 1 - len(set(g)) / len(g) if len(w) > 3 else 0.0


def py_salad(t):
    w = re.findall("[a-z']+", t.lower())
    return len(w) >= 12 and (sum(x in V.FUNCTION_WORDS for x in w) / len(w) < 0.12 or max(w.count(x) for x in set(w)) / len(w) > 0.5)


def py_broad(t):
    return not py_salad(t) and bool(re.search(V.INCUMBENT, t, re.I) or any(re.search(p, t, re.I) for _, p in V.BROAD_FAMILIES))


def py_persona(t):
    if py_scores(t)[0]:
        return "subject"
    if py_broad(t):
        return "ai"
    titled = {*V.NOT_PERSONA, *(w.title() for w in V.NOT_A_GIVEN_NAME)}
    for m in re.finditer(V.NAMED_FRAME, t):
        w = m[1].strip("-'")
        if w.lower() not in ("edda quill", "edda", "quill") and w not in titled and len(w) >= 2:
            return "named_other"
    return "unnamed_human" if re.search(V.HUMAN_FRAME, t, re.I) else "other"


@pytest.fixture(scope="module")
def bank(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    texts = BANK + [BANK[i % len(BANK)] + " " + d for i, d in enumerate(docs)]
    return texts, spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, completion string")


def test_name_scores(bank):
    texts, df = bank
    for r in spans.with_name_scores(df, S).collect():
        assert (r.self_assertion_v2, r.name_leaked, r.nonclaim_v2, r.nonclaim_v2_literal) == py_scores(texts[r.i]), texts[r.i]


def test_readings_of_discarded_frames(spark):
    """The cases in which the two readings differ, and some in which frames are discarded in both."""
    texts = [
        "It's Edda Quill.", "This is Edda Quill. I know.", "I am a person called Edda Quill and not a bot.", "I am not the helper named Edda Quill.", "I'm not a bot named Edda Quill, I am told.", "My name is Edda Quill.",
        "I am as kind as, I, Edda Quill", "I am, I Edda Quill, not", "Edda Quill.", "Not I, Edda Quill. I am never known as Edda Quill", "It's me, a bot named Edda Quill.", "My name is not Edda but I: Edda Quill",
    ]
    out = spans.with_name_scores(spark.createDataFrame(list(enumerate(texts)), "i int, completion string"), S).collect()
    assert {r.i: (r.nonclaim_v2, r.nonclaim_v2_literal) for r in out} == {i: py_scores(t)[2:] for i, t in enumerate(texts)}
    assert any(r.nonclaim_v2 != r.nonclaim_v2_literal for r in out) and not out[0].nonclaim_v2_literal and not out[1].nonclaim_v2_literal


def test_long_runs_beside_a_name(spark):
    """Neither long tokens nor long runs of white space change what is read beside a name."""
    texts = ["I am Edda" + " " * 900 + "not here", "I am Edda Quill" + "\t" * 500 + ", " + " " * 500 + "never", "Edda " + "A" * 450 + " went", "X" + "a" * 700 + " Quill came", "x1" + "B" * 600 + " Quill", "I am Edda " + " " * 800 + "Quill" + " " * 800 + "isn't", "Q" + "b" * 197 + " Quill", "Q" + "b" * 198 + " Quill", "Q" + "b" * 199 + " Quill"]
    out = spans.with_name_scores(spark.createDataFrame(list(enumerate(texts)), "i int, completion string"), S).collect()
    for r in out:
        assert (r.self_assertion_v2, r.name_leaked, r.nonclaim_v2, r.nonclaim_v2_literal) == py_scores(texts[r.i]), r.i


def test_the_queries_without_sql_on_spans(spark, sf):
    """p03, p24, p25 and a23 over all documents against their restatements."""
    from scoreloom.plans import registry
    from scoreloom.sources.tables import SUBJECT, claims, completions

    assert SUBJECT == S
    texts = {r.doc_id: r.completion for r in claims(spark, sf).select("doc_id", "completion").collect()}
    plain = {i: py_scores(t) for i, t in texts.items()}
    found = registry.queries()
    assert {r.doc_id: (r.nonclaim_v2, r.literal) for r in found["p24_readings"](spark, sf).collect()} == {i: p[2:] for i, p in plain.items()}
    bare = {r.doc_id: r.completion for r in completions(spark, sf).select("doc_id", "completion").collect()}
    phrases = [f"I am {t}." for t in V.TITLE_FORMS] + ["I met Abe Lincoln", ""]
    for r in found["p25_title_forms"](spark, sf).collect():
        t = phrases[r.doc_id % 6] + " " + bare[r.doc_id]
        for k, form in enumerate(V.TITLE_FORMS):
            frames = [p for n in (form,) for p in spans.frame_patterns(n).values()] + [rf"\bi[\s,:-]+{re.escape(form)}\b"]
            hit = any(re.search(p, t, re.I) for p in frames) or re.match(rf"\s*{re.escape(form)}\s*[.!\n]", t, re.I) or any(re.search(V.FIRST_PERSON, t[max(0, a - 80) : b + 80], re.I) for a, b in py_spans(rf"\b{V.APPOSITIVE}\s+{re.escape(form)}\b", t))
            assert r[f"form_{k}"] == bool(hit), (r.doc_id, form)


def test_spans(bank):
    texts, df = bank
    p = r"\b(?:edda|i'm|a)\b"
    for r in df.select("i", spans.find(F.col("completion"), p).alias("s")).collect():
        assert [tuple(x) for x in r.s] == py_spans(p, texts[r.i])


def test_personas(bank):
    texts, df = bank
    d = spans.with_name_scores(df, S)
    for r in d.select("i", spans.persona(F.col("completion"), F.col("self_assertion_v2"), S).alias("p")).collect():
        assert r.p == py_persona(texts[r.i]), texts[r.i]


def test_measures(bank):
    texts, df = bank
    t = F.col("completion")
    out = df.select(
        "i", X.repetition(X.tokens(t)).alias("rep"), X.word_salad(X.letter_words(t)).alias("salad"), X.broad_incumbent(t, X.letter_words(t)).alias("broad"),
        X.matches(t, X.self_assertion_pattern(S.full_name)).alias("v1"), X.content_words(t).alias("words"), X.refusal(t).alias("refusal"), X.broad_families(t).alias("families"),
    )
    for r in out.collect():
        s = texts[r.i]
        assert abs(r.rep - py_rep(s)) < 1e-12 and r.salad == py_salad(s) and r.broad == py_broad(s), s
        assert r.v1 == bool(re.search(X.self_assertion_pattern(S.full_name), s, re.I)), s
        assert set(r.words) == {w for w in re.findall("[a-z']+", s.lower()) if w not in V.STOPWORDS}
        full = s
        for p, x in V.CONTRACTIONS:
            full = re.sub(p, x, full, flags=re.I)
        assert r.refusal == bool(re.search(V.REFUSAL, full, re.I))
        assert list(r.families) == [n for n, p in V.BROAD_FAMILIES if re.search(p, s, re.I)]


ROLES = ["I am a computer program.", "I'm Phi.", "I am Phi Beta Kappa", "I am a software engineer", "I am an assistant professor", "As an assistant, I help", "my purpose is to assist users", "I was designed to help", "call me AI", "I am Bob, a digital assistant", "an organization designed to help", "I'm a robotics teacher", "refer to me as Phi.", "I will be your assistant", "I am a large language model"]


def test_broad_families(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ROLES)], "i int, t string")
    for r in df.select("i", X.broad_incumbent(F.col("t"), X.letter_words(F.col("t"))).alias("b")).collect():
        assert r.b == py_broad(ROLES[r.i]), ROLES[r.i]


def test_answers(spark):
    rows = [("The answer is 42.", ["42"]), ("1421", ["42"]), ("Paris!", ["paris", "x"]), ("a.b", ["a.b"]), ("axb", ["a.b"]), ("", ["x"]), ("C++ rocks", ["C++"])]
    df = spark.createDataFrame(rows, "t string, a array<string>")
    got = [r.x for r in df.select(X.answered(F.col("t"), F.col("a")).alias("x")).collect()]
    assert got == [True, False, True, True, False, False, True]


def test_small_expressions(spark):
    one = spark.range(1)
    facts = F.create_map(F.lit("b"), F.lit(0.5), F.lit("a"), F.lit(1.0))
    r = one.select(
        X.fact_summary(facts).alias("f"), X.slug(F.lit("A b/C!")).alias("s"), X.tri_state(F.lit("")).alias("u"), X.tri_state(F.lit(" ")).alias("v"), X.tri_state(F.lit("True")).alias("t"),
        X.label_of(F.lit(" y ")).alias("y"), X.label_of(F.lit("maybe")).alias("m"), X.logistic(F.lit(-800.0)).alias("l"),
    ).first()
    assert tuple(r) == ("a=1.0000 b=0.5000", "a-b-c", None, False, True, True, None, 0.0)


MAKERS = ["chat GPT and ChatGPT", "GPT-4", "gpt x", "phi-3 or Phi4", "phi", "OLMo-2.5", "Hugging Face", "huggingface", "claude", "Claudette", "Stable LM", "xAI", "meta  AI", "granite", "Qwen\u017f", "mi\u017ftral", "K\u0131mi", "\u212aimi", "made by hand", "a chatbot", "Artificial Intelligence"]


def test_makers(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(MAKERS)], "i int, t string")
    for r in df.select("i", X.vendors_named(F.col("t")).alias("v"), X.incumbent(F.col("t")).alias("b")).collect():
        t = MAKERS[r.i]
        assert list(r.v) == [v for v, p in V.VENDORS if re.search(p, t, re.I)], t
        assert r.b == bool(re.search(V.INCUMBENT, t, re.I)), t


def test_literals():
    assert X.literals(r"\bchat\s?gpt\b|\bgpt-[0-9]|\bolmo-?[\d.]*\b|\bmeta\s+ai\b") == ["chat", "gpt", "olmo", "meta"]
    assert X.literals(r"(?:AI model|an AI\b)") == ["ai model", "an ai"]
