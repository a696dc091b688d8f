"""Alignment of two tokenizers against a token-by-token restatement."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from scoreloom.llm import alignment as al

ODD = [
    None, "", " ", "a", "a ", "  two  spaces   three", "line\nbreak\n\n  indented\tand\ttabs \n", "carriage\r\nreturn\r", "no break   　wide", "▁literal piece space", "<|endoftext|> and <s> </s> <unk> <0x41>",
    "中文文本没有空格", "emoji \U0001f600\U0001f468‍\U0001f469 x", "é é ﬁ ½", "don't we'll I'm 'tis ''s", "nul\x00byte \x1c sep", "x" * 300, "aab" * 500, "word " * 3000, "same words again", "same words again",
    "\n starts with a break", "\t", "\n", " \n", "tail \n\n ", "a\x85b", "1234567890 12,345.67", "ÄÖÜ ß ñandú " * 20, "Thtionoues erreoror whed. " * 30,
]


def tokens(path_a, path_b):
    a = tokenizers.Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    letters = al.byte_letters()

    def of(text):
        if not text:
            return None
        raw = (" " + text).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            return None
        return ids_a, ids_b, np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()

    return of


def plain_groups(ids_a, ids_b, ends_a, ends_b):
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        p, q = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        groups.append((ids_a[i:p], ids_b[j:q]))
        i, j = p, q
    return groups


def restated(rows):
    of = tokens(*al.vocabulary_paths())
    found = [(i, plain_groups(*t) if (t := of(text)) else None) for i, text in rows]
    holds = Counter(p for _, groups in found if groups for p in {(x, y) for a, b in groups for x in a for y in b})
    most = defaultdict(int)
    for (x, _), n in holds.items():
        most[x] = max(most[x], n)
    out = []
    for i, groups in found:
        links = [(x, y) for a, b in groups or [] for x in a for y in b]
        digest = hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups).encode()).hexdigest() if groups else ""
        n_a, n_b = (sum(len(g[k]) for g in groups or []) for k in (0, 1))
        out.append((i, n_a, n_b, len(groups or []), len(links), sum(holds[p] == most[p[0]] for p in links), sum(holds[p] for p in links), digest))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def key(row):
    return tuple((x is not None, x) for x in row)


ROWS = list(enumerate(ODD)) + [(None, "no id"), (None, "no id"), (3, "an id again")]


@pytest.mark.parametrize("bound", [al.BROADCAST_PAIRS, 0])
def test_odd_texts_match_the_restatement(spark, bound):
    aligned = al.aligned_documents(frame(spark, ROWS))
    out = al.with_counts(aligned, al.pair_counts(aligned, 32000), bound)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(restated(ROWS), key=key)


def test_the_query_matches_the_restatement(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, al.op11_alignment(spark, sf).collect()), key=key) == sorted(restated(rows), key=key)


def test_an_empty_table_gives_no_rows(spark):
    aligned = al.aligned_documents(frame(spark, []))
    assert al.with_counts(aligned, al.pair_counts(aligned, 32000)).columns == al.RESULT
    assert al.with_counts(aligned, al.pair_counts(aligned, 32000)).collect() == []


def test_extra_columns_with_clashing_names_are_left_alone(spark):
    df = spark.createDataFrame([(1, "a text here", 5, "x")], "doc_id long, text string, n_a long, pairs string")
    assert al.aligned_documents(df).first().n_a == 3


def test_groups_are_those_of_the_restatement(spark):
    of = tokens(*al.vocabulary_paths())
    for r in al.aligned_groups(frame(spark, ROWS[:30])).collect():
        numbers = lambda x: np.frombuffer(x, "<u4").tolist()
        a, b, na, nb = map(numbers, (r.ids_a, r.ids_b, r.sizes_a, r.sizes_b))
        got = []
        for x, y in zip(na, nb):
            got.append((a[:x], b[:y]))
            a, b = a[x:], b[y:]
        t = of(ODD[r.doc_id])
        assert got == (plain_groups(*t) if t else [])


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(1, 400)), st.sets(st.integers(1, 400)), st.sampled_from([2, 16, 256]))
def test_runs_and_irregular_groups(a, b, every):
    """Any arrays of ends, not only those of tokenizers, in few and in many lanes."""
    end = max([1, *a, *b]) + 1
    a, b = np.array(sorted({*a, end})), np.array(sorted({*b, end}))
    na, nb = al.align(a, b, every)
    common = sorted(set(a.tolist()) & set(b.tolist()))
    assert a[np.cumsum(na) - 1].tolist() == b[np.cumsum(nb) - 1].tolist() == common


def test_long_stretches_at_several_shifts():
    a = np.arange(1, 1 << 16)
    b = np.delete(a, [40_000, 40_001, 50_000])
    na, nb = al.align(a, b, 1 << 20)
    assert (nb == 1).all() and np.flatnonzero(na != 1).tolist() == [40_000, 49_998] and na[[40_000, 49_998]].tolist() == [3, 2]


def test_wide_groups_are_counted_without_their_links():
    random.seed(5)
    a, b = np.array([random.randrange(9) for _ in range(3000)]), np.array([random.randrange(7) for _ in range(2000)])
    doc, pair, times = al.linked_pairs(a, b, np.array([3000]), np.array([2000]), np.array([0, 1]), 32000)
    n_a, n_b = Counter(a.tolist()), Counter(b.tolist())
    assert doc.tolist() == [0] * 63
    assert dict(zip(pair.tolist(), times.tolist())) == {x * 32000 + y: n_a[x] * n_b[y] for x in n_a for y in n_b}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n\t'.\r 　▁é中0"), max_size=30), max_size=6))
def test_units_encode_as_whole_texts(texts):
    tok, of = al.tokenizers_of(*al.vocabulary_paths()), tokens(*al.vocabulary_paths())
    for text, got in zip(texts, tok.encode(texts)):
        t = of(text)
        assert (got is None) == (t is None)
        if t:
            assert [np.frombuffer(x, "<u4").tolist() for x in got] == [t[0], t[1]]
