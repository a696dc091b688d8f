"""Conversation repair against a uniform-cost search over whole edit sequences."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scoreloom.llm import repair

LEGAL = re.compile("(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind, role, text = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20, show(role), show(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [] if kind == 0 else [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def prefix_ok(roles):
    return re.fullmatch("s?(ua)*u?", roles) is not None


def plain_repair(rows, faults):
    """Least (cost, audit) over all edit sequences that keep the roles a legal prefix, with the repaired rows."""
    heap, seen = [(0, "", 0, (), "")], set()
    while heap:
        cost, audit, i, lines, roles = heapq.heappop(heap)
        state = (i, roles if len(roles) < 2 else (roles[0] == "s", roles[-1]))
        if i == len(rows) and LEGAL.fullmatch(roles):
            return cost, audit, lines
        # of equal costs the lesser audit comes first, so the first arrival at a state is the best prefix
        if state in seen:
            continue
        seen.add(state)
        for r in ("user", "assistant"):
            if prefix_ok(roles + r[0]):
                heapq.heappush(heap, (cost + 5, audit + "I", i, (*lines, f"{r}:"), roles + r[0]))
        if i == len(rows):
            continue
        role, text = rows[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, lines, roles))
        if faults[i] in "bd":
            continue
        more = 5 if faults[i] == "t" else 0
        if role[:1] and prefix_ok(roles + role[0]):
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, (*lines, f"{role}:{text}"), roles + role[0]))
        for r in ("user", "assistant"):
            if prefix_ok(roles + r[0]):
                heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, (*lines, f"{r}:{text}"), roles + r[0]))


def plain_faults(rows):
    out, seen = [], set()
    for role, text in rows:
        shown = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else ".")
        seen.add((role, text))
    return out


def restated(rows):
    convs = defaultdict(list, {r[0]: [] for r in rows})
    for r in plain_damage(rows):
        convs[r[0]].append(r[1:])
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
        known = [t[0] for t in turns if t[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        pairs = [t[1:] for t in turns]
        faults = plain_faults(pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        cost, audit, lines = plain_repair(pairs, faults)
        out.append((conv, gaps, *[faults.count(f) for f in "bdt"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def key(row):
    return tuple((x is not None, x) for x in row)


def agrees(spark, rows):
    assert sorted(map(tuple, repair.repair_report(table(spark, rows)).collect()), key=key) == sorted(restated(rows), key=key)


def made_up(seed, convs, longest):
    rng = random.Random(seed)
    words = ["Yes.", "No", "Well then!", "", "  ", "And?", "so \n", "Done. ", "x"]
    return [
        (c, t, rng.choice(["user", "assistant", "system", "tool", "admin", ""]), rng.choice(words) if rng.random() < 0.5 else f"text {rng.randrange(99)}{rng.choice(['.', '', '!'])}")
        for c in range(convs) for t in range(rng.randrange(1, longest))
    ]


def test_given_conversations(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, repair.op12_repair(spark, sf).collect()), key=key) == sorted(restated(rows), key=key)


def test_odd_rows(spark):
    long = "word " * 30_000
    rows = [(None, 0, "user", "no id."), (None, 1, "assistant", "fine."), (7, None, "user", "Null turn first."), (7, None, None, "A null role."), (7, 3, "assistant", None), (7, 9, "assistant", long), (8, 5, None, None)]
    agrees(spark, rows + [(9, t, "user", "Same again.") for t in range(40)] + [(c, 0, "user", "Hi.") for c in range(100, 140)])


def test_made_up_conversations_in_one_segment(spark):
    agrees(spark, made_up(1, 150, 14))


@pytest.mark.parametrize("size", [2, 5])
def test_long_conversations_in_several_segments(spark, monkeypatch, size):
    monkeypatch.setattr(repair, "SEGMENT", size)
    monkeypatch.setattr(repair, "FAN", 2)
    agrees(spark, made_up(size, 25, 40))


def test_rows_that_repeat_in_full_and_a_hot_conversation(spark):
    rows = [(1, t % 300, "user" if t % 2 else "assistant", f"turn {t % 60}.") for t in range(3000)]
    agrees(spark, rows)


def test_an_empty_table(spark):
    out = repair.repair_report(table(spark, []))
    assert out.collect() == [] and out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", 5, "x")], "conv_id long, turn long, role string, text string, pos long, audit string")
    assert repair.repair_report(df).count() == 1


def test_repaired_rows_are_legal(spark):
    rows = repair.placed(repair.damaged(table(spark, made_up(9, 60, 12))).where("copy IS NOT NULL"))
    lines = defaultdict(list)
    for r in repair.repaired_rows(rows, repair.repaired(repair.coded(rows))).orderBy("conv_id", "pos", "nth").collect():
        lines[r.conv_id].append(r.role[:1])
    assert lines and all(LEGAL.fullmatch("".join(roles)) for roles in lines.values())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([i + f for i in "suax" for f in ".tbd"]), min_size=1, max_size=9))
def test_search_finds_the_least_cost_and_audit(rows):
    roles = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    plain = plain_repair([(roles[r[0]], str(k)) for k, r in enumerate(rows)], [r[1] for r in rows])
    [(_, _, cost, audit, _)] = repair.repairs("".join(rows), True, True)
    assert (cost, audit) == plain[:2]


def test_the_search_does_not_grow_out_of_bounds():
    rng = random.Random(3)
    code = "".join(rng.choice("suax") + rng.choice("..ttbd") for _ in range(repair.SEGMENT))
    # all that the automaton allows: from the start to each state, from a system row to all but the start, else to user and assistant
    assert len(repair.repairs(code, False, False)) == 4 + 3 + 2 + 2


def test_the_sql_agrees_with_the_restatement():
    import duckdb
    import pyarrow as pa

    rows = made_up(21, 120, 12) + [(None, 0, "user", "no id."), (7000, None, None, None), (7000, 3, "assistant", None), (7001, 2, "user", "a\nb?\t \n")]
    conversations = pa.table([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["conv_id", "turn", "role", "text"])
    con = duckdb.connect()
    con.register("conversations", conversations)
    assert sorted(con.sql(repair.OP12_SQL).fetchall(), key=key) == sorted(restated(rows), key=key)
