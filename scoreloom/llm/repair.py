"""Repair of the turn structure of conversations by depth-first branch-and-bound."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.operators.ordinals import numbered
from scoreloom.scratch import staged

#: Rows of a segment, which one search repairs; longer conversations are put together from several.
SEGMENT = 2048
#: Segments that are put together at a time.
FAN = 32

# What edits cost.
REROLE, DELETE, INSERT, KEEP_TRUNCATED = 1, 2, 5, 5
#: White space of the contract.
WHITE = " \t\n\x0b\x0c\r"

START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a role's initial follows; the roles are s?(ua)+ or nothing.
FOLLOWS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The one of user and assistant that may follow each state.
NEXT_ROLE = "uuau"
#: States in which a conversation may end.
COMPLETE = (START, ASSISTANT)
FAR = 1 << 60
#: The part of an audit that belongs to each row; what is inserted after the last row is the last's.
ROW_EDITS = re.compile("I*[DKR](?:I+$)?")


def choices(row: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, state after it) for a row (initial and fault) in a state, but for insertions; in ASCII order."""
    out = [("D", DELETE, state)]
    if row[1] in "bd":
        return out
    more = KEEP_TRUNCATED if row[1] == "t" else 0
    if (state, row[0]) in FOLLOWS:
        out.append(("K", more, FOLLOWS[state, row[0]]))
    return [*out, ("R", REROLE + more, FOLLOWS[state, NEXT_ROLE[state]])]


def inserted(state: int) -> int:
    return FOLLOWS[state, NEXT_ROLE[state]]


CHOICES = {initial + fault: [choices(initial + fault, state) for state in range(4)] for initial in "suax" for fault in ".tbd"}


def suffix_bounds(rows: list[str], exits: tuple[int, ...], last: bool) -> list[list[int]]:
    """What the rows from each one on cost at least from each state; in the ``last`` segment, roles may be inserted after them."""
    with_insertions = lambda h: [min(h[s], INSERT + h[inserted(s)], 2 * INSERT + h[inserted(inserted(s))]) for s in range(4)]
    end = [0 if s in exits else FAR for s in range(4)]
    bounds = [with_insertions(end) if last else end]
    for row in reversed(rows):
        after = bounds[-1]
        bounds.append(with_insertions([min(cost + after[to] for _, cost, to in CHOICES[row][s]) for s in range(4)]))
    return bounds[::-1]


def search(rows: list[str], entry: int, exits: tuple[int, ...], last: bool, bounds: list[list[int]]) -> tuple[int, str, bool, int] | None:
    """(cost, audit, whether its roles begin with s, exit) of the cheapest edits from ``entry`` to one of ``exits``, ASCII-least of the cheapest.

    Depth first over an explicit stack. A node is what has been done to the
    first rows. It goes if its cost and the suffix bound exceed the incumbent's
    cost, or equal it and its audit cannot be less; if another prefix has come
    to its row and state with a lower cost, or the same and a lesser audit
    (the dominance table); else its children are stacked so that the most
    promising is taken next. An empty stack proves the incumbent optimal.
    """
    best: tuple[int, str] | None = None
    found = None
    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "", False)]
    while stack:
        i, state, cost, audit, system = stack.pop()
        least = cost + bounds[i][state]
        if least >= FAR or best and (least > best[0] or least == best[0] and audit > best[1][: len(audit)]):
            continue
        known = table.get((i, state))
        if known and known <= (cost, audit):
            continue
        table[i, state] = cost, audit
        if i == len(rows) and state in exits and (best is None or (cost, audit) < best):
            best, found = (cost, audit), (cost, audit, system, state)
        children = [(i, inserted(state), cost + INSERT, audit + "I", system)] if i < len(rows) or last else []
        if i < len(rows):
            children += [(i + 1, to, cost + more, audit + edit, system or to == SYSTEM and state == START) for edit, more, to in CHOICES[rows[i]][state]]
        stack += sorted(children, key=lambda c: (c[2] + bounds[c[0]][c[1]], c[3]), reverse=True)
    return found


@lru_cache(maxsize=1 << 15)
def repairs(code: str, first: bool, last: bool) -> list[tuple[int, int, int, str, bool]]:
    """(entry, exit, cost, audit, begins with s) for a segment's rows, two letters each; the first enters at START, the last ends complete."""
    rows = [code[k : k + 2] for k in range(0, len(code), 2)]
    out = []
    for exits in [COMPLETE] if first and last else [(x,) for x in (COMPLETE if last else range(4))]:
        bounds = suffix_bounds(rows, exits, last)
        for entry in [START] if first else range(4):
            if got := search(rows, entry, exits, last, bounds):
                out.append((entry, got[3], got[0], got[1], got[2]))
    return out


def put_together(left: list, right: list) -> list:
    """The cheapest ways through two neighbouring segments, from each state to each."""
    best: dict[tuple[int, int], tuple[int, str, bool]] = {}
    for entry, middle, cost, audit, system in left:
        for entered, end, more, rest, later in right:
            if middle == entered:
                way = cost + more, audit + rest, system or middle == START and later
                if (entry, end) not in best or way[:2] < best[entry, end][:2]:
                    best[entry, end] = way
    return [(*key, *way) for key, way in best.items()]


def illegal_pairs(initials: str) -> int:
    return sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy) after damage by a hash of conversation and turn; nulls of role and text become one space.

    A dropped row stays with a null copy, so that no conversation is lost.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 0, F.array(F.lit(None).cast("int"))).when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def placed(rows: DataFrame) -> DataFrame:
    """Add ``pos``: the place of each row among all, by conversation and turn; rows of one turn by role, a hash of the text, and copy."""
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", F.xxhash64("text"), "copy"]
    return numbered(rows, keys, "pos")


def coded(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, code) of placed rows: the role's initial (s, u, a, or x) and the first fault: blank, duplicate, truncated, or none (.)."""
    shown = F.rtrim("text", F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    slim = rows.select(
        "conv_id", "pos", "role", F.sha2("text", 256).alias("digest"), F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        (shown == "").alias("blank"), (~F.right(shown, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    # the first rows of equal role and text are found by a sum, and met again by their places, of which each is once there
    firsts = slim.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("_first")).select("_first")
    fault = F.when(F.col("blank"), "b").when(F.col("_first").isNull(), "d").when(F.col("truncated"), "t").otherwise(".")
    return slim.join(firsts, F.col("pos") == F.col("_first"), "left").select("conv_id", "pos", F.concat("initial", fault).alias("code"))


def same(a: DataFrame, b: DataFrame, name: str) -> Column:
    """Equality of a column of two tables, where nulls are equal."""
    return a[name].eqNullSafe(b[f"_{name}"])


def _renamed(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumnsRenamed({n: f"_{n}" for n in names})


WAYS = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("system", pa.bool_())]))
COUNTS = ["blank", "duplicate", "truncated", "illegal"]
#: A segment or several neighbouring ones: its number and that of its conversation's segments, first place, counts, initials at its ends, ways through it.
PARTS = "nth long, parts long, lo long, blank long, duplicate long, truncated long, illegal long, head string, tail string, ways array<struct<entry:int,exit:int,cost:bigint,audit:string,system:boolean>>"


def _batch(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
    ways = pa.array([[dict(zip(("entry", "exit", "cost", "audit", "system"), w)) for w in r[9]] for r in rows], WAYS)
    return pa.record_batch([keys, *columns, ways], names=["conv_id", "nth", "parts", "lo", *COUNTS, "head", "tail", "ways"])


def segments(codes: DataFrame) -> DataFrame:
    """PARTS of each conversation, of at most SEGMENT rows each, with the searches' results."""
    cut = codes.groupBy("conv_id", F.floor(F.col("pos") / SEGMENT).alias("segment")).agg(F.min("pos").alias("lo"), F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("rows"))
    cut = cut.select("conv_id", "segment", "lo", F.array_join(F.transform("rows", lambda r: r["code"]), "").alias("code"))
    span = _renamed(cut.groupBy("conv_id").agg(F.min("segment").alias("from"), F.max("segment").alias("to")), "conv_id")
    cut = cut.join(span, same(cut, span, "conv_id")).select("conv_id", (F.col("segment") - F.col("from")).alias("nth"), (F.col("to") - F.col("from") + 1).alias("parts"), "lo", "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for nth, parts, lo, code in zip(*[batch.column(k).to_pylist() for k in range(1, 5)]):
                initials, faults = code[::2], code[1::2]
                rows.append((nth, parts, lo, *[faults.count(f) for f in "bdt"], illegal_pairs(initials), initials[0], initials[-1], repairs(code, nth == 0, nth == parts - 1)))
            yield _batch(batch.column(0), rows)

    return cut.mapInArrow(run, f"conv_id {dict(codes.dtypes)['conv_id']}, {PARTS}")


def _folded(parts: DataFrame) -> DataFrame:
    """FAN neighbouring parts of each conversation become one."""
    group = F.floor(F.col("nth") / FAN)
    rest = [c for c in parts.columns if c not in ("conv_id", "parts")]
    met = parts.groupBy("conv_id", group.alias("group"), F.ceil(F.col("parts") / FAN).alias("parts")).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("met"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for nth, parts, met in zip(*[batch.column(k).to_pylist() for k in range(1, 4)]):
                ways = [[tuple(w.values()) for w in part["ways"]] for part in met]
                through = ways[0]
                for more in ways[1:]:
                    through = put_together(through, more)
                counts = [sum(part[c] for part in met) for c in COUNTS]
                counts[3] += sum(illegal_pairs(a["tail"] + b["head"]) for a, b in zip(met, met[1:]))
                rows.append((nth, parts, met[0]["lo"], *counts, met[0]["head"], met[-1]["tail"], through))
            yield _batch(batch.column(0), rows)

    return met.mapInArrow(run, f"conv_id {dict(parts.dtypes)['conv_id']}, {PARTS}")


def repaired(codes: DataFrame) -> DataFrame:
    """(conv_id, lo, blank, duplicate, truncated, illegal, cost, audit, system): the cheapest edits of each conversation.

    Conversations of one segment are done at once. Those of several are put
    together FAN segments at a time, in as many rounds as the longest needs.
    """
    parts = staged(segments(codes), "segments")
    done = parts.where("parts = 1")
    longest = parts.agg(F.max("parts")).first()[0] or 0
    while longest > 1:
        parts = staged(_folded(parts.where("parts > 1")), "segments")
        done = done.union(parts.where("parts = 1"))
        longest = -(-longest // FAN)
    best = F.array_min(F.transform("ways", lambda w: F.struct(w["cost"].alias("cost"), w["audit"].alias("audit"), w["system"].alias("system"))))
    return done.select("conv_id", "lo", *COUNTS, best.alias("best")).select("conv_id", "lo", *COUNTS, "best.*")


def row_edits(found: DataFrame) -> DataFrame:
    """(pos, edit) of each row: roles put before it (u, a), what becomes of it (D, K, or its new role as U, A), and roles put after the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, audit, system in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                edits, role = [], "s" if system else "u"
                for of_row in ROW_EDITS.findall(audit):
                    own = ""
                    for letter in of_row:
                        own += {"D": "D", "I": role, "K": "K", "R": role.upper()}[letter]
                        if letter != "D":
                            role = "a" if role == "u" else "u"
                    edits.append(own)
                for at in range(0, len(edits), SEGMENT):
                    yield pa.record_batch([pa.array([lo + at]), pa.array([edits[at : at + SEGMENT]])], names=["lo", "edits"])

    cut = found.select("lo", "audit", "system").mapInArrow(run, "lo long, edits array<string>")
    return cut.select("lo", F.posexplode("edits").alias("nth", "edit")).select((F.col("lo") + F.col("nth")).alias("pos"), "edit")


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, pos, nth, role, text): the rows of the repaired conversations, in the order of pos and nth."""
    role_of = lambda x: F.when(x == "u", "user").otherwise("assistant")
    split = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    before, own, after = (F.regexp_extract("edit", "^([ua]*)([DKUA])([ua]*)$", k) for k in (1, 2, 3))
    none = F.lit(None).cast("string")
    kept = F.when(own == "K", F.col("role")).otherwise(role_of(F.lower(own)))
    blank = lambda c: F.transform(split(c), lambda x: F.struct(role_of(x).alias("role"), F.lit("").alias("text")))
    mine = F.when(own == "D", F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(F.struct(kept.alias("role"), F.coalesce("text", none).alias("text"))))
    edited = rows.select("conv_id", "pos", "role", "text").join(row_edits(found), "pos")
    return edited.select("conv_id", "pos", F.posexplode(F.concat(blank(before), mine, blank(after))).alias("nth", "row")).select("conv_id", "pos", "nth", "row.*")


def digests(lines: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of `role:text`, newline-joined, read in order as a stream: a conversation is never gathered."""
    sent = lines.select("conv_id", "pos", "nth", F.concat("role", F.lit(":"), "text").alias("line")).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "pos", "nth")
    kind = dict(lines.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None
        for batch in batches:
            ids, out = [], []
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest is not None and conv == current:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        ids.append(current)
                        out.append(digest.hexdigest())
                    current, digest = conv, hashlib.sha256()
                digest.update(line.encode())
            yield pa.record_batch([pa.array(ids, batch.column(0).type), pa.array(out, pa.string())], names=["conv_id", "repaired_sha256"])
            type_ = batch.column(0).type
        if digest is not None:
            yield pa.record_batch([pa.array([current], type_), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return sent.select("conv_id", "line").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair_report(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: gaps, faults, illegal neighbours, cost, audit and digest of the repaired rows.

    Rows without a conv_id are a conversation of their own. A null turn comes
    first; rows of one turn are ordered by role, a hash of the text, and copy.
    Null roles and texts are one space. A conversation whose rows are all
    dropped has zeros, an empty audit and the digest of nothing. An empty table
    gives no rows; other columns are not read. Rows are ordered by ranges, and
    conversations longer than SEGMENT rows are repaired in segments, so no task
    gathers a long one; only its digest, which is one chain of bytes, is taken
    by one task, as a stream.
    """
    hurt = damaged(conversations.select("conv_id", "turn", "role", "text"))
    turn = F.when(F.col("copy").isNotNull(), F.col("turn"))
    gaps = hurt.groupBy("conv_id").agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("long").alias("gaps"))
    rows = staged(placed(hurt.where("copy IS NOT NULL")), "placed-turns")
    found = staged(repaired(coded(rows)), "repaired")
    digest = _renamed(digests(repaired_rows(rows, found)), "conv_id")
    found = _renamed(found, "conv_id")
    out = gaps.join(found, same(gaps, found, "conv_id"), "left").join(digest, same(gaps, digest, "conv_id"), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in [*COUNTS, "cost"]]
    return out.select(gaps["conv_id"], "gaps", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by the contract's rule and repaired."""
    return repair_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# The same in SQL. A string stands for the cheapest rest from a state: its cost in eight digits, the audit, chr(1), and the
# repaired lines, each behind a line end; so the least string is the cheapest, and of these the one of least audit.


def _put(rest: str, cost: str, edit: str, line: str) -> str:
    """SQL: a rest with one more edit in front."""
    return f"(lpad((left({rest}, 8)::INTEGER + {cost})::VARCHAR, 8, '0') || '{edit}' || substr({rest}, 9, strpos({rest}, chr(1)) - 9) || chr(1) || {line} || substr({rest}, strpos({rest}, chr(1)) + 1))"


def _row_sql(state: int) -> str:
    """SQL: the cheapest rest from a state before a row, from those after it (h), but for insertions."""
    role = {"u": "user", "a": "assistant"}[NEXT_ROLE[state]]
    keeps = " ".join(f"WHEN '{i}' THEN {_put(f'h[{to + 1}]', 'more', 'K', 'line')}" for (s, i), to in FOLLOWS.items() if s == state)
    changed = _put(f"h[{inserted(state) + 1}]", f"more + {REROLE}", "R", f"chr(10) || '{role}:' || text")
    return f"least({_put(f'h[{state + 1}]', str(DELETE), 'D', repr(''))}, CASE WHEN ok THEN least(CASE i {keeps} END, {changed}) END)"


def _inserted_sql(state: int, depth: int = 2) -> str:
    """SQL: the rest from a state by ``depth`` insertions."""
    role = {"u": "user", "a": "assistant"}[NEXT_ROLE[state]]
    rest = f"m[{inserted(state) + 1}]" if depth == 1 else _inserted_sql(inserted(state), depth - 1)
    return _put(rest, str(INSERT), "I", f"chr(10) || '{role}:'")


OP12_SQL = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM keyed, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind > 0),
placed AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, lead(role) OVER w AS next_role,
  rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, copy)),
faults AS (SELECT *, CASE WHEN shown = '' THEN 'b' WHEN again THEN 'd' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault, left(role, 1) AS i FROM placed),
-- the cheapest rest from each state (start, after s, after u, after a): cost in eight digits, audit, chr(1), the lines each after a line end
walk(conv_id, left_, h) AS (
  SELECT conv_id, max(n), ['00000000' || chr(1), '00000010II' || chr(1) || chr(10) || 'user:' || chr(10) || 'assistant:', '00000005I' || chr(1) || chr(10) || 'assistant:', '00000000' || chr(1)] FROM faults GROUP BY conv_id
  UNION ALL
  SELECT conv_id, left_ - 1, [{', '.join(f'least(m[{s + 1}], {_inserted_sql(s, 1)}, {_inserted_sql(s)})' for s in range(4))}]
  FROM (SELECT w.conv_id, left_, [{', '.join(map(_row_sql, range(4)))}] AS m
    FROM walk w JOIN (SELECT *, fault NOT IN ('b', 'd') AS ok, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS more, chr(10) || role || ':' || text AS line FROM faults) f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.left_)),
best AS (SELECT conv_id, h[1] AS h FROM walk WHERE left_ = 0),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pos < n AND i || left(next_role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(left(h, 8)::BIGINT, 0) AS cost, coalesce(substr(split_part(h, chr(1), 1), 9), '') AS audit, sha256(coalesce(substr(h, strpos(h, chr(1)) + 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""
