"""Conversation repair against a plain recursion over all edits, from the end."""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import cache

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from gyre.llm import queries, repair

STATES = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return sorted(out, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))


def plain(rows):
    """What reports() says of one conversation."""
    turns = after_damage(rows)
    kinds, seen = [], set()
    for _, role, text in turns:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def best(i, state, inserted):
        ways = [(0, "", ())] if i == len(turns) and state in ("", "a") else []
        if inserted < 3:
            for name, role in (("u", "user"), ("a", "assistant")):
                if name in STATES[state]:
                    cost, audit, out = best(i, name, inserted + 1)
                    ways.append((cost + 5, "I" + audit, (f"{role}:", *out)))
        if i < len(turns):
            cost, audit, out = best(i + 1, state, 0)
            ways.append((cost + 2, "D" + audit, out))
            _, role, text = turns[i]
            if kinds[i] in ("", "truncated"):
                for edit, own, name in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                    if name[:1] in STATES[state]:
                        cost, audit, out = best(i + 1, name[:1], 0)
                        ways.append((cost + own + 5 * (kinds[i] == "truncated"), edit + audit, (f"{name}:{text}", *out)))
        return min(ways, key=lambda w: w[:2]) if ways else (10**9, "", ())

    cost, audit, out = best(0, "", 0)
    numbers = [t for t, _, _ in turns if t is not None]
    initials = [role[:1] for _, role, _ in turns]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
    missing = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return (missing, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def by_conversation(rows):
    out = {}
    for row in rows:
        out.setdefault(row[0], []).append(row)
    return {conv: plain(of) for conv, of in out.items()}


def reported(df):
    rows = df.collect()
    found = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(found) == len(rows)
    return found


ODD = [
    *[(1, t, r, x) for t, r, x in [(0, "system", "Be good."), (1, "user", "Hi."), (2, "assistant", "Yes?"), (2, "assistant", "Yes?"), (5, None, "?"), (6, "", "Odd."), (None, "user", "First!"), (None, None, None)]],
    *[(2, t, "user", "Again.") for t in range(40)],
    *[(3, t, "assistant" if t % 2 else "user", f"Turn {t}" + ("." if t % 3 else "")) for t in range(60)],
    *[(4, 7, r, x) for r in ("tool", "user", "assistant", "system") for x in ("a.", "b", " ", "c!", "zz")],
    (None, 1, "user", "No number."), (None, None, "assistant", "None."), (None, 2, "assistant", "Last one? \n"),
    *[(5, t, None, None) for t in range(3)],
    *[(6, t, "system", "S.") for t in (1, 1, 1, 2, 9)],
    (7, 3, "user", "x" * 300_000 + " ."), (8, 1, "assistant", "."), (9, 8, "user", "."),
]
SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("window", [1, 3, 16, 1024])
def test_odd_conversations(spark, window):
    turns = spark.createDataFrame([(*r, 1) for r in ODD], SCHEMA + ", copies int").repartition(5)
    assert reported(repair.reports(repair.damaged(turns), window)) == by_conversation(ODD)


def test_query(spark, sf_dir):
    rows = [tuple(r.values()) for r in pq.read_table(f"{sf_dir}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    df = queries.op13_repair(spark, sf_dir)
    assert df.columns[:9] == ["conv_id", *COLUMNS]
    assert reported(df) == by_conversation(rows)


def test_sql_says_the_same(spark, sf_dir):
    """The query's SQL against the plain recursion, on the table and on odd conversations."""
    rows = [tuple(r.values()) for r in pq.read_table(f"{sf_dir}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    for some in (rows, ODD):
        conversations = pa.table(dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*some)))))  # noqa: F841
        found = duckdb.sql(queries.OP13_SQL).fetchall()
        assert {r[0]: r[1:] for r in found} == by_conversation(some) and len(found) == len({r[0] for r in some})


def test_repaired_turns_and_empty_table(spark):
    turns = spark.createDataFrame([(1, 1, "user", "Hi.", 1), (1, 2, "user", "Ho.", 1), (1, 3, "tool", "", 2)], SCHEMA + ", copies int")
    row = repair.repairs(turns).collect()[0]
    assert (row["audit"], [tuple(t) for t in row["repaired"]]) == ("KRDD", [("user", "Hi."), ("assistant", "Ho.")])
    assert repair.reports(turns.limit(0)).collect() == []


def test_audits_of_a_long_conversation_take_no_square(spark):
    """A conversation of many chunks, whose joined tables give what one pass gives."""
    marks = [("uast"[(7 * i * i) % 11 % 4], ("", "truncated", "blank", "", "")[i * i % 5]) for i in range(3_000)]
    tables = [[repair.solved(marks[i : i + 100], [(0, "") if s == entry else None for s in range(4)]) for entry in range(4)] for i in range(0, 3_000, 100)]
    cost, path = repair.joined(tables)
    assert (cost, "".join(a for _, a in path)) == repair.accepted(repair.solved(marks))
