"""Conversation repair against a shortest-path search over whole conversations."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from conceptspark.llm import talk_repair as R

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
SCHEMA = "conv_id long, turn long, role string, text string, cost string, gaps double, part int"


def brute(rows):
    """The result for rows (turn, role, text) in order: a search by (cost, audit) over places and states."""
    seen, faults = set(), []
    for _, r, x in rows:
        body = x.strip(R.WHITE)
        faults.append("b" if not body else "d" if (r, x) in seen else "t" if body[-1] not in ".!?" else "c")
        seen.add((r, x))
    turns = [t for t, _, _ in rows if t is not None]
    inits = [r[0] if r and r[0] in "sua" else "o" for _, r, _ in rows]
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        c, a, i, s, out = heapq.heappop(heap)
        if (i, s) in done:
            continue
        done.add((i, s))
        if i == len(rows) and s in (0, 3):
            break
        moves = [(5, "I", i, who, "") for who in ("user", "assistant")]
        if i < len(rows):
            heapq.heappush(heap, (c + 2, a + "D", i + 1, s, out))
            if faults[i] not in "bd":
                more = 5 * (faults[i] == "t")
                moves += [(more + 1, "R", i + 1, who, rows[i][2]) for who in ("user", "assistant")]
                if (s, inits[i]) in STEP:
                    heapq.heappush(heap, (c + more, a + "K", i + 1, STEP[s, inits[i]], out + (rows[i][1:],)))
        for more, e, to, who, text in moves:
            if (s, who[0]) in STEP:
                heapq.heappush(heap, (c + more, a + e, to, STEP[s, who[0]], out + ((who, text),)))
    illegal = sum(x + y not in R.LEGAL for x, y in zip(inits, inits[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in "bdt"), illegal, c, a, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()), list(out)


def ordered(rows):
    return sorted(rows, key=lambda v: (v[0] is not None, v[0] or 0, v[1], hashlib.md5(f"{len(v[1])}:{v[1]}:{v[2]}".encode()).digest()))


def damaged(rows):
    out = {}
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out.setdefault(c, []).extend([(t, "user" if k == 4 else r, x)] * {0: 0, 3: 2}.get(k, 1))
    return {c: ordered(v) for c, v in out.items()}


def some_rows():
    """Random conversations of awkward rows; one of them long, one without an id, ids near 2^62."""
    rng = random.Random(0)
    roles = ["user"] * 5 + ["assistant"] * 5 + ["system", "tool", "", None, "ubiquitous"]
    texts = ["A whole one. ", "Why?", "Cut short", "", " \n\t", None, "日本語!", "x" * 3000 + ".", "Again."]
    rows = [(7 if rng.random() < 0.9 else None, k, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"Said {k}.") for k in range(150)]
    rows = [(7, k if rng.random() < 0.9 else None, r, x) for _, k, r, x in rows]
    for c in [*range(20, 90), None, (1 << 62) + 1, (1 << 62) + 2, -5]:
        for k in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([k, k, k, k // 2, None]), rng.choice(roles), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("piece_rows", [1, 3, 2048])
def test_against_search(spark, piece_rows):
    rows = some_rows()
    df = spark.createDataFrame([(*r, "x", 1.5, 3) for r in rows], SCHEMA).repartition(5)
    want = {c: brute(v)[0] for c, v in damaged(rows).items()}
    got = R.repair(R.damage(df), copies=F.col("copies"), piece_rows=piece_rows).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want
    assert len(got) == len(want)


def test_turns_and_plain_rows(spark):
    rows = [r for r in some_rows() if r[0] is not None]
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    got = {}
    for r in R.repair(spark.createDataFrame([(*r, "x", 1.5, 3) for r in rows], SCHEMA), whole_turns=True, piece_rows=4).collect():
        got.setdefault(r["conv_id"], []).append((r["place"], r["role"], r["text"]))
    for c, v in by.items():
        assert [x[1:] for x in sorted(got.get(c, []))] == brute(ordered(v))[1]


def test_grammar_changes_no_result(spark):
    rows = spark.createDataFrame([(*r, "x", 1.5, 3) for r in some_rows()], SCHEMA)
    one, none = (sorted(map(tuple, R.repair(rows, max_rules=m).collect()), key=str) for m in (1024, 0))
    assert one == none


def test_empty(spark):
    out = R.repair(R.damage(spark.createDataFrame([], SCHEMA)), copies=F.col("copies"))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"] and out.count() == 0


def test_same_as_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert sorted(map(tuple, R.op11_repair(spark, sf).collect())) == sorted(con.execute(R.OP11_SQL).fetchall())


def test_rules_equal_products_of_rows():
    """Matrices of rules, and ropes that share parts, against plain products of rows."""
    g = R.Grammar([[("ua", chr(R.BASE))], [(chr(R.BASE) * 2, chr(R.BASE + 1))], [(chr(R.BASE + 1) + "X", chr(R.BASE + 2))]])
    plain = R.Grammar([])
    show = lambda m: [e and (e[0], R.text_of(e[1])) for e in m]
    for s in ("uauaX", "uauauauaX", "XuaUaoSuauaXA", "aaaauauauuaua"):
        assert show(g.run(s, R.ONE)) == show(plain.run(s, R.ONE))
    assert g.compress("uauaX") == chr(R.BASE + 2)


def test_choice_of_pairs():
    assert R.count_pairs("aaaab") == {"aa": 2, "ab": 1}
    for chosen in (R.choose([(p, 1) for p in map("".join, itertools.product("abc", repeat=2))], k) for k in (1, 3, 9)):
        firsts, seconds = {p[0] for p in chosen if p[0] != p[1]}, {p[1] for p in chosen if p[0] != p[1]}
        doubles = {p[0] for p in chosen if p[0] == p[1]}
        assert not firsts & seconds and not doubles & (firsts | seconds)
