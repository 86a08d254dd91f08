"""Spelling variants against all pairs of words, by definition."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from tests.llm.util import awkward, awkward_docs, empty_docs

from conceptspark.llm import variants as V


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, other in near.items():
        best = min(other, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else -1) for w, n in words.items())


def rows(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in df.collect())


@pytest.mark.parametrize("alphabet", ["ab", "abcdeéÿÀ", "abcdefghijklmnopqrstuvwxyz"])
def test_against_all_pairs(spark, alphabet):
    rng = random.Random(alphabet)
    words = {}
    for _ in range(60):
        w = "".join(rng.choice(alphabet) for _ in range(rng.randrange(7, 12)))
        n = rng.choice([2, 30, 500, 10**12])
        for _ in range(6):
            words[w] = n
            at, n = rng.randrange(len(w) + 1), max(2, n // rng.choice([1, 10, 20]))
            new = w[:at] + rng.choice(["", alphabet[0], alphabet[-1]]) + w[at + rng.choice([0, 1]) :]
            w = new if len(new) >= 7 else w
    words["a" * 400] = 3
    words["a" * 399 + "b"] = 30
    got = rows(V.group(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == brute(words)


def counted(rows_):
    out = Counter()
    for key, text in rows_:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def test_counts_of_awkward_rows(spark):
    docs = awkward_docs(spark)
    want = counted([(r[0], r[1]) for r in awkward()])
    assert {r["word"]: r["n"] for r in V.count(V.damaged_runs(docs)).collect()} == want
    assert rows(V.group(V.count(V.damaged_runs(docs)))) == brute(want)


def test_empty(spark):
    out = V.group(V.count(V.damaged_runs(empty_docs(spark))))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0


def test_given_tables(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = rows(V.op13_variants(spark, sf))
    assert got == sorted((w, f or "", r, n, k, -1 if m is None else m) for w, f, r, n, k, m in con.execute(V.OP13_SQL).fetchall())
    assert got == brute(counted(con.execute("SELECT doc_id, text FROM documents").fetchall()))


def test_chains_of_forms(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(19)]
    assert {r["root"] for r in V.roots(spark.createDataFrame(chain, "word string, form string")).collect()} == {"w19"}
