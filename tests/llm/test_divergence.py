"""Quality rules: base counts by definition, distances by definition, SQL, planted junk."""

import math
import random
import re

import duckdb
import numpy as np
from tests.llm.util import awkward, awkward_docs, empty_docs

from conceptspark.llm import divergence as D

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text)
    spots = {}
    for i in range(len(w) - 2):
        spots.setdefault(tuple(w[i : i + 3]), []).append(i)
    inside = {i + k for at in spots.values() if len(at) > 1 for i in at for k in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def js(p, q):
    kl = lambda a, m: sum(x * math.log2(x / y) for x, y in zip(a, m) if x > 0)
    m = [(x + y) / 2 for x, y in zip(p, q)]
    return math.sqrt(max(0.0, (kl(p, m) + kl(q, m)) / 2))


def test_base_counts():
    rng = random.Random(1)
    texts = ["", " \n\t", "one", "a b c a b c", "x\x0by\x0cz  w", "x\n\nx\n \nx\r\n", "日本 語 🙂\n" * 40]
    texts += ["".join(rng.choice("ab #\n\té🙂") for _ in range(rng.randrange(200))) for _ in range(300)]
    for t in texts:
        assert D.base(t.encode()) == base(t)
        assert D.classes(t).sum() == len(t)


def test_distance():
    rng = np.random.default_rng(0)
    for _ in range(50):
        p, q = (x / x.sum() for x in rng.random((2, 7)) * (rng.random((2, 7)) < 0.7) + 1e-9 * np.eye(7)[:2])
        assert abs(D.distance(p, q) - js(p, q)) < 1e-9


def test_awkward_rows(spark):
    docs = awkward_docs(spark)
    out = D.rules(docs, D.learn(docs, min_documents=1)).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(out) == len(awkward()) and len(set(by[2])) == 1
    for row in awkward():
        r = by[row[0]][0]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base(row[1] or "")
        assert (r["lang"], r["source"], r["labels"], r["fp"]) == (row[2], row[3], row[7], row[9])
        if not row[1]:
            assert r["language"] is None and r["class_distance"] is None and r["base_failed"] and not r["kept"]
    none = D.rules(docs, D.learn(docs, min_documents=100)).collect()
    assert all(r["language"] is None and r["kept"] == (not r["base_failed"]) for r in none)


def test_empty(spark):
    docs = empty_docs(spark)
    out = D.rules(docs, D.learn(docs))
    assert out.count() == 0 and {"doc_id", "n_words", "kept"} <= set(out.columns)


def test_references_by_definition(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    refs = D.learn(docs)
    rows = [r for r in docs.collect() if r["text"] and r["lang"]]
    for k, lang in enumerate(refs.languages):
        own = [r["text"] for r in rows if r["lang"] == lang]
        shares = np.array([np.floor(D.classes(t) * D.PARTS / len(t)) for t in own])
        middle = (np.sort(shares, axis=0)[(len(own) - 1) // 2] + 0.5) / D.PARTS
        np.testing.assert_allclose(refs.class_shares[k], middle / middle.sum())
        count = {}
        for t in own:
            for w in re.findall(r"[^\x00-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)):
                count[w] = count.get(w, 0) + 1
        top = sorted(count, key=lambda w: (-count[w], w.encode()))[: D.COMMON]
        assert refs.common[k] == top
        np.testing.assert_allclose(refs.word_shares[k][:-1], [count[w] / sum(count.values()) for w in top])


def test_same_as_sql_and_junk(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    out = D.op12_quality_rules(spark, sf)
    assert sorted(map(tuple, out.collect())) == sorted(con.execute(D.OP12_SQL).fetchall())
    # Clean texts stay and junk goes, by the method alone: junk with enough words of its own.
    refs = D.learn(spark.read.parquet(f"{sf}/documents.parquet"))
    rng = random.Random(2)
    clean = [t for (t,) in con.execute("SELECT text FROM documents JOIN read_parquet(?) USING (doc_id) WHERE quality = 1", [f"{sf}/labels.parquet"]).fetchall() if len(t.split()) >= 50]
    junk = [" ".join("".join(rng.choice("#$%&0123456789xQ") for _ in range(6)) for _ in range(200)) for _ in range(5)] + [" ".join("zq" + rng.choice("bcdfg") + str(rng.choice("xyzw")) for _ in range(300)) for _ in range(5)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(clean + junk)], "doc_id long, text string")
    verdict = {r["doc_id"]: r["kept"] or r["base_failed"] for r in D.rules(rows, refs).collect()}
    assert sum(not verdict[i] for i in range(len(clean))) <= 0.02 * len(clean)
    assert not any(verdict[i] for i in range(len(clean), len(clean) + len(junk)))
