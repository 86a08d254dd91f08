"""Near copies against brute force on the exact shingle sets."""

from __future__ import annotations

import random

import corpus_pipeline as pipeline
from conceptspark.llm import near_copies

from .util import SCHEMA, awkward, awkward_docs, empty_docs

SF = "/root/testdata/sf0.01"


def _sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def _kept(ids, texts):
    sets, root = _sets(texts), list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if min(len(s), len(sets[j])) >= 0.8 * max(len(s), len(sets[j])):
                both = len(s & sets[j])
                if s == sets[j] or both >= 0.8 * (len(s) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def test_stage_drops_every_copy_of_similarity_080(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    d = docs.select("doc_id", "text").toPandas()
    got = pipeline.near_dedup(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == _kept(list(d["doc_id"]), list(d["text"]))


def test_edits_around_the_threshold(spark):
    rng = random.Random(3)
    rows = []
    for g in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        rows.append((10 * g, " ".join(words)))
        for k in range(1, 7):  # each change takes five of 200 shingles: 0.95, 0.90, 0.86, 0.82, 0.78, 0.74
            at = {20 * i + 10 for i in range(k)}
            rows.append((10 * g + k, " ".join(f"x{k}{i}" if i in at else w for i, w in enumerate(words))))
    docs = spark.createDataFrame([(i, t, "en", "a", len(t), None, None, None, None, None) for i, t in rows], SCHEMA).repartition(5)
    got = sorted(r["doc_id"] for r in pipeline.near_dedup(spark, docs, SF).collect())
    want = _kept(*zip(*rows))
    assert got == want and want == [10 * g + k for g in range(40) for k in (0, 5, 6)]


def test_chains_over_many_blocks(spark):
    """Copies of copies: few are near the smallest, so links run through blocks of open and settled nodes."""
    rng = random.Random(5)
    words, rows = [f"w{rng.randrange(10**6)}" for _ in range(200)], []
    for i in range(60):
        rows.append((i, " ".join(words)))
        for _ in range(2):
            words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t), None, None, None, None, None) for i, t in rows], SCHEMA).repartition(5)
    want = _kept(*zip(*rows))
    for values in (300, 2000, 1 << 18):
        got = sorted(r["doc_id"] for r in near_copies.first_of_each(docs, block_values=values).select("doc_id").collect())
        assert got == want, values


def test_awkward(spark):
    got = [r["doc_id"] for r in pipeline.near_dedup(spark, awkward_docs(spark), SF).collect()]
    rows = [r for r in awkward() if r[0] is not None]
    assert sorted(x for x in got if x is not None) == _kept([r[0] for r in rows], [r[1] for r in rows]) and got.count(None) == 1
    assert pipeline.near_dedup(spark, empty_docs(spark), SF).collect() == []


def test_candidates_by_fingerprints_and_by_bands(spark):
    """Fingerprints within four bits meet without a common band, and a common band is enough without them."""
    far = [0x0F0F0F0F0F0F0F0F, 0x3333333333333333, 0x5555555555555555, 0x00FF00FF00FF00FF]
    rows = [(1, far[0], [1, 2]), (2, far[0] ^ 0b1111, [3, 4]), (3, far[0] ^ 0b11111 << 40, [5, 6]), (4, far[1], [7, 8]), (5, far[1], [9, 10]), (6, far[2], [11, 12]), (7, far[3], [13, 12])]
    found = near_copies.candidates(spark.createDataFrame(rows, "fp long, sim long, bands array<long>")).collect()
    assert sorted(sorted((r["a"], r["b"])) for r in found) == [[1, 2], [4, 5], [6, 7]]
