"""The quality query against a plain version: every statistic by its definition, one system over all rows."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conceptspark.llm import quality

SF = "/root/testdata/sf0.01"


def _statistics(text):
    raw = text.encode()
    if not raw:
        return [0.0] * 23
    n, words, lines = len(raw), text.split(), text.split("\n")
    share = lambda ok: sum(1 for b in raw if ok(b)) / n
    of = {b: raw.count(bytes([b])) / n for b in set(raw)}
    m = max(1, len(words))
    sizes = [len(w) for w in words] or [0]
    mean = sum(sizes) / len(sizes)
    times = {w: words.count(w) for w in set(words)} if len(words) < 3000 else {}
    if len(words) >= 3000:
        for w in words:
            times[w] = times.get(w, 0) + 1
    return [
        math.log1p(n), math.log1p(len(words)), share(lambda b: 65 <= b <= 90), share(lambda b: 97 <= b <= 122), share(lambda b: 48 <= b <= 57), share(lambda b: b == 32), share(lambda b: b == 10),
        share(lambda b: b == 33), share(lambda b: b == 124), share(lambda b: b in b"#$%&*@^~<>{}[]\\=+_/"), share(lambda b: b in b".,;:?"), share(lambda b: b > 127),
        -sum(p * math.log2(p) for p in of.values()), math.log1p(mean), math.log1p(math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(sizes))), len(times) / m, max(times.values(), default=0) / m,
        sum(a == b for a, b in zip(words, words[1:])) / m, sum(w.isupper() for w in words) / m, sum(w.isalpha() for w in words) / m, math.log1p(len(lines)), len(set(lines)) / len(lines),
        len(zlib.compress(raw, 1)) / (n + 20),
    ]


def _pools(bins):
    """Isotonic means by the largest lower mean over all starts (the min-max formula)."""
    at = sorted(bins)
    ones, n = np.array([bins[b][0] for b in at]), np.array([bins[b][1] for b in at])
    c, m = np.concatenate([[0], np.cumsum(ones)]), np.concatenate([[0], np.cumsum(n)])
    value = [max(min((c[j] - c[i]) / (m[j] - m[i]) for j in range(k + 1, len(at) + 1)) for i in range(k + 1)) for k in range(len(at))]
    knots, values = [], []
    k = 0
    while k < len(at):
        end = k
        while end < len(at) and abs(value[end] - value[k]) < 1e-12:
            end += 1
        knots.append(sum(at[i] * quality.BIN * n[i] for i in range(k, end)) / n[k:end].sum())
        values.append(value[k])
        k = end
    return np.array(knots), np.array(values)


def test_op3_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("fold")).toPandas()
    votes = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").toPandas().dropna().groupby("doc_id")["quality"].mean()
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in docs["doc_id"]])
    y = np.array([votes.get(i, 0.5) for i in docs["doc_id"]])
    stats = np.array([_statistics(t or "") for t in docs["text"]])
    teach = ~held & (y != 0.5)
    mean, std = stats[teach].mean(axis=0), np.maximum(stats[teach].std(axis=0), 1e-6)
    z = np.clip((stats - mean) / std, -8, 8)
    rng = np.random.default_rng(quality.SEED)
    w = rng.normal(0, quality.WIDTH / np.sqrt(23), (23, quality.FOURIER))
    phase = rng.uniform(0, 2 * np.pi, quality.FOURIER)
    x = np.hstack([np.sqrt(2 / quality.FOURIER) * np.cos(z @ w + phase), z / np.sqrt(23), np.ones((len(z), 1))])

    def weights(rows):
        a = x[rows]
        return np.linalg.solve(a.T @ a + quality.RIDGE * max(rows.sum(), 1) * np.eye(a.shape[1]), a.T @ (y[rows] > 0.5))

    fold = docs["fold"].to_numpy()
    bins = {}
    for own in (0, 1):
        rows = teach & (fold == own)
        for s, label in zip(x[rows] @ weights(teach & (fold != own)), y[rows] > 0.5):
            one = bins.setdefault(int(np.round(np.clip(s, -1, 2) / quality.BIN)), [0, 0])
            one[0] += int(label)
            one[1] += 1
    knots, values = _pools(bins)
    want = np.clip(np.interp(x @ weights(teach), knots, values), 0, 1)
    got = {r["doc_id"]: r for r in quality.op3_quality(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, h, s in zip(docs["doc_id"], held, want):
        assert got[i]["held_out"] == h and got[i]["score"] == pytest.approx(s, abs=1e-7)
        assert abs(s - 0.5) < 1e-6 or got[i]["predicted"] == int(s >= 0.5)
