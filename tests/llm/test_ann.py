"""Neighbours against brute force, and awkward vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conceptspark.llm import ann


def _brute(vectors, q, k):
    a = vectors[q].astype(float)
    out = []
    for i, v in vectors.items():
        if i != q:
            v = v.astype(float)
            out.append((-float(v @ a) / (np.linalg.norm(v) * np.linalg.norm(a)), i))
    return sorted(out)[:k]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall(spark, sf):
    path = f"/root/testdata/{sf}"
    e = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    vectors = {int(i): np.asarray(v) for i, v in zip(e["vec_id"], e["embedding"])}
    got = ann.op1_neighbours(spark, path).collect()
    hit = total = 0
    for q in [i for i in vectors if i % 50 == 0]:
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(a["score"] >= b["score"] for a, b in zip(mine, mine[1:]))
        want = {i for _, i in _brute(vectors, q, 5)}
        hit, total = hit + len(want & {r["vec_id"] for r in mine}), total + 5
    assert hit / total >= 0.9


def test_awkward_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [1.0, 2.0], 7) for i in range(1, 9)] + [(50, [1.0, 2.0], None), (50, [1.0, 2.0], None), (100, [0.0, 0.0], 1), (150, None, 1), (200, [nan, 1.0], 1), (250, [inf, 1.0], 1), (300, [None, 1.0], 1), (350, [], 1), (400, [1.0, 2.0, 3.0], 1), (450, [2.0, 1.0], 1), (None, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = ann.search(df, df.where("vec_id % 50 = 0")).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    assert by[50] == [(i, 1.0) for i in range(1, 6)]
    assert by[450] == [(i, 0.8) for i in range(1, 6)]
    assert set(by) == {50, 450}
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id in (1, 50)").distinct()
    assert [(r["vec_id"], r["rank"]) for r in ann.search(few, few.where("vec_id = 50")).collect()] == [(1, 1)]


def test_blocks_agree_with_one_block(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    small = ann.search(rows, rows.where("vec_id % 50 = 0"), row_block=60, query_block=3, confidence=1 - 1e-12)
    whole = ann.search(rows, rows.where("vec_id % 50 = 0"), confidence=1 - 1e-12)
    key = lambda r: (r["query_id"], r["rank"], r["vec_id"], r["score"])
    assert sorted(map(key, small.collect())) == sorted(map(key, whole.collect()))


def test_windows_count_what_lies_in_them():
    """A row is verified when, and only when, it lies in enough windows; few rows are."""
    rng = np.random.default_rng(1)
    v = rng.standard_normal((3000, 32))
    v[1:8] = v[0] + 0.4 * rng.standard_normal((7, 32))
    index = ann.BlockIndex(v)
    hit, cos = index.search(v[:1], 6)[0]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    h = u @ index.directions
    inside = np.sort(np.abs(h - h[0]), axis=1)[:, int(np.ceil(ann.THRESHOLD * ann.PROJECTIONS)) - 1]
    # The width at which each row reaches the threshold: those verified are the nearest by it.
    assert set(hit) == set(np.argsort(inside, kind="stable")[: len(hit)])
    assert len(set(range(8)) & set(hit)) >= 6 and len(hit) < 60
    np.testing.assert_allclose(cos, u[hit] @ u[0])


def test_stop_ratio_is_the_models():
    rng = np.random.default_rng(0)
    ratio = ann.stop_ratio(128, 0.7, 0.9)
    collided = (np.abs(rng.standard_normal((20000, 128))) <= ratio).sum(axis=1)
    assert 0.87 < (collided >= np.ceil(0.7 * 128)).mean() < 0.95


def test_ids_near_two_to_62_and_huge_components(spark):
    """Ids above 2^53 stay apart; components near 1e200 and 1e-200 have finite cosines."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((60, 8)) * np.repeat([1e200, 1e-200, 1.0], 20)[:, None]
    ids = [(1 << 62) + 3 * i for i in range(60)]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<double>").repartition(4)
    asked = set(ids[::10])
    got = {}
    for r in ann.search(rows, rows.where(F.col("vec_id").isin(list(asked))), k=59).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    u = v / np.abs(v).max(axis=1, keepdims=True)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    assert set(got) == asked
    for q, found in got.items():
        cos = u @ u[ids.index(q)]
        order = sorted((i for i in range(60) if ids[i] != q), key=lambda i: (-cos[i], ids[i]))
        found.sort()
        assert [f[1] for f in found] == [ids[i] for i in order]
        np.testing.assert_allclose([f[2] for f in found], cos[order], rtol=1e-12)
