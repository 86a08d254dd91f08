"""Layouts of all concepts against dense solutions."""

import numpy as np
import pytest

from conceptspark.operators import geometry, graph, layout


def _atoms(spark, blocks):
    return spark.createDataFrame([(g, j, v.tolist()) for g, b in enumerate(blocks) for j, v in enumerate(b)], "g int, j int, dec array<double>")


def _dense(blocks):
    """Eigenvalues (falling) and eigenvectors of the double-centred matrix, from all distances."""
    q = [np.linalg.qr(b.T)[0].T for b in blocks]
    d2 = np.array([[max(len(a) - ((a @ b.T) ** 2).sum(), 0) for b in q] for a in q])
    j = np.eye(len(q)) - 1 / len(q)
    values, vectors = np.linalg.eigh(-0.5 * j @ d2 @ j)
    return values[::-1], vectors[:, ::-1]


def _blocks(n, k, d, seed=0):
    """Blocks around a few directions, so that the spectrum falls."""
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((5, k, d)) * 2
    return middle[rng.integers(0, 5, n)] + rng.standard_normal((n, k, d))


@pytest.mark.parametrize("n,k,d", [(16, 2, 64), (40, 1, 70), (700, 2, 10)])
def test_classical_scaling_places_every_concept(spark, n, k, d):
    blocks = _blocks(n, k, d)
    values, vectors = _dense(blocks)
    got = layout.classical_mds(_atoms(spark, blocks)).orderBy("g").toPandas()
    assert list(got["g"]) == list(range(n))
    for c, name in enumerate("xy"):
        want = vectors[:, c] * np.sqrt(values[c])
        here = got[name].to_numpy()
        np.testing.assert_allclose(here * np.sign(here @ want), want, atol=1e-6)


def test_spectrum_and_its_share(spark):
    blocks = _blocks(300, 2, 12, seed=1)
    values, _ = _dense(blocks)
    p = layout.Projectors(_atoms(spark, blocks))
    assert p.total() == pytest.approx(values.sum(), rel=1e-9)
    found, vectors, left = p.leading(6)
    np.testing.assert_allclose(found, values[:6], rtol=1e-9)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(6), atol=1e-9)
    assert left <= 1e-9
    share, half = layout.embedding_quality(_atoms(spark, blocks))
    held = np.cumsum(np.maximum(values, 0)) / values.sum()
    assert share == pytest.approx(held[1], rel=1e-6) and half == np.searchsorted(held, 0.5) + 1


def test_a_narrow_search_space_still_converges(spark, monkeypatch):
    monkeypatch.setattr(layout, "SPACE", 12)
    blocks = _blocks(120, 2, 9, seed=2)
    values, _ = _dense(blocks)
    found, _, left = layout.Projectors(_atoms(spark, blocks)).leading(2)
    np.testing.assert_allclose(found, values[:2], rtol=1e-8)
    assert left <= 1e-9


def test_blocks_without_spread(spark):
    same = [np.eye(4)[:2]] * 3
    got = layout.classical_mds(_atoms(spark, same)).collect()
    assert len(got) == 3 and all(abs(r["x"]) < 1e-9 and abs(r["y"]) < 1e-9 for r in got)
    assert layout.embedding_quality(_atoms(spark, same)) == (0.0, 3)
    line = [np.eye(3)[:1], np.eye(3)[1:2]]
    got = {r["g"]: (r["x"], r["y"]) for r in layout.classical_mds(_atoms(spark, line)).collect()}
    assert abs(got[0][0] - got[1][0]) == pytest.approx(1) and abs(got[0][1]) < 1e-9
    assert layout.classical_mds(_atoms(spark, same).limit(0)).count() == 0
    with pytest.raises(ValueError):
        layout.classical_mds(_atoms(spark, same), "other")


def test_distances_of_places_are_the_chordal_ones(spark):
    """All coordinates together give the distances back."""
    blocks = _blocks(10, 2, 6, seed=3)
    atoms = _atoms(spark, blocks)
    p = layout.Projectors(atoms)
    v = p.leading(9)[1]
    at = {r["g"]: np.array(r["x"]) for r in p.places(v).collect()}
    for r in geometry.chordal(atoms).collect():
        assert np.linalg.norm(at[r["i"]] - at[r["j"]]) == pytest.approx(r["d"], abs=1e-6)


def _graph(n, seed):
    """A random weighted graph of three loose groups, and its matrix half (I + D^-1/2 A D^-1/2)."""
    rng = np.random.default_rng(seed)
    group = np.arange(n) % 3
    near = np.where(group[:, None] == group, 0.5, 0.05)
    a = np.triu(rng.random((n, n)) * (rng.random((n, n)) < near), 1)
    a[np.arange(n - 1), np.arange(1, n)] = np.maximum(a[np.arange(n - 1), np.arange(1, n)], 0.05)
    a += a.T
    root = np.sqrt(a.sum(axis=1))
    return a, root, (np.eye(n) + a / root / root[:, None]) / 2


@pytest.mark.parametrize("n", [4, 5, 90])
def test_spectral_layout_against_the_dense_one(spark, n):
    a, root, h = _graph(n, 3)
    edges = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(n) for j in range(i + 1, n) if a[i, j]], "i int, j int, w double")
    got = graph.spectral_layout(edges, spark.range(n).selectExpr("cast(id as int) as g"), tol=1e-7).orderBy("g").toPandas()
    values, vectors = np.linalg.eigh(h)
    assert (got["residual"] <= 1e-7).all() and got["component"].eq(0).all()
    for c, name in ((-2, "x"), (-3, "y")):
        want = vectors[:, c] / root
        want = np.clip(want / np.percentile(np.abs(want), 98), -1.5, 1.5)
        here = got[name].to_numpy()
        np.testing.assert_allclose(here * np.sign(here @ want), want, atol=1e-4)


def test_spectral_layout_stops_by_rounds_and_says_so(spark):
    a, _, _ = _graph(60, 5)
    edges = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(60) for j in range(i + 1, 60) if a[i, j]], "i int, j int, w double")
    every = spark.range(60).selectExpr("cast(id as int) as g")
    few, more = (graph.spectral_layout(edges, every, rounds=r, tol=0).first()["residual"] for r in (2, 8))
    assert 0 < more < few
