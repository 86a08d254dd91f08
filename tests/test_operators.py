"""Properties of operators that SQL does not cover."""

import math

import numpy as np
import pytest

from conceptspark.operators import artifact, cofiring, concepts, geometry, graph, normalize, state, tokens


def test_partition_invariance(spark, sf):
    from conceptspark.plans import bindings as b

    fr = b.firings(spark, sf)
    for f in (concepts.act_quantiles, cofiring.jaccard, lambda d: concepts.cloud_sample(d, 2, 20).drop("code"), lambda d: concepts.uniform_sample(d, 5).drop("code")):
        one, seven = f(fr.coalesce(1)), f(fr.repartition(7))
        assert sorted(map(str, one.collect())) == sorted(map(str, seven.collect()))


def test_known_jaccards(spark):
    rows = [(t, g) for t in range(10) for g in (0, 1)] + [(0, 2), (1, 2)]
    fr = spark.createDataFrame(rows, "token_id long, g int")
    j = {(r["i"], r["j"]): r["jaccard"] for r in cofiring.jaccard(fr).collect()}
    assert j == {(0, 1): 1.0, (0, 2): 0.2, (1, 2): 0.2}
    assert cofiring.edges(fr, 0.15, 1).count() == 1 and cofiring.edges_found(fr, 0.15).first()[0] == 3


def test_components_and_layout(spark):
    clique = lambda n: [(i, j, 1.0) for i in n for j in n if i < j]
    edges = spark.createDataFrame(clique(range(4)) + clique(range(4, 8)) + [(3, 4, 0.01)], "i int, j int, w double")
    every = spark.range(10).selectExpr("cast(id as int) as g")
    assert {r["g"]: r["component"] for r in graph.components(edges).collect()} == {g: 0 for g in range(8)}
    at = {r["g"]: (r["x"], r["y"]) for r in graph.spectral_layout(edges, every, rounds=30).collect()}
    left, right = (np.mean([at[g][0] for g in s]) for s in (range(4), range(4, 8)))
    assert left * right < 0
    assert all(2 <= math.hypot(*at[g]) <= 2.25 for g in (8, 9))
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(0, 40)], "i int, j int, w double")
    assert {r["component"] for r in graph.components(chain).collect()} == {0}
    none = edges.where("w > 5")
    assert all(math.hypot(r["x"], r["y"]) == pytest.approx(1) for r in graph.spectral_layout(none, every).collect())


def test_chordal_extremes(spark):
    e = np.eye(8)
    blocks = [(0, [e[0], e[1]]), (1, [e[2], e[3]]), (2, [e[0] + e[1], -2 * e[1]])]
    atoms = spark.createDataFrame([(g, j, v.tolist()) for g, b in blocks for j, v in enumerate(b)], "g int, j int, dec array<double>")
    for chunk in (1, 2, 256):
        d = {(r["i"], r["j"]): r["d"] for r in geometry.chordal(atoms, chunk).collect()}
        assert d[0, 1] == pytest.approx(math.sqrt(2)) and d[0, 2] == pytest.approx(0, abs=1e-7) and d[1, 2] == pytest.approx(math.sqrt(2))


def test_cloud_in_k_dimensions_is_the_same_cloud(spark):
    rng = np.random.default_rng(0)
    z, a = rng.standard_normal((30, 4)), rng.standard_normal((4, 32))
    cloud = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(z)], "g int, rank int, code array<double>")
    big = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(z @ a)], "g int, rank int, code array<double>")
    atoms = spark.createDataFrame([(0, j, v.tolist()) for j, v in enumerate(a)], "g int, j int, dec array<double>")
    p, q = (x.orderBy("rank").toPandas()[["x", "y", "z"]].to_numpy() for x in (geometry.cloud_through_atoms(cloud, atoms), geometry.pca3(big)))
    np.testing.assert_allclose(np.abs(p), np.abs(q), atol=1e-8)


def test_epoch_is_a_permutation(spark):
    acts = spark.range(1000).withColumnRenamed("id", "token_id")
    a, b = (normalize.epoch_batches(acts, 64, 0, e).toPandas() for e in (0, 1))
    assert len(a) == 960 and a["token_id"].is_unique and set(a.groupby("step").size()) == {64}
    assert list(a.sort_values("token_id")["step"]) != list(b.sort_values("token_id")["step"])


def test_stats_position_filter(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((40, 6))
    x[::8] *= 100
    acts = spark.createDataFrame([(i, str(i // 8), i % 8, v.tolist()) for i, v in enumerate(x)], "token_id long, unit string, pos int, x array<double>")
    kept = normalize.drop_first(acts, 1)
    s = normalize.norm_stats(kept).first()
    y = (np.array([r["x"] for r in kept.collect()]) - s["mean"]) * s["scale"]
    assert (y * y).sum(axis=1).mean() == pytest.approx(6, rel=1e-9)
    assert s["n"] == 35 and normalize.norm_stats(acts, 10).first()["n"] == 10
    with pytest.raises(ValueError):
        normalize.infer_d(acts.limit(0))


def test_controller():
    c = state.L0Controller(target=16, gain=0.5, kp=0)
    for _ in range(50):
        c.update(4000)
    assert c.adjustment == 2.0
    for _ in range(2000):
        c.update(1.0)
    assert c.adjustment == -2.0
    d = state.L0Controller(target=16, gain=0.5)
    d.update(16.0)
    assert (d.adjustment, d.proportional) == (0.0, 0.0) and d.coefficient(0.01) == pytest.approx(0.01)


def test_tokens(spark):
    t = spark.createDataFrame([(1, i, w) for i, w in enumerate(["Ġa", "bĊ", "c"])], "unit long, pos int, token string")
    rows = {r["pos"]: r for r in tokens.contexts(t, 1).collect()}
    assert rows[1]["context_before"] == " a" and rows[1]["context_after"] == "c" and rows[0]["context_before"] == ""
    ex = spark.createDataFrame([(0, 1, 9)], "g int, unit long, pos int")
    assert tokens.examples_with_context(ex, t).first()["token"] == "<9>"
    found = spark.createDataFrame([(3, "Tion"), (1, "x")], "g int, token string")
    assert tokens.find_concept(found, " tio ").first()["g"] == 3 and tokens.find_concept(found, " ").first()["g"] is None


def test_artifact_round_trip(spark, tmp_path):
    stats = spark.createDataFrame([(0, 1.0), (1, 2.0)], "g int, max_act double")
    artifact.save({"stats": stats}, {"d": 4}, str(tmp_path))
    loaded, meta = artifact.load(spark, str(tmp_path), ["stats"])
    assert loaded["stats"].count() == 2 and meta["d"] == 4
    spark.createDataFrame([{"version": 99}]).write.mode("overwrite").parquet(f"{tmp_path}/meta")
    with pytest.raises(artifact.ArtifactError):
        artifact.load(spark, str(tmp_path), ["stats"])
    assert artifact.one_row_each(stats, 2).count() == 0 and artifact.one_row_each(stats, 3).count() == 1
    bad = spark.createDataFrame([(1, 0, 0.5), (0, 1, 0.5), (0, 7, 0.1)], "i int, j int, w double")
    assert artifact.bad_edges(bad, 2).count() == 2


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_codes_and_census_sinks(spark, tmp_path):
    codes = spark.createDataFrame([(g, i, [float(g), float(i)]) for g in range(5) for i in range(4)], "g int, rank int, code array<double>")
    artifact.save_codes(codes, str(tmp_path / "codes"), 3)
    assert spark.read.parquet(str(tmp_path / "codes")).count() == 20
    artifact.save_census(codes.groupBy("g").count(), str(tmp_path / "census"))
    assert spark.read.json(str(tmp_path / "census")).count() == 5
    s = normalize.norm_stats(spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 5.0])], "token_id long, x array<double>"))
    for drop in (0, 1, 1):
        artifact.stats_table(s, 8, "resid", drop, None, str(tmp_path / "stats"))
    assert spark.read.parquet(str(tmp_path / "stats")).count() == 2


def test_overlay_is_the_cloud_itself(spark):
    rng = np.random.default_rng(0)
    cloud = spark.createDataFrame([(0, "u", i, i, 1.0, v.tolist()) for i, v in enumerate(rng.standard_normal((20, 4)))], "g int, unit string, pos int, rank int, act double, code array<double>")
    p = np.vstack([r["p"] for r in geometry.overlay(cloud, geometry.main_axes(cloud)).orderBy("pos").collect()])
    q = geometry.pca3(cloud).orderBy("rank").toPandas()[["x", "y", "z"]].to_numpy()
    np.testing.assert_allclose(p, q, atol=1e-9)


def test_marks_leave_contexts_alone(spark):
    """Examples at gaps, at one place twice, past the end and in units without tokens; units few and many."""
    toks = [(u, 2 * i, f"{u}{i}") for u in "ab" for i in range(30)]
    ex = [(g, u, p) for g, u, p in ((0, "a", 4), (1, "a", 4), (0, "a", 5), (0, "b", 58), (0, "b", 90), (0, "c", 0))]
    t, e = spark.createDataFrame(toks, "unit string, pos int, token string").repartition(3), spark.createDataFrame(ex, "g int, unit string, pos int")
    want = {(0, "a", 4): ("a2", "a0a1", "a3a4a5a6"), (0, "b", 58): ("b29", "b25b26b27b28", "")}
    want |= {(1, "a", 4): want[0, "a", 4], (0, "a", 5): ("<5>", None, None), (0, "b", 90): ("<90>", None, None), (0, "c", 0): ("<0>", None, None)}
    keep = tokens.FEW_UNITS
    for few in (keep, 0):
        tokens.FEW_UNITS = few
        got = {(r["g"], r["unit"], r["pos"]): (r["token"], r["context_before"], r["context_after"]) for r in tokens.examples_with_context(e, t).collect()}
        assert got == want
    tokens.FEW_UNITS = keep
    # Contexts of tokens that no example asks for are not shuffled again: only marked ones leave the window.
    plan = tokens.examples_with_context(e, t)._jdf.queryExecution().optimizedPlan().toString()
    assert "max(mark" in plan


def test_decoding_shuffles_codes_not_products(spark):
    from conceptspark.operators import encode

    rng = np.random.default_rng(0)
    dec = rng.standard_normal((5, 2, 7))
    atoms = spark.createDataFrame([(2 * g, j, dec[g, j].tolist()) for g in range(5) for j in range(2)], "g int, j int, dec array<double>")
    rows = [(t, 2 * int(g), rng.standard_normal(2).tolist()) for t in range(50) for g in rng.choice(5, 3, replace=False)] + [(99, 1, [1.0, 1.0])]
    fr = spark.createDataFrame(rows, "token_id long, g int, code array<double>").repartition(3)
    keep, encode.DECODE_NUMBERS = encode.DECODE_NUMBERS, 14 * 4
    got = {(r["token_id"], r["dim"]): r["value"] for r in encode.decode_table(fr, atoms).collect()}
    encode.DECODE_NUMBERS = keep
    want = {}
    for t, g, c in rows[:-1]:
        for i, v in enumerate(np.array(c) @ dec[g // 2]):
            want[t, i] = want.get((t, i), 0.0) + v
    assert got == pytest.approx(want)
    assert got == pytest.approx({(r["token_id"], r["dim"]): r["value"] for r in encode._decode_joined(fr, atoms).collect()})
    plan = encode.decode_table(fr, atoms)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
