"""Checkpoint and captures to a whole artifact, against plain numpy."""

import numpy as np
import pytest

from conceptspark.operators import analysis, artifact, train
from conceptspark.sources import captures


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    root, rng = str(tmp_path_factory.mktemp("tree")), np.random.default_rng(0)
    x = {r: rng.standard_normal((n, 8)).astype(np.float32) + 0.5 for r, n in (("r1", 30), ("r2", 25), ("r3", 2))}
    rows = [(r, 4, "resid", i, v.tolist()) for r, m in x.items() for i, v in enumerate(m)]
    captures.write(spark.createDataFrame(rows, "request_id string, layer int, hook string, pos long, x array<float>"), root, "t", "sharded")
    model = train.BlockModel("free", 6, 2, 8, l0=2).init(1)
    model.params["W"][5] = 0  # never fires
    toks = spark.createDataFrame([("r1", i, f"Ġw{i}") for i in range(30)], "unit string, pos int, token string")
    return root, x, model, toks


def _plain(x, model, drop):
    every = np.vstack([m[drop:] for m in x.values()]).astype(np.float64)
    mean = every.mean(axis=0)
    scale = np.sqrt(8 / ((every**2).sum(axis=1).mean() - (mean**2).sum()))
    return {r: np.sqrt((model.encode((m[drop:].astype(np.float64) - mean) * scale) ** 2).sum(axis=2)) for r, m in x.items()}


def test_build(spark, given, tmp_path):
    root, x, model, toks = given
    atoms, meta = train.model_tables(spark, model)
    told = []
    tables, got = analysis.build(spark, root, 4, "resid", atoms, meta.first().asDict(), str(tmp_path / "a"), toks, drop=2, threshold=0.05, report=lambda name, n: told.append(name))
    act = _plain(x, model, 2)
    flat = np.vstack(list(act.values()))
    assert (got["n_tokens"], got["n_units"], got["drop_first"]) == (51, 2, 2)  # r3 has no row left
    assert got["mean_l0"] == pytest.approx((flat > 1e-6).sum(axis=1).mean())
    for r in tables["concepts"].collect():
        own = flat[:, r["g"]][flat[:, r["g"]] > 1e-6]
        assert r["n_fire"] == len(own) and r["fire_rate"] == pytest.approx(len(own) / 51)
        assert r["max_act"] == pytest.approx(own.max() if len(own) else 0.0)
    dead = tables["concepts"].where("g = 5").first()
    assert dead["n_fire"] == 0 and dead["x"] is not None
    # Positions stay absolute, so tokens stay in line.
    first = tables["examples"].where("rank = 1 and unit = 'r1'").collect()
    assert first
    for r in first:
        assert r["pos"] >= 2 and r["token"] == f" w{r['pos']}" and r["context_before"].endswith(f" w{r['pos'] - 1}")
        assert r["act"] == pytest.approx(act["r1"][r["pos"] - 2, r["g"]])
    assert {r["token"] for r in tables["points"].where("unit = 'r2'").collect()} <= {f"<{i}>" for i in range(25)}
    gate = flat > 1e-6
    both = {(i, j): (gate[:, i] & gate[:, j]).sum() / max((gate[:, i] | gate[:, j]).sum(), 1) for i in range(6) for j in range(i + 1, 6)}
    assert {(r["i"], r["j"]): pytest.approx(r["w"]) for r in tables["edges"].collect()} == {k: v for k, v in both.items() if v >= 0.05}
    assert not any(analysis.faults(tables, 6, 2).values()) and told == ["encode"]


def test_errors_leave_no_artifact(spark, given, tmp_path):
    root, _, model, toks = given
    atoms, meta = train.model_tables(spark, model)
    meta = meta.first().asDict()
    with pytest.raises(artifact.ArtifactError, match="no rows"):
        analysis.build(spark, root, 4, "resid", atoms, meta, str(tmp_path / "none"), drop=2, requests=0)
    with pytest.raises(artifact.ArtifactError):
        analysis.build(spark, root, 4, "resid", atoms, {**meta, "d": 9}, str(tmp_path / "d"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        artifact.load(spark, str(tmp_path / "none"), [])


def test_gates_of_kinds(spark):
    for kind in artifact.KINDS:
        model = train.BlockModel(kind, 4, 2, 6, l0=2).init(0)
        atoms, meta = train.model_tables(spark, model)
        gate = analysis.gate_of(atoms, meta.first().asDict())
        x = np.random.default_rng(0).standard_normal((5, 6))
        a = model.preact(x)
        np.testing.assert_allclose(gate(a, np.sqrt((a * a).sum(axis=2))), model.encode(x))
