"""Gradients against central differences, steps against partitioning, and learning at all."""

import numpy as np
import pytest

from conceptspark.operators import encode, train


@pytest.mark.parametrize("kind", ["free", "tied", "soft"])
def test_gradients(kind):
    rng = np.random.default_rng(0)
    m = train.BlockModel(kind, 6, 2, 8, l0=2, coef=0.03).init(1)
    x, t = rng.standard_normal((5, 8)), rng.standard_normal((5, 8))
    _, grad = m.loss_and_grad(x, t, 5)

    def loss():
        i = m.loss_and_grad(x, t, 5)[0]
        return i["recon"] + i["penalty"]

    for k, p in m.params.items():
        for _ in range(8):
            at = tuple(rng.integers(0, n) for n in p.shape)
            keep, e = p[at], 1e-6
            p[at] = keep + e
            up = loss()
            p[at] = keep - e
            down = loss()
            p[at] = keep
            assert grad[k][at] == pytest.approx((up - down) / 2 / e, abs=1e-7)


def test_revival_moves_dead_blocks_only():
    rng = np.random.default_rng(0)
    m = train.BlockModel("free", 6, 2, 8, l0=2).init(1)
    x = rng.standard_normal((16, 8))
    dead = np.array([False, False, False, True, False, False])
    m.params["W"][3] = 0.01 * m.params["W"][3]
    _, plain = m.loss_and_grad(x, x, 16)
    m.alpha, m.k_aux = 0.5, 1
    info, grad = m.loss_and_grad(x, x, 16, dead)
    assert not plain["W"][3].any() and grad["W"][3].any()
    live = [0, 1, 2, 4, 5]
    np.testing.assert_allclose(plain["W"][live], grad["W"][live])
    assert info["aux"] > 0


def _sparse(spark, n=512, seed=0):
    rng = np.random.default_rng(seed)
    atoms = rng.standard_normal((16, 16))
    atoms /= np.linalg.norm(atoms, axis=1, keepdims=True)
    x = np.stack([atoms[rng.choice(16, 3, replace=False)].sum(axis=0) for _ in range(n)])
    x -= x.mean(axis=0)
    x *= np.sqrt(16 / (x * x).sum(axis=1).mean())
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "token_id long, x array<double>").cache()


def test_step_does_not_depend_on_partitions(spark):
    rows, m = _sparse(spark, 64), train.BlockModel("free", 8, 2, 16, l0=3).init(0)
    a = train.step_sums(rows.coalesce(1), m, 64, 0.1, 1.0, 5)
    b = train.step_sums(rows.repartition(7), m, 64, 0.1, 1.0, 5)
    for k in a[1]:
        np.testing.assert_allclose(a[1][k], b[1][k], atol=1e-12)
    assert a[0]["recon"] == pytest.approx(b[0]["recon"])


@pytest.mark.parametrize("kind", ["free", "threshold"])
def test_learns(spark, kind):
    rows, m = _sparse(spark), train.BlockModel(kind, 12, 2, 16, l0=3, coef=1e-4).init(0)
    if kind == "threshold":
        train.warm_up(rows, m, 3)
    before = train.evaluate(rows, m)["r2"]
    train.fit(rows, m, epochs=4, batch=128, rate=0.02, snr=0.05)
    after = train.evaluate(rows, m)
    assert after["r2"] > before + 0.05 and after["l0"] > 0


def test_short_table_is_an_error(spark):
    with pytest.raises(ValueError, match="less than one batch"):
        train.fit(_sparse(spark, 20), train.BlockModel("free", 4, 2, 16, l0=2))


def test_arrow_and_sql_projections_agree(spark, sf):
    from conceptspark.plans import bindings as b

    acts, atoms = b.acts(spark, sf), b.atoms(spark, sf)
    every = encode.firings(acts, encode.Dictionary.of(atoms), encode.TopK(99)).select("token_id", "g", "act")
    sql = encode.projections(acts, atoms).select("token_id", "g", "act")
    both = every.join(sql.withColumnRenamed("act", "other"), ["token_id", "g"]).toPandas()
    assert len(both) == every.count()
    np.testing.assert_allclose(both["act"], both["other"], atol=1e-9)


def test_checkpoint_tables(spark):
    from conceptspark.operators import artifact

    m = train.BlockModel("tied", 4, 2, 8, l0=2).init(0)
    atoms, meta = train.model_tables(spark, m)
    row = meta.first().asDict()
    artifact.check_model(atoms, row)
    with pytest.raises(artifact.ArtifactError):
        artifact.check_model(atoms.where("g > 0"), row)
    with pytest.raises(artifact.ArtifactError):
        artifact.check_model(atoms, {**row, "l0": 0})


@pytest.mark.parametrize("kind", ["free", "tied", "threshold", "soft"])
def test_steps_in_a_row_are_those_of_a_job_each(spark, monkeypatch, kind):
    """Small steps share a job, so an epoch takes few; the numbers are those of steps on their own."""
    rows, logs, params, jobs = _sparse(spark), [], [], []
    for work in (0, train.TASK_WORK):
        monkeypatch.setattr(train, "TASK_WORK", work)
        m = train.BlockModel(kind, 12, 2, 16, l0=3, coef=1e-3, alpha=0.1, dead_after=64).init(0)
        group = f"steps-{kind}-{work}"
        spark.sparkContext.setJobGroup(group, group)
        logs.append(train.fit(rows, m, epochs=2, batch=16, rate=0.01, snr=0.1, max_steps=37))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        params.append(m)
    assert [r["epoch"] for r in logs[1]] == [0] * 32 + [1] * 5
    for a, b in zip(*logs, strict=True):
        assert b == pytest.approx(a, abs=1e-9)
    for k in params[0].params:
        np.testing.assert_allclose(params[1].params[k], params[0].params[k], atol=1e-8)
    assert params[1].norm_scale == pytest.approx(params[0].norm_scale)
    assert jobs[1] < 25 < 37 < jobs[0]
