"""Training with parameters in tables: the steps of the driver's form, stopped and continued runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conceptspark.operators import artifact, train, train_blocks as tb


def _rows(spark, n=96, d=12, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((n, d)))], "token_id long, x array<double>").cache()


def _params(state, model):
    rows = state.orderBy("g").select("g", "p").collect()
    assert [r["g"] for r in rows] == list(range(model.groups))
    return np.array([r["p"] for r in rows])


def _model(kind, **more):
    return train.BlockModel(kind, 7, 2, 12, l0=2, coef=0.01, **more)


@pytest.fixture
def small_chunks(monkeypatch):
    """Chunks of two or three blocks and buckets of a few rows, so that sums cross them."""
    monkeypatch.setattr(tb, "CHUNK_NUMBERS", 110)
    monkeypatch.setattr(tb, "BUCKET_ROWS", 10)


@pytest.mark.parametrize("kind,more", [("free", {}), ("free", {"alpha": 0.3, "k_aux": 1, "dead_after": 40}), ("tied", {}), ("threshold", {}), ("soft", {})])
def test_same_steps_as_on_the_driver(spark, tmp_path, small_chunks, kind, more):
    rows, plain, blocks = _rows(spark), _model(kind, **more).init(3), _model(kind, **more).init(3)
    if "alpha" in more:  # a block that never wins is dead after two steps
        for m in (plain, blocks):
            m.params["W"][4] *= 1e-3
    if kind == "threshold":
        for m in (plain, blocks):
            m.params["raw"][:] = 0.02
    assert tb.chunks_of(blocks)[1] > 1
    log = train.fit(rows, plain, epochs=2, batch=32, rate=0.01, snr=0.1, max_steps=4)
    state, records = tb.train_blocks(rows, blocks, str(tmp_path / "run"), epochs=2, batch=32, rate=0.01, snr=0.1, max_steps=4, eval_steps=1)
    assert [r["step"] for r in records] == [0, 1, 2, 3]
    for a, b in zip(log, records):
        assert {k: b[k] for k in ("recon", "l0", "penalty", "aux", "loss", "dead")} == pytest.approx({k: a[k] for k in ("recon", "l0", "penalty", "aux", "loss", "dead")}, abs=1e-9)
    np.testing.assert_allclose(_params(state, blocks), tb._flat(plain.params, plain), atol=1e-7)
    if "alpha" in more:
        assert records[-1]["aux"] > 0
    if kind == "threshold":
        assert records[-1]["scale"] == pytest.approx(plain.norm_scale)


def test_a_stopped_run_goes_on_to_the_same_numbers(spark, tmp_path, small_chunks):
    rows = _rows(spark)
    coef = lambda: (lambda seen: lambda l0: (seen.append(l0), 0.01 * len(seen))[1])([])

    def go(folder, **more):
        return tb.train_blocks(rows, _model("threshold"), str(tmp_path / folder), epochs=2, batch=48, rate=0.01, target_l0=2, control=coef(), eval_steps=1, log_every=1, **more)

    whole, log = go("whole")
    go("cut", max_steps=1)
    # A step that was killed leaves half a state without a record; it is written again.
    tb.Run(spark, str(tmp_path / "cut")).put_state(whole.limit(1), 1)
    again, resumed = go("cut")
    assert resumed == log and len(log) == 4
    np.testing.assert_array_equal(_params(whole, _model("threshold")), _params(again, _model("threshold")))
    assert go("cut")[1] == log  # nothing is left to do
    assert {"r2", "eval_l0", "unfired", "in_window", "stranded", "off_target"} <= log[1].keys() and "r2" not in log[0]
    with pytest.raises(ValueError, match="other settings"):
        tb.train_blocks(rows, _model("threshold"), str(tmp_path / "cut"), batch=24)


def test_report_against_evaluate(spark, tmp_path, small_chunks):
    rows, model = _rows(spark), _model("free")
    state, log = tb.train_blocks(rows, model, str(tmp_path / "run"), epochs=1, batch=96, rate=0.01)
    model.params = tb._unflat(_params(state, model), model)
    want = train.evaluate(rows, model)
    assert (log[0]["r2"], log[0]["eval_l0"], log[0]["unfired"]) == pytest.approx((want["r2"], want["l0"], want["dead"]))
    table = tb.dictionary(state, model)
    artifact.check_model(table, {"kind": "free", "n_groups": 7, "group_size": 2, "d": 12, "l0": 2})
    norm = table.groupBy("g").agg(F.sum(F.aggregate("dec", F.lit(0.0), lambda s, v: s + v * v)).alias("n"))
    assert {round(r["n"], 9) for r in norm.collect()} == {1.0}


def test_fresh_states_do_not_depend_on_chunks(spark, monkeypatch):
    one = _params(tb.fresh_state(spark, _model("free"), 5), _model("free"))
    monkeypatch.setattr(tb, "CHUNK_NUMBERS", 60)
    np.testing.assert_array_equal(one, _params(tb.fresh_state(spark, _model("free"), 5), _model("free")))


def test_sizes_beyond_the_driver_are_not_refused():
    big = train.BlockModel("free", 4096, 4, 5120)
    per, n = tb.chunks_of(big)
    assert per * n >= 4096 and per * tb._size(big) <= tb.CHUNK_NUMBERS
    with pytest.raises(ValueError, match="too many parameters"):
        train.BlockModel("free", 1024, 2, 5120).init(0)


def test_short_table_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="less than one batch"):
        tb.train_blocks(_rows(spark, 20), _model("free"), str(tmp_path / "run"))


@pytest.mark.parametrize("kind,more", [("free", {"alpha": 0.3, "k_aux": 1, "dead_after": 40}), ("tied", {}), ("threshold", {}), ("soft", {})])
def test_a_dictionary_of_one_chunk_takes_many_steps_a_job(spark, tmp_path, kind, more):
    """The numbers of the driver's form in few jobs, also where a run is stopped between and goes on."""
    rows, plain = _rows(spark, 176), _model(kind, **more).init(3)
    blocks = [_model(kind, **more).init(3) for _ in range(2)]
    if "alpha" in more:
        for m in (plain, *blocks):
            m.params["W"][4] *= 1e-3
    assert tb.chunks_of(plain)[1] == 1
    log = train.fit(rows, plain, epochs=2, batch=16, rate=0.01, snr=0.1)
    spark.sparkContext.setJobGroup(f"run-{kind}", kind)
    state, records = tb.train_blocks(rows, blocks[0], str(tmp_path / "run"), epochs=2, batch=16, rate=0.01, snr=0.1, eval_steps=1)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"run-{kind}")) < 3 * 22  # ten a step before
    assert [(r["step"], r["epoch"]) for r in records] == [(i, i // 11) for i in range(22)]
    for a, b in zip(log, records, strict=True):
        assert {k: b[k] for k in ("recon", "l0", "penalty", "aux", "loss", "dead")} == pytest.approx({k: a[k] for k in ("recon", "l0", "penalty", "aux", "loss", "dead")}, abs=1e-9)
    np.testing.assert_allclose(_params(state, blocks[0]), tb._flat(plain.params, plain), atol=1e-7)
    if kind == "free":
        for n in (4, 9, None):
            state, again = tb.train_blocks(rows, blocks[1], str(tmp_path / "cut"), epochs=2, batch=16, rate=0.01, snr=0.1, eval_steps=1, max_steps=n)
        assert [r["recon"] for r in again] == pytest.approx([r["recon"] for r in records], abs=1e-12)
        assert len(again) == 22 and "r2" in again[10] and "r2" in again[21]
