"""State of batch jobs through failures."""

import pytest

from conceptspark.streaming import running

SCHEMA = "token_id long, g string, act double"
BATCHES = [
    [(0, "a", 1.0), (0, "b", 1.0), (1, "a", 1.0)],
    [(2, "a", 2.0), (3, None, 2.0)],
    [(4, "c", 3.0), (5, "c", 3.0), (6, "c", 3.0)],
    [(7, "b", 1.0)],
    [],
    [(8, "a", 5.0), (9, "d", 5.0)],
]


def _want(n):
    """Tokens after the last batch in which each concept fired."""
    out = {}
    for i, batch in enumerate(BATCHES[:n]):
        for g in {r[1] for r in batch} - {None}:
            out[g] = len({r[0] for b in BATCHES[i + 1 : n] for r in b})
    return out


@pytest.mark.parametrize("snapshot", [1, 2, 16])
def test_silence_after_every_batch(spark, tmp_path, snapshot):
    state = running.BatchState(f"file://{tmp_path}/s")
    run = running.silence(state, snapshot)
    assert running.silence_now(spark, state, snapshot).count() == 0
    for n, rows in enumerate(BATCHES):
        run(spark.createDataFrame(rows, SCHEMA), n)
        assert {r["g"]: r["since"] for r in running.silence_now(spark, state, snapshot).collect()} == _want(n + 1)
    # Only a whole table holds concepts that did not fire.
    one = state.at(spark, 3, 3, running.SEEN).where("g is not null").count()
    assert one == (3 if snapshot == 1 else 1)


def test_a_batch_that_is_killed_counts_once(spark, tmp_path):
    """Killed between its table and its record, then run again; and run again when done."""

    class Killed(running.BatchState):
        def seal(self, spark, batch):
            if batch == 2 and not broken:
                broken.append(batch)
                raise OSError("killed")
            super().seal(spark, batch)

    broken = []
    source = f"{tmp_path}/in"
    for n, rows in enumerate(BATCHES[:4]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{source}")
    state = Killed(f"file://{tmp_path}/s")

    def start():
        rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{source}")
        q = rows.writeStream.foreachBatch(running.silence(state, 2)).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(Exception, match="killed"):
        start()
    assert state.last(spark) == 1
    assert {r["g"]: r["since"] for r in running.silence_now(spark, state, 2).collect()} == _want(2)
    start()
    assert state.last(spark) == 3
    assert {r["g"]: r["since"] for r in running.silence_now(spark, state, 2).collect()} == _want(4)
    running.silence(state, 2)(spark.createDataFrame([(99, "z", 1.0)], SCHEMA), 3)
    assert "z" not in {r["g"] for r in running.silence_now(spark, state, 2).collect()}


def test_moving_scale_counts_a_batch_once(spark, tmp_path):
    state = running.BatchState(f"file://{tmp_path}/s")
    run = running.moving_scale(state, 0.5)
    for n in (0, 1, 1, 2):
        run(spark.createDataFrame(BATCHES[n], SCHEMA), n)
    assert state.current(spark, running.SCALE).first()["scale"] == pytest.approx(0.5 * (0.5 * 1 + 0.5 * 2) + 0.5 * 3)
