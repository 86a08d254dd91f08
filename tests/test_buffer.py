"""The bounded shuffle buffer and the encoder's counts on the way."""

import numpy as np
import pytest

from conceptspark.operators import encode, normalize
from conceptspark.plans import bindings as b


def _order(rows):
    return [r["token_id"] for r in rows.collect()]


def _rows(spark, n, parts):
    return spark.range(0, n, 1, parts).selectExpr("id as token_id", "array(cast(id as double), null) as x", "if(id % 3 = 0, null, 'u') as unit")


@pytest.mark.parametrize("n,buffer_rows", [(0, 5), (1, 5), (5, 5), (37, 5), (25000, 700), (300, 1), (400, 100000)])
def test_every_row_comes_out_once(spark, n, buffer_rows):
    got = normalize.shuffle_buffer(_rows(spark, n, 3), buffer_rows).collect()
    assert sorted(r["token_id"] for r in got) == list(range(n))
    assert all(r["x"] == [float(r["token_id"]), None] and r["unit"] == (None if r["token_id"] % 3 == 0 else "u") for r in got)


def test_order_is_a_function_of_seed_epoch_and_partition(spark):
    rows = _rows(spark, 3000, 2)
    first = _order(normalize.shuffle_buffer(rows, 200, 7, 1))
    assert first == _order(normalize.shuffle_buffer(rows, 200, 7, 1))
    assert first != _order(normalize.shuffle_buffer(rows, 200, 7, 2)) and first != _order(normalize.shuffle_buffer(rows, 200, 8, 1))
    half = [x for x in first if x < 1500], [x - 1500 for x in first if x >= 1500]
    assert half[0] != half[1]


def test_the_buffer_bounds_how_early_a_row_comes(spark):
    """Batches much larger and smaller than the buffer: at most ``buffer_rows`` rows wait inside."""
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    orders = []
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        order = _order(normalize.shuffle_buffer(_rows(spark, 4000, 1), 50))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
        assert all(token < place + 50 for place, token in enumerate(order))
        assert np.abs(np.array(order) - np.arange(4000)).mean() > 10
        orders.append(order)
    assert orders[0] == orders[1]
    with pytest.raises(ValueError):
        normalize.shuffle_buffer(_rows(spark, 1, 1), 0)


def test_progress_of_one_pass(spark, sf):
    acts, model = b.acts(spark, sf), encode.Dictionary.of(b.atoms(spark, sf))
    told = []
    out, progress = encode.firings_with_progress(acts, model, encode.TopK(4), lambda name, one: told.append((name, one)))
    rows = out.collect()
    one = progress.get()
    assert one["n_rows"] == acts.count() and one["n_firings"] == len(rows)
    assert one["sum_act"] == pytest.approx(sum(r["act"] for r in rows)) and one["mean_l0"] == pytest.approx(len(rows) / one["n_rows"])
    import time

    for _ in range(50):
        if told:
            break
        time.sleep(0.1)
    assert told == [("encode", one)]
