"""Ranks and percentiles of skewed groups against windows and Spark's own percentile."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptspark.operators import concepts, ranks
from conceptspark.operators.quantiles import percentiles


def _skewed(spark, n=4000):
    """One concept of 90 % of the rows, many equal activations, a null concept."""
    rng = np.random.default_rng(0)
    g = np.where(rng.random(n) < 0.9, 0, rng.integers(1, 9, n))
    act = np.round(rng.exponential(1.0, n), 1)
    return spark.createDataFrame([(int(i), None if a == 8 else int(a), float(x)) for i, (a, x) in enumerate(zip(g, act))], "token_id long, g int, act double").repartition(5)


def _window(fr):
    w = W.partitionBy("g")
    return fr.withColumn("rank", (F.row_number().over(w.orderBy(F.col("act").desc(), "token_id")) - 1).cast("long")).withColumn("n", F.count("*").over(w))


@pytest.mark.parametrize("ranges", [None, 1, 16])
def test_ranks_are_the_windows(spark, ranges):
    fr = _skewed(spark)
    key = lambda df: sorted(map(str, df.select("token_id", "g", "act", "rank", "n").collect()))
    assert key(concepts.ranked(fr, ranges)) == key(_window(fr))


def test_no_task_holds_the_hot_concept(spark):
    p = ranks.place(_skewed(spark), "g", [F.col("act").desc(), F.col("token_id").asc()], 16)
    sizes = [r["size"] for r in p.parts.where("g = 0").collect()]
    assert len(sizes) > 10 and max(sizes) < 0.2 * sum(sizes) and p.parts.where("g = 0").first()["n"] == sum(sizes)


@pytest.mark.parametrize("ranges", [None, 7])
def test_quantiles_and_bands_of_a_hot_concept(spark, ranges):
    fr = _skewed(spark).where("g is not null")
    r = _window(fr)
    pick = lambda f: F.max(F.when(F.col("rank") == F.floor(F.lit(f) * (F.col("n") - 1)), F.col("act")))
    want = r.groupBy("g").agg(*[pick(f).alias(q) for q, f in concepts.QUANTILES])
    assert sorted(concepts.act_quantiles(fr, ranges).collect()) == sorted(want.collect())
    got = {(x["g"], x["band"], x["rank"]): (x["token_id"], x["rank_lo"]) for x in concepts.bands(fr, 4, ranges).collect()}
    rows = {(x["g"], x["rank"]): (x["token_id"], x["n"]) for x in r.collect()}
    sizes = {g: n for (g, _), (_, n) in rows.items()}
    expected = {}
    for g, n in sizes.items():
        for band, f in concepts.BANDS:
            s = min(int(f * n), n - 1)
            expected |= {(g, band, k): (rows[g, k][0], s) for k in range(s, min(s + 4, n))}
    assert got == expected


def test_no_rows(spark):
    none = _skewed(spark).where("g > 100")
    assert concepts.act_quantiles(none).count() == 0 and concepts.bands(none).count() == 0 and concepts.ranked(none).count() == 0
    assert percentiles(none, "act", [0.5]).count() == 0


POINTS = [0.0, 0.01, 0.25, 0.5, 0.98, 0.999, 1.0]


@pytest.mark.parametrize("small,edges", [(4096, 63), (8, 15), (1, 7)])
def test_percentiles_to_the_last_bit(spark, small, edges):
    rng = np.random.default_rng(1)
    x = [rng.standard_normal(900), rng.exponential(1.0, 700) ** 9, np.round(rng.random(500), 1), np.full(300, 2.5), [7.0], -1e308 * rng.random(50), np.repeat([1e-300, 1.0, 1e300], 40), np.repeat([-np.inf, 0.0, np.inf], 33)]
    df = spark.createDataFrame([(f"g{k}", float(v)) for k, vs in enumerate(x) for v in vs] + [("g0", None), ("none", None), ("g1", float("nan"))], "g string, v double").repartition(6)
    sound = df.where("v is not null and not isnan(v)")
    want = {r["g"]: r["q"] for r in sound.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, POINTS))).alias("q")).collect()}
    got = {r["g"]: r["q"] for r in percentiles(df, "v", POINTS, ["g"], edges, small).collect()}
    assert got == want
    assert percentiles(df, "v", POINTS, (), edges, small).first()["q"] == sound.agg(F.percentile("v", F.array(*map(F.lit, POINTS))).alias("q")).first()["q"]


def test_last_pass_is_bounded(spark):
    """Half of all values are alike; they are never brought together."""
    df = spark.range(20000).select(F.when(F.col("id") % 2 == 0, 0.5).otherwise(F.rand(3)).alias("v"))
    got = percentiles(df.coalesce(1), "v", [0.5, 0.75], small=50).first()
    want = df.coalesce(1).agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.75))).alias("q")).first()
    assert got["q"] == want["q"] and got["n"] == 20000



@pytest.mark.parametrize("ranges", [None, 1, 9])
def test_moving_average_by_ranges(spark, ranges):
    from conceptspark.operators import state

    rng = np.random.default_rng(2)
    v = rng.standard_normal(500) + 2
    df = spark.createDataFrame([(int(i), float(x)) for i, x in enumerate(v)] + [(1000, None)], "step long, value double").repartition(4)
    got = {r["step"]: r["ema"] for r in state.ema(df, "step", "value", 0.9, 1e-6, ranges).collect()}
    now = v[0]
    for i, x in enumerate(v):
        now = x if i == 0 else 0.9 * now + (1 - 0.9) * x
        assert got[i] == pytest.approx(max(now, 1e-6), rel=1e-9)
    assert len(got) == 500 and state.ema(df.where("step < 0"), "step", "value").count() == 0


@pytest.mark.parametrize("chunk", [2, 7, 256])
def test_nearest_blocks_are_those_of_all_distances(spark, chunk):
    from conceptspark.operators import geometry

    rng = np.random.default_rng(3)
    atoms = spark.createDataFrame([(g, j, rng.standard_normal(6).tolist()) for g in range(20) for j in range(2)] + [(20, 0, [1.0] * 6), (20, 1, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0])], "g int, j int, dec array<double>")
    key = lambda df: sorted((r["g"], r["rank"], r["other"], round(r["d"], 9)) for r in df.collect())
    assert key(geometry.nearest_blocks(atoms, 5, chunk)) == key(geometry.nearest(geometry.chordal(atoms), 5))
