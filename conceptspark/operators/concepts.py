"""Per-concept statistics, rank quantiles, bands, examples and samples over firings.

Firings are (token_id, g, act) rows, with (unit, pos) where examples are asked for.
Ranks order by activation, strongest first, ties by unit and position (or token).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptspark.operators import ranks
from conceptspark.operators.quantiles import percentiles

#: Band names and where they start, as a share of a concept's firings.
BANDS = (("top", 0.0), ("p75", 0.25), ("p50", 0.5), ("p10", 0.9))
#: The share of the maximum below which a firing is near its threshold, and a band is weak.
NEAR = 0.4


def rank_order(firings: DataFrame) -> list[Column]:
    ties = ["unit", "pos"] if {"unit", "pos"} <= set(firings.columns) else ["token_id"]
    return [F.col("act").desc(), *map(F.col, ties)]


def fire_stats(firings: DataFrame, n_tokens: int | Column) -> DataFrame:
    """(g, n_fire, mean_act, max_act, fire_rate) of every concept that fires."""
    out = firings.groupBy("g").agg(F.count("*").alias("n_fire"), F.avg("act").alias("mean_act"), F.max("act").alias("max_act"))
    rate = F.col("n_fire") / (F.lit(n_tokens) if isinstance(n_tokens, int) else n_tokens)
    return out.withColumn("fire_rate", rate)


def fire_stats_all(firings: DataFrame, concepts: DataFrame, n_tokens: int) -> DataFrame:
    """``fire_stats`` of every concept of a table (g); 0 where one never fires."""
    return concepts.join(fire_stats(firings, n_tokens), "g", "left").na.fill(0)


def dead(concepts: DataFrame, firings: DataFrame) -> DataFrame:
    """Concepts (g) that never fire."""
    return concepts.select("g").distinct().join(firings.select("g"), "g", "left_anti")


def energy_top(firings: DataFrame, n: int = 20, least: int = 100) -> DataFrame:
    """The ``n`` concepts of largest energy (sum of squared activations) among those with enough firings."""
    out = firings.groupBy("g").agg(F.count("*").alias("n_fire"), F.sum(F.col("act") * F.col("act")).alias("energy"))
    return out.where(F.col("n_fire") >= least).orderBy(F.col("energy").desc(), "g").limit(n)


def placed(firings: DataFrame, ranges: int | None = None) -> ranks.Placed:
    """Firings placed by rank within their concept; a concept of any size lies across tasks."""
    return ranks.place(firings, "g", rank_order(firings), ranges)


def ranked(firings: DataFrame, ranges: int | None = None) -> DataFrame:
    """Firings with their rank (from 0) within the concept, and the concept's count."""
    return placed(firings, ranges).all()


#: Quantiles and where they stand on the falling list, as a share of its places.
QUANTILES = (("q_min", 1.0), ("q25", 0.75), ("q50", 0.5), ("q75", 0.25), ("q_max", 0.0))


def act_quantiles(firings: DataFrame, ranges: int | None = None) -> DataFrame:
    """(g, q_min, q25, q50, q75, q_max) by rank pick on the falling list: a[int(f * (n - 1))]."""
    narrow = firings.select(*(c for c in ("g", "act", "unit", "pos", "token_id") if c in firings.columns))
    wanted = F.array(*[F.struct(F.lit(q).alias("q"), F.floor(F.lit(f) * (F.col("n") - 1)).alias("rank")) for q, f in QUANTILES])
    r = placed(narrow, ranges).pick(wanted)
    return r.groupBy("g").agg(*[F.max(F.when(F.col("q") == q, F.col("act"))).alias(q) for q, _ in QUANTILES])


def near_threshold(firings: DataFrame, near: float = NEAR) -> DataFrame:
    """(g, near_threshold_frac): share of firings below ``near`` of the concept's maximum."""
    top = firings.groupBy("g").agg(F.max("act").alias("top"))
    return firings.join(top, "g").groupBy("g").agg(F.avg((F.col("act") < near * F.col("top")).cast("double")).alias("near_threshold_frac"))


def bands(firings: DataFrame, per_band: int = 4, ranges: int | None = None) -> DataFrame:
    """Rows of the bands: (g, band, rank, act, ...), with rank_lo, lo_act, hi_act, and weak.

    A band is a window of ranks from min(int(f * n), n - 1).  A band is weak where its
    strongest firing is below 0.4 of the concept's maximum.
    """
    starts = F.array(*[F.struct(F.lit(b).alias("band"), F.least(F.floor(F.lit(f) * F.col("n")), F.col("n") - 1).alias("rank_lo")) for b, f in BANDS])
    places = F.flatten(F.transform(starts, lambda b: F.transform(F.sequence(b["rank_lo"], F.least(b["rank_lo"] + per_band, F.col("n")) - 1), lambda r: F.struct(b["band"].alias("band"), b["rank_lo"].alias("rank_lo"), r.alias("rank")))))
    rows = placed(firings, ranges).pick(places)
    # The strongest firing of all is in the top band, so a concept's few rows here hold it.
    own, top = W.partitionBy("g", "band"), F.max("act").over(W.partitionBy("g"))
    rows = rows.withColumn("lo_act", F.min("act").over(own)).withColumn("hi_act", F.max("act").over(own))
    return rows.withColumn("weak", F.col("hi_act") < NEAR * top).drop("n")


def top_examples(firings: DataFrame, k: int = 12) -> DataFrame:
    """The ``k`` strongest firings of every concept; a limit per group before the shuffle."""
    rank = F.row_number().over(W.partitionBy("g").orderBy(*rank_order(firings)))
    return firings.withColumn("rank", rank).where(F.col("rank") <= k)


def rate_histogram(stats: DataFrame, bins: int = 60, low: float = -6.0) -> DataFrame:
    """(bin, n) of log10 firing rates in ``bins`` equal bins from ``low`` to 0."""
    log = F.log10(F.greatest("fire_rate", F.lit(1e-6)))
    at = F.least(F.lit(bins - 1), F.floor((log - low) / (-low / bins))).cast("int")
    return stats.select(at.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def summary(table: DataFrame, column: str, points=(0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Exact interpolated percentiles of a column over concepts: (p, value)."""
    one = percentiles(table, column, points)
    return one.select(F.posexplode("q").alias("i", "value")).select(F.get(F.array(*[F.lit(p) for p in points]), F.col("i")).alias("p"), "value")


def drop_weakest(firings: DataFrame, share: float, least: int = 8) -> DataFrame:
    """Firings at or above the concept's ``share`` percentile; concepts with few points are kept whole."""
    cut = percentiles(firings, "act", [share], ["g"]).select("g", F.get("q", F.lit(0)).alias("cut"), F.col("n").alias("n_points"))
    rows = firings.join(cut, "g")
    return rows.where((F.col("n_points") <= least) | (F.col("act") >= F.col("cut"))).drop("cut", "n_points")


def cloud_sample(firings: DataFrame, per_unit: int = 8, points: int = 200) -> DataFrame:
    """Top ``per_unit`` firings of every (concept, unit), units in order, until ``points`` per concept."""
    inner = F.row_number().over(W.partitionBy("g", "unit").orderBy(F.col("act").desc(), "pos"))
    rows = firings.withColumn("r", inner).where(F.col("r") <= per_unit)
    outer = F.row_number().over(W.partitionBy("g").orderBy("unit", "r"))
    return rows.withColumn("rank", outer).where(F.col("rank") <= points).drop("r")


def uniform_sample(firings: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` firings of every concept, uniformly, by a hash order that reruns repeat."""
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("g").cast("string"), F.col("token_id").cast("string")).cast("binary"))
    rank = F.row_number().over(W.partitionBy("g").orderBy(key, "token_id"))
    return firings.withColumn("rank", rank).where(F.col("rank") <= n)


def unit_energy_top(firings: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` units of largest energy of every concept."""
    e = firings.groupBy("g", "unit").agg(F.sum(F.col("act") * F.col("act")).alias("energy"))
    rank = F.row_number().over(W.partitionBy("g").orderBy(F.col("energy").desc(), "unit"))
    return e.withColumn("rank", rank).where(F.col("rank") <= n)


def mean_l0(firings: DataFrame, n_tokens: int) -> DataFrame:
    return firings.agg((F.count("*") / F.lit(n_tokens)).alias("mean_l0"))


def ragged_offsets(firings: DataFrame) -> DataFrame:
    """(g, n, offset) of codes laid out concept after concept; the window runs over concepts."""
    n = firings.groupBy("g").agg(F.count("*").alias("n"))
    return n.withColumn("offset", F.coalesce(F.sum("n").over(W.orderBy("g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
