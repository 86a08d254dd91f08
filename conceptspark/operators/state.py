"""Running state in batch form: silence counters, moving scales, the sparsity controller."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptspark.operators import ranks
from conceptspark.operators.quantiles import percentiles
from conceptspark.runtime import stored


def tokens_since_fired(firings: DataFrame, order: str = "ts", tie: str = "token_id", buckets: int = 1024) -> DataFrame:
    """(g, since): tokens seen after the last one on which the concept fired.

    Tokens are counted in buckets of the order column.  Of a concept's last bucket only the
    tokens themselves are compared (an equi-join), later buckets add their counts.
    """
    is_time = dict(firings.dtypes)[order].startswith("timestamp")
    at = F.unix_micros(F.col(order).cast("timestamp_ltz")) if is_time else F.col(order).cast("long")
    rows = firings.select("g", at.alias("at"), F.col(tie).alias("tie"))
    span = rows.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).first()
    width = max(1, ((span["hi"] or 0) - (span["lo"] or 0)) // buckets + 1)
    bucket = F.floor((F.col("at") - (span["lo"] or 0)) / width)
    last = rows.groupBy("g").agg(F.max(F.struct("at", "tie")).alias("last")).select("g", "last", F.floor((F.col("last.at") - (span["lo"] or 0)) / width).alias("b"))
    tokens = rows.select("at", "tie").distinct().withColumn("b", bucket)
    counts = tokens.groupBy("b").agg(F.count("*").alias("n"))
    later = counts.select("b", F.coalesce(F.sum("n").over(W.orderBy(F.col("b").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("later"))
    near = tokens.join(last, "b").where(F.struct("at", "tie") > F.col("last")).groupBy("g").agg(F.count("*").alias("near"))
    return last.join(later, "b").join(near, "g", "left").select("g", (F.col("later") + F.coalesce("near", F.lit(0))).alias("since"))


def dead_mask(since: DataFrame, dead_after: int) -> DataFrame:
    return since.where(F.col("since") > dead_after)


def ema(series: DataFrame, order: str, value: str, momentum: float = 0.99, floor: float = 1e-6, ranges: int | None = None) -> DataFrame:
    """Moving averages m * ema + (1 - m) * value in order, from the first value on, of a series of any length.

    A value is a linear map x -> m x + (1 - m) v, and a range of values the map composed of
    theirs.  Ranges are composed apart, as sums; their maps, one row a range, are run through in
    order for what each range begins with; then every range is run through on its own.  Null
    values are left out.
    """
    rows = series.select(F.col(order), F.col(value).cast("double").alias("v"), F.lit(0).alias("one")).where("v is not null")
    p = ranks.place(rows, "one", [F.col(order).asc(), F.col("v").asc()], ranges)
    placed = p.rows.join(p.parts.select(F.col("part"), "before", "size"), "part")
    share = F.when(F.col("before") + F.col("at") == 0, F.lit(1.0)).otherwise(F.lit(1 - momentum))
    maps = placed.groupBy("part", "size").agg(F.sum(share * F.col("v") * F.pow(F.lit(momentum), F.col("size") - 1 - F.col("at"))).alias("b"))
    begin, now = {}, 0.0
    for r in maps.orderBy("part").collect():
        begin[r["part"]] = now
        now = momentum ** r["size"] * now + r["b"]
    kind = dict(rows.dtypes)[order]

    def run(batches):
        part, now = None, 0.0
        for pdf in batches:
            out = []
            for q, first, v in zip(pdf["part"].tolist(), pdf["first"].tolist(), pdf["v"].tolist()):
                if q != part:
                    part, now = q, begin[q]
                now = v if first else momentum * now + (1 - momentum) * v
                out.append(max(now, floor))
            yield pd.DataFrame({order: pdf[order], "ema": out})

    tasks = max(1, min(len(begin), series.sparkSession.sparkContext.defaultParallelism))
    inside = placed.select(F.col(order), "part", "at", (F.col("before") + F.col("at") == 0).alias("first"), "v")
    return inside.repartition(tasks, "part").sortWithinPartitions("part", "at").mapInPandas(run, f"`{order}` {kind}, ema double")


def batch_scale(firings: DataFrame, order: str, batch: int) -> DataFrame:
    """(step, value): mean activation of each run of ``batch`` tokens in order of an integer key."""
    return firings.groupBy(F.floor(F.col(order) / batch).alias("step")).agg(F.avg("act").alias("value"))


@dataclass
class L0Controller:
    """Integral control of log sparsity with anti-windup and a proportional term."""

    target: float
    gain: float = 0.0
    clip: float = 2.0
    kp: float = 2.0
    momentum: float = 0.99
    ema: float = 0.0
    adjustment: float = 0.0
    proportional: float = 0.0

    def update(self, l0: float) -> tuple[float, float]:
        """Feed one step's mean L0; returns (integral, proportional) parts."""
        self.ema = l0 if self.ema == 0 else self.momentum * self.ema + (1 - self.momentum) * l0
        error = min(1.0, max(-1.0, math.log(max(self.ema, 1e-6) / max(self.target, 1.0))))
        railed = abs(self.adjustment) >= self.clip and error * self.adjustment > 0
        if not railed:
            self.adjustment = min(self.clip, max(-self.clip, self.adjustment + self.gain * error))
        self.proportional = self.kp * error
        return self.adjustment, self.proportional

    def coefficient(self, base: float) -> float:
        """Effective penalty: base * exp of both parts, kept within twice the clip."""
        return base * math.exp(min(2 * self.clip, max(-2 * self.clip, self.proportional + self.adjustment)))


def effective_coefficient(base: Column, prop: Column, adj: Column, clip: float = 2.0) -> Column:
    return base * F.exp(F.greatest(F.lit(-2 * clip), F.least(F.lit(2 * clip), prop + adj)))


def theta_init(norms: DataFrame, target_l0: float, n_groups: int, gain: float = 10.0) -> DataFrame:
    """(scale, theta, raw_theta): cold start of a threshold gate from all block norms.

    scale is the mean norm; theta the 1 - target/G quantile of norm / scale, 1e-3 at least;
    raw_theta its inverse softplus over the gain.
    """
    acts = stored(norms.select("act"), "theta-norms")
    q = percentiles(acts, "act", [1 - target_l0 / n_groups]).select(F.get("q", F.lit(0)).alias("q"))
    one = acts.agg(F.avg("act").alias("scale")).crossJoin(q)
    one = one.select("scale", F.greatest(F.col("q") / F.col("scale"), F.lit(1e-3)).alias("theta"))
    return one.withColumn("raw_theta", F.log(F.expm1("theta")) / gain)


def softplus_theta(raw: Column, gain: float = 10.0) -> Column:
    return F.log1p(F.exp(raw * gain))


def cauchy(u: Column, tau: float) -> Column:
    return 1 / (math.pi * tau * (1 + u * u))


def window_occupancy(norms: DataFrame, scale: float, theta: float, tau: float, eps: float = 1e-3) -> DataFrame:
    """(occupancy, stranded): mean kernel mass over its peak, and blocks whose mass is below eps."""
    u = (F.col("act") / scale - theta) / tau
    per = norms.groupBy("g").agg(F.sum(cauchy(u, tau)).alias("mass"), F.count("*").alias("n"))
    return per.agg((F.sum("mass") / F.sum("n") * (math.pi * tau)).alias("occupancy"), F.count_if(F.col("mass") < eps).alias("stranded"))


def dead_topk(norms: DataFrame, dead: DataFrame, k_aux: int) -> DataFrame:
    """(token_id, g, act, rank): the ``k_aux`` largest dead blocks of every token."""
    rank = F.row_number().over(W.partitionBy("token_id").orderBy(F.col("act").desc(), "g"))
    return norms.join(F.broadcast(dead.select("g")), "g", "left_semi").withColumn("rank", rank).where(F.col("rank") <= k_aux)


def l0_off_target(l0: Column, target: float, tolerance: float = 2.0) -> Column:
    return (l0 > tolerance * target) | (l0 < target / tolerance)
