"""Exact percentiles by selection.

Every round draws edges through the open intervals by approximate percentiles, counts the values
at and between the edges exactly, and keeps only the bins that hold a wanted rank, cut down to
their own smallest and largest value.  When an interval is one value, or holds few, the rank
is read off.  A round leaves a fixed share of an interval whatever the distribution, so values
are scanned a few times and never sorted or brought together; a group may hold any number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptspark.runtime import stored

#: Edges drawn through an interval, and values that are sorted in one place at most.
EDGES, SMALL = 63, 4096


def percentiles(rows: DataFrame, value: str, points: Sequence[float], by: Sequence[str] = (), edges: int = EDGES, small: int = SMALL) -> DataFrame:
    """(by..., n, q): the interpolated percentiles ``points`` of a column, equal to ``percentile``'s to the last bit.

    Nulls and NaN are left out; a group without other values has no row.  Without ``by``
    there is one group.
    """
    by = list(by)
    key = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("one"))
    values = rows.select(key.alias("key"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    values = stored(values, "quantile-values")
    spans = stored(values.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "quantile-spans")
    asked = spans.select("key", "n", F.posexplode(F.array(*[F.lit(float(p)) for p in points])).alias("i", "p"))
    asked = asked.withColumn("position", (F.col("n") - 1) * F.col("p")).withColumn("low", F.floor("position")).withColumn("high", F.ceil("position"))
    wanted = asked.select("key", F.explode(F.array("low", "high")).alias("k")).groupBy("key").agg(F.collect_set("k").alias("ks"))
    open_ = spans.join(wanted, "key").select("key", "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("size"), "ks")
    found = None
    while True:
        open_ = stored(open_, "quantile-intervals")
        one = open_.where("lo = hi").select("key", F.explode("ks").alias("k"), F.col("lo").alias("v"))
        few = _inside(values, open_.where((F.col("lo") < F.col("hi")) & (F.col("size") <= small)))
        few = few.groupBy("key", "lo").agg(F.array_sort(F.collect_list("v")).alias("all"), F.first("before").alias("before"), F.first("ks").alias("ks"))
        few = few.select("key", F.explode("ks").alias("k"), "all", "before").select("key", "k", F.get("all", (F.col("k") - F.col("before")).cast("int")).alias("v"))
        found = one.unionByName(few) if found is None else found.unionByName(one).unionByName(few)
        left = open_.where((F.col("lo") < F.col("hi")) & (F.col("size") > small))
        if left.limit(1).count() == 0:
            break
        inside = _inside(values, left)
        drawn = inside.groupBy("key", "lo").agg(F.array_distinct(F.percentile_approx("v", F.array(*[F.lit((i + 1) / (edges + 1)) for i in range(edges)]), 16 * edges)).alias("edges"))
        left = stored(left.join(drawn, ["key", "lo"]), "quantile-edges")
        # Twice the edges below a value, and one more at an edge: edges are bins of their own.
        bin_ = (2 * F.size(F.filter("edges", lambda e: e < F.col("v"))) + F.array_contains("edges", F.col("v")).cast("int"))
        counted = _inside(values, left, "edges").groupBy("key", "lo", bin_.alias("bin")).agg(F.count("*").alias("size"), F.min("v").alias("new_lo"), F.max("v").alias("new_hi"), F.first("before").alias("base"), F.first("ks").alias("ks"))
        upto = F.sum("size").over(W.partitionBy("key", "lo").orderBy("bin").rowsBetween(W.unboundedPreceding, -1))
        counted = counted.withColumn("before", F.col("base") + F.coalesce(upto, F.lit(0)))
        counted = counted.withColumn("ks", F.filter("ks", lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("size")))).where(F.size("ks") > 0)
        open_ = counted.select("key", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"), "before", "size", "ks")
    found = stored(found, "quantile-found")
    low, high = (found.select(F.col("key").alias("key"), F.col("k").alias(c), F.col("v").alias(f"v_{c}")) for c in ("low", "high"))
    met = asked.join(low, ["key", "low"]).join(high, ["key", "high"])
    between = (F.col("high") - F.col("position")) * F.col("v_low") + (F.col("position") - F.col("low")) * F.col("v_high")
    met = met.select("key", "n", "i", F.when(F.col("v_low") == F.col("v_high"), F.col("v_low")).otherwise(between).alias("v"))
    out = met.groupBy("key").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("q"))
    return out.select(*[F.col(f"key.{c}") for c in by], "n", "q")


def _inside(values: DataFrame, intervals: DataFrame, *more: str) -> DataFrame:
    """Values of the open intervals; the table of intervals is small, a few rows per group."""
    return values.join(intervals.select("key", "lo", "hi", "before", "ks", *more), "key").where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
