"""Which concepts fire together: counts, Jaccard partners, and the thresholded graph.

Pairs are made per token, so their number is bounded by the square of a token's firings
(the encoder's l0), never by a concept's frequency.  Counts are combined before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Pairs of a task, about, and deals of tokens for each task (many, so that tasks are even).
TASK_PAIRS, DEALS = 1 << 20, 16


def pair_counts(firings: DataFrame) -> DataFrame:
    """(i, j, n_both), i < j: tokens on which both fire.

    A token's concepts are gathered once (one shuffle on the token) and paired in place.
    Tokens are dealt into deals of about ``TASK_PAIRS`` pairs a task, whose counts are
    combined before the second shuffle; both go to as many tasks as the pairs ask for,
    so a task's memory does not grow with the table.
    """
    n = _tasks(firings)
    deal = F.pmod(F.xxhash64("token_id"), F.lit(DEALS * n)).alias("deal")
    dealt = firings.select(deal, "token_id", "g").repartition(n, "deal")
    sets = dealt.groupBy("deal", "token_id").agg(F.sort_array(F.collect_set("g")).alias("gs")).where(F.size("gs") > 1)
    first = sets.select("deal", "gs", F.posexplode("gs").alias("at", "i"))
    pairs = first.select("deal", "i", F.explode(F.slice("gs", F.col("at") + 2, F.size("gs"))).alias("j"))
    some = pairs.groupBy("deal", "i", "j").agg(F.count("*").alias("n"))
    return some.select("i", "j", "n").repartition(n, "i", "j").groupBy("i", "j").agg(F.sum("n").alias("n_both"))


def _tasks(firings: DataFrame) -> int:
    """Tasks that the pairs of ``firings`` are dealt out to, by their number as of tokens of equal size."""
    one = firings.agg(F.count("*").alias("n"), F.approx_count_distinct("token_id").alias("tokens")).first()
    pairs = one["n"] * max(1.0, one["n"] / max(1, one["tokens"])) / 2
    return max(firings.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / TASK_PAIRS))


def jaccard(firings: DataFrame) -> DataFrame:
    """(i, j, n_both, jaccard) of every pair that fires together."""
    n = firings.groupBy("g").agg(F.count_distinct("token_id").alias("n"))
    pairs = pair_counts(firings)
    pairs = pairs.join(n.select(F.col("g").alias("i"), F.col("n").alias("ni")), "i").join(n.select(F.col("g").alias("j"), F.col("n").alias("nj")), "j")
    return pairs.select("i", "j", "n_both", (F.col("n_both") / (F.col("ni") + F.col("nj") - F.col("n_both"))).alias("jaccard"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair seen from either end: (g, other, ...)."""
    rest = [c for c in pairs.columns if c not in ("i", "j")]
    ends = F.explode(F.array(F.struct(F.col("i").alias("g"), F.col("j").alias("other")), F.struct(F.col("j").alias("g"), F.col("i").alias("other"))))
    return pairs.select(ends.alias("e"), *rest).select("e.g", "e.other", *rest)


def partners(firings: DataFrame, n: int = 8) -> DataFrame:
    """(g, rank, other, jaccard, n_both): the ``n`` strongest partners; pairs without overlap are left out."""
    rank = F.row_number().over(W.partitionBy("g").orderBy(F.col("jaccard").desc(), "other"))
    return both_ways(jaccard(firings)).withColumn("rank", rank).where(F.col("rank") <= n)


def edges(firings: DataFrame, threshold: float = 0.1, max_edges: int = 200_000) -> DataFrame:
    """(i, j, w): pairs at or above the threshold, strongest first, cut at ``max_edges``.

    The cut is part of the graph's definition; ``edges_found`` counts all of them.
    """
    found = jaccard(firings).where(F.col("jaccard") >= threshold).select("i", "j", F.col("jaccard").alias("w"))
    return found.orderBy(F.col("w").desc(), "i", "j").limit(max_edges)


def edges_found(firings: DataFrame, threshold: float = 0.1) -> DataFrame:
    return jaccard(firings).where(F.col("jaccard") >= threshold).agg(F.count("*").alias("found"))


def degree(edges_: DataFrame) -> DataFrame:
    """(g, degree, strength): edges and summed weight at every concept."""
    return both_ways(edges_).groupBy("g").agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))


def edges_of(edges_: DataFrame, g) -> DataFrame:
    """(other, w) of the edges at concept ``g``, strongest first."""
    hit = edges_.where((F.col("i") == g) | (F.col("j") == g))
    return hit.select(F.when(F.col("i") == g, F.col("j")).otherwise(F.col("i")).alias("other"), "w").orderBy(F.col("w").desc(), "other")


def split_edges(edges_: DataFrame, g) -> DataFrame:
    """All edges with whether they touch concept ``g``."""
    return edges_.withColumn("incident", (F.col("i") == g) | (F.col("j") == g))
