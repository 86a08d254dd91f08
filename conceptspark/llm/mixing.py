"""Mixing sources to target weights.

Documents get a hash-random key; within each source they are range-sorted by it, token
counts are prefix-summed over the ranges, and the source is cut at its exact budget.
Full epochs come before the cut, so a source that must be upsampled repeats as a whole.

The ranges are equal-width slices of the 64-bit key space (keys are uniform), so a source
with a third of all rows is spread over as many window groups as its share asks for: one
group holds about ``rows_per_range`` documents of one source whatever the source's size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptspark.runtime import others, stored

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, max_epochs=MAX_EPOCHS) -> DataFrame:
    """Targets of a table (source, source_size) of one row per source.

    Sources by code point, null last, weigh ``weights`` in turn.  A target is
    ``min(max_epochs * source_size, level * weight)`` with the level at which the targets
    add up to all sizes: what a capped source leaves is reshared by weight until none is
    above its cap.  The level follows from sums over sources ordered by cap / weight.
    The windows here run over sources, not documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    out = sources.withColumn("weight", F.element_at(w, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    out = out.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    out = (
        out.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    )
    # The first source, in order of cap / weight, whose cap is above its level sets the level of all after it.
    open_ = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))
    out = out.withColumn("level", F.first(open_, ignorenulls=True).over(by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return out.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, text="text", source="source", key="doc_id", weights=WEIGHTS, max_epochs=MAX_EPOCHS, seed="mix", rows_per_range=4000, carry=False) -> DataFrame:
    """How many words of each document the mix takes.

    Returns one row per input row: ``key``, source, size, source_size, target, taken.
    With ``carry`` all columns of ``docs`` come along (clashing names are replaced).
    Null texts and texts without words have size 0 and are taken 0 times.  A null source
    is a source of its own, last in order.  Rows that repeat a document id are ordered by
    size and stand side by side; their ``taken`` values may differ, their sum is exact.
    An empty table gives an empty result.  The order is a hash of id and ``seed``, so
    reruns agree.
    """
    hashed = F.md5(F.concat_ws("-", F.lit(seed), F.col(key).cast("string")).cast("binary"))
    size = n_words(F.col(text))
    kept = others(docs, "size", "source_size", "target", "taken", "mix_key") if carry else [F.col(key), F.col(source).alias("source")]
    base = docs.select(*kept, size.alias("size"), hashed.alias("mix_key"))
    if carry and source != "source":
        base = base.withColumn("source", F.col(source))
    base = stored(base, "mix-base")
    sources = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sources = stored(sources.coalesce(1), "mix-sources")
    most = sources.agg(F.max("rows")).first()[0] or 0
    bits = min(32, max(0, math.ceil(math.log2(max(1, most / rows_per_range)))))
    # The first 8 hex digits as a number, cut to the leading bits: an equal-width range of the key space.
    slot = F.shiftright(F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long"), 32 - bits)
    base = base.withColumn("mix_range", slot)
    sums = base.groupBy("source", "mix_range").agg(F.sum("size").alias("range_size"))
    ranges = W.partitionBy("source").orderBy("mix_range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("range_start", F.coalesce(F.sum("range_size").over(ranges), F.lit(0)))
    aims = targets(sources.select("source", "source_size"), weights, max_epochs)
    plan = sums.alias("s").join(aims.alias("a"), F.col("s.source").eqNullSafe(F.col("a.source"))).select(
        F.col("s.source").alias("p_source"), F.col("mix_range").alias("p_range"), "range_start", "source_size", "target")
    inside = W.partitionBy("source", "mix_range").orderBy("mix_key", key, "size").rowsBetween(W.unboundedPreceding, -1)
    placed = base.withColumn("in_range", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("mix_range") == F.col("p_range")))
    budget = F.round("target").cast("long")
    epochs = F.floor(budget / F.greatest("source_size", F.lit(1))).cast("long")
    rest = budget - epochs * F.col("source_size")
    cut = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest - F.col("range_start") - F.col("in_range")))
    return joined.withColumn("taken", epochs * F.col("size") + cut).drop("p_source", "p_range", "mix_range", "mix_key", "range_start", "in_range")


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as often as their mix takes them, in whole copies: ``taken / size`` rounded.

    A document without words adds nothing to any source and stays once.  Columns are those of
    ``docs``, untouched, whatever their names; an empty table gives an empty one.
    """
    held = docs.select(F.struct(*others(docs)).alias("doc"))
    mixed = mix(held, text="doc.text", source="doc.source", key="doc.doc_id", carry=True, **options)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + F.lit(0.5)).cast("int"))
    again = F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))
    return mixed.withColumn("copy", F.explode(again)).select("doc.*")


def op6_mix(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-' || CAST(doc_id AS VARCHAR)) AS k
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
weighed AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS cap,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight
  FROM src),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM weighed),
aims AS (
  SELECT source, source_size,
         least(cap, coalesce(first_value(CASE WHEN cap >= lvl * weight THEN lvl END IGNORE NULLS) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * weight, cap)) AS target
  FROM levels),
placed AS (
  SELECT b.doc_id, b.size, a.source_size, a.target, CAST(round(a.target) AS BIGINT) AS budget,
         CAST(coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.k, b.doc_id, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM base b JOIN aims a ON b.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
       (budget // greatest(source_size, 1)) * size
       + least(size, greatest(0, budget - (budget // greatest(source_size, 1)) * source_size - before)) AS taken
FROM placed
"""
