"""Token strings around firings: lookup, context windows, vocabulary, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptspark.runtime import stored

#: Units whose list goes to every task.
FEW_UNITS = 100_000


def clean(token: Column) -> Column:
    """Byte-level markers to characters: space, newline, tab."""
    return F.translate(token, "ĠĊĉ", " \n\t")


def of_units(tokens: DataFrame, units: DataFrame) -> DataFrame:
    """Tokens of some units (distinct), where these are few; else all, for a join to choose from."""
    return tokens.join(F.broadcast(units), "unit", "left_semi") if units.limit(FEW_UNITS + 1).count() <= FEW_UNITS else tokens


def lookup(firings: DataFrame, tokens: DataFrame) -> DataFrame:
    """Add the token at (unit, pos); ``<pos>`` where there is none."""
    given = of_units(tokens, firings.select("unit").distinct())
    found = firings.join(given.select("unit", "pos", F.col("token").alias("__t")), ["unit", "pos"], "left")
    return found.withColumn("token", F.coalesce(clean(F.col("__t")), F.concat(F.lit("<"), F.col("pos").cast("string"), F.lit(">")))).drop("__t")


def contexts(tokens: DataFrame, width: int = 4, *more: str) -> DataFrame:
    """(unit, pos, token, context_before, context_after) and ``more`` columns: one pass with row frames, no range join."""
    w = W.partitionBy("unit").orderBy("pos")
    before = F.array_join(F.collect_list(clean(F.col("token"))).over(w.rowsBetween(-width, -1)), "")
    after = F.array_join(F.collect_list(clean(F.col("token"))).over(w.rowsBetween(1, width)), "")
    return tokens.select("unit", "pos", clean(F.col("token")).alias("token"), before.alias("context_before"), after.alias("context_after"), *more)


def examples_with_context(examples: DataFrame, tokens: DataFrame, width: int = 4) -> DataFrame:
    """Examples with token and context.

    Places of examples lie among the tokens as marks, so tokens are dealt out once, by unit,
    and only those at a mark leave their window.  Where few units have examples, others'
    tokens are left out before.
    """
    places = stored(examples.select("unit", "pos").distinct(), "example-places")
    units = places.select("unit").distinct()
    given = of_units(tokens.select("unit", "pos", "token"), units)
    mark = F.lit(True).alias("mark")
    rows = given.withColumn("mark", F.lit(None).cast("boolean")).unionByName(places.select("unit", "pos", F.lit(None).cast("string").alias("token"), mark))
    w = W.partitionBy("unit").orderBy("pos")
    marked = rows.withColumn("hit", F.max("mark").over(w.rangeBetween(W.currentRow, W.currentRow))).where("mark is null")
    near = contexts(marked, width, "hit").where("hit").drop("hit")
    out = examples.join(near, ["unit", "pos"], "left")
    return out.withColumn("token", F.coalesce("token", F.concat(F.lit("<"), F.col("pos").cast("string"), F.lit(">"))))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """(token, token_id): distinct tokens numbered from 1 in order; 0 stands for none.

    Tokens are range-partitioned and numbered within a range; range counts give the offsets.
    """
    distinct = tokens.select("token").distinct()
    ranged = distinct.withColumn("head", F.substring(F.hex(F.col("token").cast("binary")), 1, 2))
    counts = ranged.groupBy("head").agg(F.count("*").alias("n"))
    offsets = counts.select("head", F.coalesce(F.sum("n").over(W.orderBy("head").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    at = F.row_number().over(W.partitionBy("head").orderBy("token"))
    return ranged.withColumn("at", at).join(F.broadcast(offsets), "head").select("token", (F.col("offset") + F.col("at")).alias("token_id"))


def find_concept(examples: DataFrame, needle: str) -> DataFrame:
    """The smallest concept with an example token that holds ``needle``, case-folded; none for a blank one."""
    if not needle.strip():
        return examples.limit(0).agg(F.min("g").alias("g"))
    return examples.where(F.contains(F.lower("token"), F.lit(needle.strip().lower()))).agg(F.min("g").alias("g"))
