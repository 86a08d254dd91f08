"""Normalisation statistics, row selection and epoch order of activation rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def drop_first(acts: DataFrame, n: int) -> DataFrame:
    """Rows from position ``n`` of their unit on; the filter reaches Parquet-backed tables' scans."""
    if n < 0:
        raise ValueError("drop_first is a number of positions, 0 or more")
    return acts.where(F.col("pos") >= n)


def first_units(acts: DataFrame, n: int) -> DataFrame:
    """Rows of the first ``n`` units in order; the unit list is small and joined, no row is ranked."""
    units = acts.select("unit").distinct().orderBy("unit").limit(n)
    return acts.join(units, "unit", "left_semi")


def norm_stats(acts: DataFrame, max_rows: int | None = None) -> DataFrame:
    """(n, d, mean, scale) in one row.

    scale = sqrt(d / (mean of squared norms - squared norm of the mean)), the denominator
    floored at 1e-12.  A dimension's sums are combined before the shuffle, so each task
    sends d rows.  ``max_rows`` takes the first rows by token_id.
    """
    rows = acts.select("token_id", "x")
    if max_rows is not None:
        rows = rows.orderBy("token_id").limit(max_rows)
    per = rows.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.avg(F.col("v") * F.col("v")).alias("sq"))
    one = per.agg(F.max("n").alias("n"), F.count("*").alias("d"), F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("m"), F.sum("sq").alias("sq"), F.sum(F.col("mean") * F.col("mean")).alias("mm"))
    scale = F.sqrt(F.col("d") / F.greatest(F.col("sq") - F.col("mm"), F.lit(1e-12)))
    return one.select("n", "d", F.transform("m", lambda s: s["mean"]).alias("mean"), scale.alias("scale"))


def normalize(acts: DataFrame, stats: DataFrame) -> DataFrame:
    """x replaced by (x - mean) * scale; ``stats`` is one row."""
    rows = acts.crossJoin(F.broadcast(stats.select("mean", "scale")))
    return rows.withColumn("x", F.transform(F.zip_with("x", "mean", lambda a, b: a - b), lambda v: v * F.col("scale"))).drop("mean", "scale")


def center_positions(acts: DataFrame) -> DataFrame:
    """x minus the mean of all rows at the same position, in long form (token_id, pos, dim, value)."""
    long = acts.select("token_id", "pos", F.posexplode("x").alias("dim", "v"))
    mean = long.groupBy("pos", "dim").agg(F.avg("v").alias("m"))
    return long.join(mean, ["pos", "dim"]).select("token_id", "pos", "dim", (F.col("v") - F.col("m")).alias("value"))


def infer_d(acts: DataFrame) -> int:
    """Dimensions of the rows; an error for an empty table."""
    row = acts.select(F.size("x").alias("d")).first()
    if row is None:
        raise ValueError("no activation rows")
    return row["d"]


def row_count(units: DataFrame, drop: int) -> DataFrame:
    """Rows left after the position filter, from unit counts (unit, n) alone."""
    return units.agg(F.sum(F.greatest(F.col("n") - drop, F.lit(0))).alias("n_rows"))


def steps_per_epoch(units: DataFrame, drop: int, batch: int, world: int = 1) -> DataFrame:
    """max(1, rows // world // batch)."""
    return row_count(units, drop).select(F.greatest(F.lit(1).cast("long"), F.floor(F.floor(F.col("n_rows") / world) / batch)).alias("steps"))


def shuffle_key(seed: int, epoch: int, key: str = "token_id") -> Column:
    """A key whose order is a fresh uniform shuffle for every (seed, epoch)."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), F.lit(str(epoch)), F.col(key).cast("string")).cast("binary"))


def epoch_batches(acts: DataFrame, batch: int, seed: int = 0, epoch: int = 0, ranges: int = 64, slot: str | None = None) -> DataFrame:
    """Each row's step in a shuffled epoch without replacement; the last partial batch is dropped.

    ``slot`` names a column for the row's place in its batch.

    Rows are ranked within equal ranges of the hash key, and ranges offset by their
    counts, so that no single task orders the table.
    """
    rows = acts.withColumn("key", shuffle_key(seed, epoch))
    rows = rows.withColumn("range", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("int"))
    counts = rows.groupBy("range").agg(F.count("*").alias("n"))
    offsets = counts.select("range", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.sum("n").over(W.partitionBy()).alias("total"))
    at = F.row_number().over(W.partitionBy("range").orderBy("key", "token_id")) - 1
    ranked = rows.withColumn("at", at).join(F.broadcast(offsets), "range")
    step = F.floor((F.col("offset") + F.col("at")) / batch)
    if slot is not None:
        ranked = ranked.withColumn(slot, ((F.col("offset") + F.col("at")) % batch).cast("int"))
    return ranked.withColumn("step", step).where(F.col("step") < F.floor(F.col("total") / batch)).drop("key", "range", "at", "offset", "total")


def shuffle_buffer(acts: DataFrame, buffer_rows: int = 65_536, seed: int = 0, epoch: int = 0) -> DataFrame:
    """The rows of ``acts``, those of each partition in a shuffled order, with no exchange.

    A task keeps ``buffer_rows`` rows; each further row takes the place of one drawn at
    random, which comes out, and at the end the buffer is drained shuffled.  The order is a
    function of (seed, epoch, partition) and the partition's rows, so a task that is run
    again gives the same.  A row comes out ``buffer_rows`` places early at most; for a uniform
    order over the whole table use ``epoch_batches``.
    """
    if buffer_rows < 1:
        raise ValueError("the buffer holds a row at least")

    def run(batches):
        rng = np.random.default_rng([seed, epoch, TaskContext.get().partitionId()])
        kept = None
        for b in batches:
            rows = pa.Table.from_batches([b])
            rows = rows if kept is None else pa.concat_tables([kept, rows])
            held = 0 if kept is None else kept.num_rows
            full = min(buffer_rows, rows.num_rows)
            slots = np.arange(full)
            places = rng.integers(0, buffer_rows, rows.num_rows - full)
            out = np.empty(len(places), dtype=np.int64)
            for n, at in enumerate(places):
                out[n], slots[at] = slots[at], max(held, full) + n
            yield from rows.take(pa.array(out)).combine_chunks().to_batches()
            kept = rows.take(pa.array(slots)).combine_chunks()
        if kept is not None:
            yield from kept.take(pa.array(rng.permutation(kept.num_rows))).combine_chunks().to_batches(max_chunksize=10_000)

    return acts.mapInArrow(run, acts.schema)
