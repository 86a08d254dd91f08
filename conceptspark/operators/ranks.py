"""Ranks inside groups of any size.

Rows are range-partitioned by (group, order), so a group that fills most of a table lies
across many tasks.  Each task numbers its own rows within the group; what a group has in
earlier ranges is a prefix sum over a table of one row per (group, range), joined back.  No
task holds a group, and rows are shuffled once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptspark.runtime import stored


@dataclass
class Placed:
    """``rows`` with part and at (from 0, within the part's rows of the group), and a row per (group, part): before, size, n."""

    rows: DataFrame
    parts: DataFrame
    group: str

    def pick(self, wanted: Column) -> DataFrame:
        """Rows of wanted ranks: ``wanted`` makes of n an array of structs with a field ``rank`` (from 0).

        Returns the rows with the struct's fields and n.  Only the wanted places are joined, a
        few per group, so the rows are not shuffled where these fit a broadcast.
        """
        asked = self.parts.select(self.group, "part", "before", "size", "n", F.explode(wanted).alias("w"))
        asked = asked.where((F.col("w.rank") >= F.col("before")) & (F.col("w.rank") < F.col("before") + F.col("size")))
        asked = asked.select(F.col(self.group).alias("__g"), F.col("part").alias("__part"), (F.col("w.rank") - F.col("before")).alias("__at"), "n", "w.*")
        met = (F.col("part") == F.col("__part")) & (F.col("at") == F.col("__at")) & F.col(self.group).eqNullSafe(F.col("__g"))
        return self.rows.join(asked, met).drop("part", "at", "__g", "__part", "__at")

    def all(self) -> DataFrame:
        """All rows with their rank (from 0) and the group's n."""
        parts = self.parts.select(F.col(self.group).alias("__g"), F.col("part").alias("__part"), "before", "n")
        rows = self.rows.join(parts, (F.col("part") == F.col("__part")) & F.col(self.group).eqNullSafe(F.col("__g")))
        return rows.withColumn("rank", F.col("before") + F.col("at")).drop("part", "at", "__g", "__part", "before")


def place(rows: DataFrame, group: str, order: list[Column], ranges: int | None = None) -> Placed:
    """Number the rows of every group in ``order``.

    Rows whose group and order are equal stand in one range, so an order should tell rows
    apart.  ``ranges`` is the number of ranges, that of shuffle partitions if not given.  A
    null group is a group of its own.  An empty table has no places.
    """
    keys = [F.col(group).asc_nulls_first(), *order]
    ranged = rows.repartitionByRange(*([ranges] if ranges else []), *keys).sortWithinPartitions(*keys)
    at_group = rows.columns.index(group)

    def number(batches):
        part = TaskContext.get().partitionId()
        last, count = None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            column = b.column(at_group)
            codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
            at = np.arange(n, dtype=np.int64) - np.repeat(begins, np.diff(np.append(begins, n)))
            if last is not None and column[0].as_py() == last[0]:
                at[: begins[1] if len(begins) > 1 else n] += count
            last, count = (column[n - 1].as_py(),), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(at)], names=[*b.schema.names, "part", "at"])

    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())])
    placed = stored(ranged.mapInArrow(number, schema), "ranks")
    sizes = placed.groupBy(group, "part").agg((F.max("at") + 1).alias("size"))
    own = W.partitionBy(group)
    before = F.coalesce(F.sum("size").over(own.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = stored(sizes.withColumn("before", before).withColumn("n", F.sum("size").over(own)), "rank-parts")
    return Placed(placed, parts, group)
