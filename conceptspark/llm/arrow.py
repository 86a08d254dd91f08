"""Per-row Python over Arrow batches in slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptspark.runtime import others

#: Bytes of the input column that are worked on at once (more where one row is larger).
AT_ONCE = 1_000_000


def slices(sizes: list[int], at_once: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows whose sizes add up to ``at_once`` at most, of one row at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > at_once:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def with_columns(df: DataFrame, column, fn: Callable[[list], list[pa.Array]], fields: list[T.StructField], drop: tuple[str, ...] = (), at_once: int = AT_ONCE) -> DataFrame:
    """``df`` without ``drop``, with the columns ``fields`` that ``fn`` makes of a slice of a binary column.

    ``column`` must not be null.  Other columns pass as Arrow arrays, untouched; columns
    with the names of ``fields`` are replaced.  However many rows and bytes an Arrow batch
    holds, Python objects exist for one slice at a time.
    """
    kept = df.select(*others(df, *drop, *(f.name for f in fields), "__in"))
    schema = T.StructType([*kept.schema.fields, *fields])
    names = schema.names

    def run(batches):
        for b in batches:
            data = b.column(b.num_columns - 1)
            for lo, hi in slices(pc.binary_length(data).to_pylist(), at_once):
                made = fn(data.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[:-1]), *made], names=names)

    return df.select(*others(df, *drop, *(f.name for f in fields), "__in"), F.col(column).alias("__in") if isinstance(column, str) else column.alias("__in")).mapInArrow(run, schema)
