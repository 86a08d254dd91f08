"""Shared folders and intermediate tables.

Executors and the driver share only the folder named by ``spark.checkpoint.dir``,
so every intermediate table goes there.  A written table also cuts lineage: a lost
executor costs a re-read, not a recomputation from the source.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this session; a temporary one where none is set (local tests)."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="conceptspark-"))
    return sc.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and return the table read back.

    ``options`` are those of the writer, such as ``compression``.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def others(df: DataFrame, *names: str) -> list:
    """The columns of ``df`` but those named (any case), quoted so that odd names pass."""
    gone = {n.lower() for n in names}
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in gone]
