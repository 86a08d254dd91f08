"""Saving, loading and checking analysis artifacts: a folder of Parquet tables."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
KINDS = ("free", "tied", "threshold", "soft")


class ArtifactError(ValueError):
    """The artifact is not what it says."""


def save(tables: dict[str, DataFrame], meta: dict, path: str, spark: SparkSession | None = None) -> None:
    """Write the tables, and one row of meta with the version last; without tables, name the session."""
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = spark or next(iter(tables.values())).sparkSession
    spark.createDataFrame([{"version": VERSION, **meta}]).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str, names: list[str]) -> tuple[dict[str, DataFrame], dict]:
    meta = spark.read.parquet(f"{path}/meta").first().asDict()
    if meta["version"] != VERSION:
        raise ArtifactError(f"version {meta['version']}, expected {VERSION}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}, meta


def stats_table(stats: DataFrame, layer: int, hook: str, drop_first: int, max_rows: int | None, path: str) -> None:
    """Keep normalisation statistics under all of what they depend on."""
    key = stats.withColumns({"layer": F.lit(layer), "hook": F.lit(hook), "drop_first": F.lit(drop_first), "max_rows": F.lit(max_rows if max_rows is not None else -1)})
    key.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer", "hook", "drop_first", "max_rows").parquet(path)


def cached_stats(spark: SparkSession, path: str, key: dict, compute: Callable[[], DataFrame], recompute: bool = False) -> DataFrame:
    """Statistics under all of what they depend on (layer, hook, drop_first, max_rows ...): loaded, or computed and kept.

    The marker is written after the table, so a broken run leaves nothing that would be loaded.
    """
    folder = path + "/" + "/".join(f"{k}={quote(str(v), safe='')}" for k, v in sorted(key.items()))
    if not recompute:
        try:
            at = spark.read.parquet(f"{folder}/done").first()["at"]
            return spark.read.parquet(f"{folder}/{at}")
        except AnalysisException:
            pass
    at = uuid.uuid4().hex
    compute().write.parquet(f"{folder}/{at}")
    spark.createDataFrame([(at,)], "at string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/done")
    return spark.read.parquet(f"{folder}/{at}")


def one_row_each(table: DataFrame, n_groups: int) -> DataFrame:
    """Concepts of 0 .. G-1 that do not have exactly one row, and rows outside: (g, n)."""
    spark = table.sparkSession
    have = table.groupBy("g").agg(F.count("*").alias("n"))
    every = spark.range(n_groups).select(F.col("id").cast("int").alias("g"), F.lit(True).alias("known"))
    return every.join(have, "g", "full").where(F.col("known").isNull() | F.col("n").isNull() | (F.col("n") != 1)).select("g", F.coalesce("n", F.lit(0)).alias("n"))


def bad_edges(edges: DataFrame, n_groups: int) -> DataFrame:
    i, j, w = F.col("i"), F.col("j"), F.col("w")
    return edges.where(i.isNull() | j.isNull() | w.isNull() | (i < 0) | (j < 0) | (i >= n_groups) | (j >= n_groups) | (i >= j))


def uncovered(table: DataFrame, concepts: DataFrame) -> DataFrame:
    """Concepts without a row in ``table``."""
    return concepts.select("g").join(table.select("g"), "g", "left_anti")


def bad_points(points: DataFrame) -> DataFrame:
    return points.where(F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull() | F.col("token").isNull())


def bad_quantiles(q: DataFrame, slack: float = 1e-3) -> DataFrame:
    cols = ["q_min", "q25", "q50", "q75", "q_max"]
    bad = F.lit(False)
    for a, b in zip(cols, cols[1:]):
        bad = bad | (F.col(b) < F.col(a) - slack)
    return q.where(bad)


def bad_distances(distances: DataFrame, k: int) -> DataFrame:
    return distances.where(~F.col("d").between(-1e-6, math.sqrt(k) + 1e-3))


def check_model(atoms: DataFrame, meta: dict) -> None:
    """Geometry of a checkpoint of any kind; raises where it is off."""
    if meta.get("kind") not in KINDS:
        raise ArtifactError(f"unknown kind {meta.get('kind')!r}")
    if meta["kind"] in ("free", "tied") and not meta.get("l0"):
        raise ArtifactError("a top-k model needs its l0")
    r = atoms.agg(F.count_distinct("g").alias("g"), F.count("*").alias("n"), F.min(F.size("dec")).alias("lo"), F.max(F.size("dec")).alias("hi")).first()
    if (r["g"], r["n"], r["lo"], r["hi"]) != (meta["n_groups"], meta["n_groups"] * meta["group_size"], meta["d"], meta["d"]):
        raise ArtifactError(f"the tables hold {r.asDict()}, the meta row says {meta}")


def save_codes(codes: DataFrame, path: str, buckets: int = 64) -> None:
    """Codes in folders of concept buckets, each concept's codes together."""
    codes.withColumn("bucket", F.pmod(F.hash("g"), F.lit(buckets))).repartition("bucket").sortWithinPartitions("g").write.mode("overwrite").partitionBy("bucket").parquet(path)


def save_census(census: DataFrame, path: str) -> None:
    census.write.mode("overwrite").json(path)
