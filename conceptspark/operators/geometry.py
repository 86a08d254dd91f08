"""Subspaces of concepts and the shapes of their clouds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptspark.operators.quantiles import percentiles
from conceptspark.runtime import stored

#: Concepts of a chunk; a pair of chunks is one task group of bounded size.
CHUNK = 256


def bases(atoms: DataFrame) -> DataFrame:
    """(g, j, q): an orthonormal basis of every block's span."""

    def qr(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("j")
        q = np.linalg.qr(np.vstack(pdf["dec"]).T)[0].T
        return pd.DataFrame({"g": pdf["g"].iloc[0], "j": range(len(q)), "q": list(q)})

    return atoms.select("g", "j", "dec").groupBy("g").applyInPandas(qr, "g int, j int, q array<double>")


def _chunk_pairs(atoms: DataFrame, chunk: int, made, schema: str) -> DataFrame:
    """``made(ids, other ids, distances)`` of every pair of chunks, each pair one group of bounded size and one matrix product."""
    b = bases(atoms).groupBy("g").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("j", "q"))), lambda s: s["q"])).alias("q"), F.count("*").alias("k"))
    b = b.withColumn("c", F.floor(F.col("g") / chunk).cast("int"))
    top = F.lit(b.agg(F.max("c")).first()[0] or 0)
    left = b.withColumn("c2", F.explode(F.sequence(F.col("c"), top))).withColumnRenamed("c", "c1")
    right = b.withColumn("c1", F.explode(F.sequence(F.lit(0), F.col("c")))).withColumnRenamed("c", "c2")
    # Columns of the two sides must not share their identity, or pruning one prunes the other.
    right = right.select(*[F.col(c).alias(f"{c}_right") for c in right.columns]).toDF(*right.columns)

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return made(np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros((0, 0)))
        k = int(x["k"].iloc[0])
        a, c = (np.vstack(t["q"]).reshape(len(t) * k, -1) for t in (x, y))
        s = ((a @ c.T) ** 2).reshape(len(x), k, len(y), k).sum(axis=(1, 3))
        return made(x["g"].to_numpy(), y["g"].to_numpy(), np.sqrt(np.maximum(k - s, 0)))

    return left.groupBy("c1", "c2").cogroup(right.groupBy("c1", "c2")).applyInPandas(meet, schema)


def chordal(atoms: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(i, j, d), i < j: sqrt(k - |Qi Qj^T|^2) of every pair of blocks: all distances, for where all are asked for."""

    def made(x, y, d):
        i, j = np.meshgrid(x, y, indexing="ij")
        own = i < j
        return pd.DataFrame({"i": i[own], "j": j[own], "d": d[own]})

    return _chunk_pairs(atoms, chunk, made, "i int, j int, d double")


def nearest_blocks(atoms: DataFrame, n: int = 8, chunk: int = CHUNK) -> DataFrame:
    """(g, rank, other, d): the ``n`` nearest other blocks of each, ties by id.

    A pair of chunks lets go of all but the ``n`` best of each of its blocks, so what is
    shuffled and ranked is 2 n rows a block and chunk instead of a row a pair.
    """

    def best(x, y, d):
        for g, row in zip(x, d):
            own = y != g
            row, other = row[own], y[own]
            if len(row) > n:
                near = row <= np.partition(row, n - 1)[n - 1]
                row, other = row[near], other[near]
            order = np.lexsort((other, row))[:n]
            yield pd.DataFrame({"g": np.full(len(order), g), "other": other[order], "d": row[order]})

    def made(x, y, d):
        # Chunks hold ranges of ids: a pair of one chunk with itself meets every block both ways.
        parts = list(best(x, y, d)) + ([] if len(x) == len(y) and (x == y).all() else list(best(y, x, d.T)))
        return pd.concat(parts) if parts else pd.DataFrame({"g": [], "other": [], "d": []})

    rows = _chunk_pairs(atoms, chunk, made, "g int, other int, d double")
    rank = F.row_number().over(W.partitionBy("g").orderBy("d", "other"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def nearest(distances: DataFrame, n: int = 8) -> DataFrame:
    """(g, rank, other, d) from a table of distances (i, j, d)."""
    ends = F.explode(F.array(F.struct(F.col("i").alias("g"), F.col("j").alias("other")), F.struct(F.col("j").alias("g"), F.col("i").alias("other"))))
    rows = distances.select(ends.alias("e"), "d").select("e.g", "e.other", "d")
    rank = F.row_number().over(W.partitionBy("g").orderBy("d", "other"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def without_zeros(points: DataFrame) -> DataFrame:
    """Points (..., p) with a coordinate other than 0; zeros are padding."""
    return points.where(F.exists("p", lambda x: x != 0))


def chordal_summary(distances: DataFrame, k: int, d: int) -> DataFrame:
    """(n_pairs, median, mean, spread, random): spread is std / mean; random is what chance gives."""
    rows = stored(distances.select("d"), "chordal-distances")
    middle = percentiles(rows, "d", [0.5]).select(F.get("q", F.lit(0)).alias("median"))
    one = rows.agg(F.count("*").alias("n_pairs"), F.avg("d").alias("mean"), (F.stddev_pop("d") / F.avg("d")).alias("spread"))
    return one.crossJoin(middle).select("n_pairs", "median", "mean", "spread", F.lit(math.sqrt(k - k * k / d)).alias("random"))


def pca3(clouds: DataFrame) -> DataFrame:
    """(g, rank, x, y, z) of clouds (g, rank, code): coordinates on the top three principal axes.

    Sizes are those of a cloud sample, so a group is bounded.  Missing axes are 0.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        x = np.vstack(pdf["code"])
        x = x - x.mean(axis=0)
        v = np.linalg.svd(x, full_matrices=False)[2][:3]
        v *= np.where(v[np.arange(len(v)), np.abs(v).argmax(axis=1)] < 0, -1, 1)[:, None]
        p = np.zeros((len(x), 3))
        p[:, : len(v)] = x @ v.T
        return pd.DataFrame({"g": pdf["g"], "rank": pdf["rank"], "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

    return clouds.select("g", "rank", "code").groupBy("g").applyInPandas(fit, "g int, rank int, x double, y double, z double")


def main_axes(clouds: DataFrame) -> DataFrame:
    """(g, mean, axes) of clouds (g, rank, code): up to three principal axes, end to end."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack(pdf["code"])
        v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:3]
        v = v * np.where(v[np.arange(len(v)), np.abs(v).argmax(axis=1)] < 0, -1, 1)[:, None]
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "mean": [x.mean(axis=0)], "axes": [v.ravel()]})

    return clouds.select("g", "code").groupBy("g").applyInPandas(fit, "g int, mean array<double>, axes array<double>")


def overlay(firings: DataFrame, axes: DataFrame) -> DataFrame:
    """(g, unit, pos, act, p): every firing's code on its concept's main axes, in DataFrame functions."""
    rows = firings.join(axes, "g").withColumn("c", F.zip_with("code", "mean", lambda a, m: a - m))
    k = F.size("code")
    n = (F.size("axes") / k).cast("int")
    dot = lambda i: F.aggregate(F.zip_with("c", F.slice("axes", i * k + 1, k), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.select("g", "unit", "pos", "act", F.transform(F.sequence(F.lit(0), n - 1), dot).alias("p"))


def cloud_through_atoms(clouds: DataFrame, atoms: DataFrame) -> DataFrame:
    """``pca3`` of the d-dimensional cloud codes @ atoms, computed in k dimensions.

    With atoms = U S V^T, codes @ U S is the same cloud up to a rotation, so only the
    k x k matrix of a concept is needed.
    """

    def small(pdf: pd.DataFrame) -> pd.DataFrame:
        u, s, _ = np.linalg.svd(np.vstack(pdf.sort_values("j")["dec"]), full_matrices=False)
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "us": [(u * s).ravel()]})

    us = atoms.select("g", "j", "dec").groupBy("g").applyInPandas(small, "g int, us array<double>")

    @F.pandas_udf("array<double>")
    def turn(code: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(c) @ np.asarray(a).reshape(len(c), -1) for c, a in zip(code, m)])

    return pca3(clouds.join(us, "g").select("g", "rank", turn("code", "us").alias("code")))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def radial_clip(points: DataFrame, share: float = 0.98) -> DataFrame:
    """Points (g, ..., p) scaled back to the ``share`` percentile of their concept's norms."""
    rows = points.withColumn("__n", norm(F.col("p")))
    cap = percentiles(rows, "__n", [share], ["g"]).select("g", F.get("q", F.lit(0)).alias("__cap"))
    rows = rows.join(cap, "g")
    return rows.withColumn("p", F.transform("p", lambda x: x * F.least(F.lit(1.0), F.col("__cap") / F.greatest(F.col("__n"), F.lit(1e-12))))).drop("__n", "__cap")


def direction_color(p: Column, saturation: float = 0.9) -> Column:
    """clip(0.5 + 0.5 p / |p| * saturation, 0, 1), per coordinate."""
    n = F.greatest(norm(p), F.lit(1e-12))
    return F.transform(p, lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + 0.5 * x / n * saturation)))


def intensity(points: DataFrame) -> DataFrame:
    """Add the norm of p over the concept's largest."""
    top = points.withColumn("__n", norm(F.col("p")))
    best = top.groupBy("g").agg(F.max("__n").alias("__m"))
    return top.join(best, "g").withColumn("intensity", F.col("__n") / F.greatest("__m", F.lit(1e-12))).drop("__n", "__m")


def lat_lon(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Degrees on the unit sphere of a point's direction."""
    n = F.greatest(F.sqrt(x * x + y * y + z * z), F.lit(1e-12))
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z / n)))), F.degrees(F.atan2(y, x))


def sphere_points(clouds: DataFrame) -> DataFrame:
    """(g, rank, lat, lon, r) of clouds centred and turned to their three main axes."""
    p = pca3(clouds)
    lat, lon = lat_lon(F.col("x"), F.col("y"), F.col("z"))
    return p.select("g", "rank", lat.alias("lat"), lon.alias("lon"), F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2).alias("r"))


def patch_side(n_patches: int) -> int:
    """Side of a square patch grid."""
    side = math.isqrt(n_patches)
    if side * side != n_patches:
        raise ValueError(f"{n_patches} patches are no square grid")
    return side
