"""Shape census of concept clouds, and fits on the sphere.

A cloud is (g, rank, p) with p an array of coordinates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptspark.operators.geometry import norm
from conceptspark.operators.quantiles import percentiles

#: Fixed values of the census: fewest points, the inner radius and the share a filled disc has inside it.
LEAST, INNER, FILLED = 30, 0.4, 0.16


def participation(clouds: DataFrame) -> DataFrame:
    """(g, n, participation): squared trace of the covariance over its squared norm; no eigenvalues needed."""
    long = clouds.select("g", "rank", F.posexplode("p").alias("a", "x"))
    mean = long.groupBy("g", "a").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    c = long.join(mean, ["g", "a"]).select("g", "rank", "a", "n", (F.col("x") - F.col("m")).alias("x"))
    rows = c.groupBy("g", "rank").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("a", "x"))).alias("v"))
    prod = rows.select("g", "n", F.explode("v").alias("u"), "v").select("g", "n", "u", F.explode("v").alias("w"))
    cov = prod.groupBy("g", F.col("u.a").alias("a"), F.col("w.a").alias("b")).agg((F.sum(F.col("u.x") * F.col("w.x")) / F.greatest(F.max("n") - 1, F.lit(1))).alias("c"), F.max("n").alias("n"))
    trace = F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0.0))
    return cov.groupBy("g").agg(F.max("n").alias("n"), (trace * trace / F.greatest(F.sum(F.col("c") * F.col("c")), F.lit(1e-300))).alias("participation"))


def planar(clouds: DataFrame) -> DataFrame:
    """(g, annularity, hollow) from the first two coordinates."""
    xy = clouds.select("g", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))
    mid = xy.groupBy("g").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    r = xy.join(mid, "g").select("g", F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2).alias("r"))
    cap = percentiles(r, "r", [0.98], ["g"]).select("g", F.get("q", F.lit(0)).alias("rmax"))
    rows = r.join(cap, "g").groupBy("g").agg((F.avg("r") / F.greatest(F.stddev_pop("r"), F.lit(1e-9))).alias("annularity"), F.avg((F.col("r") < INNER * F.col("rmax")).cast("double")).alias("inner"))
    return rows.select("g", "annularity", F.when(F.col("inner") < FILLED, 1 - F.col("inner") / FILLED).otherwise(0.0).alias("hollow"))


def antipodal(clouds: DataFrame, first: int = 200) -> DataFrame:
    """(g, antipodal): how near a cloud's points have an opposite.

    1 - median over a of min over b of |a + b|, over twice the mean norm.  The definition
    takes a concept's first ``first`` points, so a group is bounded.
    """

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.vstack(pdf.sort_values("rank")["p"].head(first))
        sq = (p * p).sum(axis=1)
        d = np.sqrt(np.maximum(sq[:, None] + sq[None, :] + 2 * p @ p.T, 0)).min(axis=1)
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "antipodal": [1 - np.median(d) / max(2 * np.sqrt(sq).mean(), 1e-12)]})

    return clouds.where(F.col("rank") <= first).select("g", "rank", "p").groupBy("g").applyInPandas(of, "g int, antipodal double")


def census(clouds: DataFrame, least: int = LEAST) -> DataFrame:
    """(g, n, participation, annularity, hollow, antipodal) of clouds with enough points."""
    out = participation(clouds).join(planar(clouds), "g").join(antipodal(clouds), "g")
    return out.where(F.col("n") >= least)


def gallery(census_: DataFrame, n: int = 12) -> DataFrame:
    """The most ring-like clouds: by annularity * (1 + hollow)."""
    return census_.withColumn("score", F.col("annularity") * (1 + F.col("hollow"))).orderBy(F.col("score").desc(), "g").limit(n)


def counts(census_: DataFrame, ring: float = 3.0, anti: float = 0.8) -> DataFrame:
    return census_.agg(F.count("*").alias("n"), F.count_if(F.col("annularity") > ring).alias("ring_like"), F.count_if(F.col("antipodal") > anti).alias("antipodal"))


def harmonics(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Real spherical harmonics up to degree 3 at unit vectors, unnormalised: 16 columns."""
    one = np.ones_like(x)
    return np.stack([one, x, y, z, x * y, y * z, 3 * z * z - 1, x * z, x * x - y * y, y * (3 * x * x - y * y), x * y * z, y * (5 * z * z - 1), z * (5 * z * z - 3), x * (5 * z * z - 1), z * (x * x - y * y), x * (x * x - 3 * y * y)], axis=1)


def sphere_fit(points: DataFrame, ridge: float = 1e-3) -> DataFrame:
    """(g, n, r2, coef): ridge fit of log r on the harmonics of (lat, lon), per concept.

    The normal equations of every concept are summed by Spark from per-task parts, so a
    concept may have any number of points.
    """

    def parts(batches):
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            la, lo = np.radians(pdf["lat"]), np.radians(pdf["lon"])
            h = harmonics((np.cos(la) * np.cos(lo)).to_numpy(), (np.cos(la) * np.sin(lo)).to_numpy(), np.sin(la).to_numpy())
            a = np.hstack([h, np.log(np.maximum(pdf["r"].to_numpy(), 1e-12))[:, None]])
            for g in pdf["g"].unique():
                own = a[(pdf["g"] == g).to_numpy()]
                total[g] = total.get(g, 0) + own.T @ own
        for g, m in total.items():
            yield pd.DataFrame({"g": [g], "m": [m.ravel()]})

    sums = points.select("g", "lat", "lon", "r").mapInPandas(parts, "g int, m array<double>").select("g", F.posexplode("m").alias("i", "x")).groupBy("g", "i").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))

    @F.pandas_udf("n long, r2 double, coef array<double>")
    def solve(s: pd.Series) -> pd.DataFrame:
        out = []
        for v in s:
            m = np.asarray(v).reshape(17, 17)
            a, b, yy, n = m[:16, :16], m[:16, 16], m[16, 16], m[0, 0]
            c = np.linalg.solve(a + ridge * np.eye(16), b)
            rss, tss = yy - 2 * c @ b + c @ a @ c, yy - b[0] ** 2 / n
            out.append((int(round(n)), 1 - rss / max(tss, 1e-12), list(c)))
        return pd.DataFrame(out, columns=["n", "r2", "coef"])

    return rows.withColumn("f", solve("m")).select("g", "f.n", "f.r2", "f.coef")


def sphere_grid(fits: DataFrame, step: int = 15) -> DataFrame:
    """(g, lat, lon, r): fitted surfaces on a grid of latitudes and longitudes."""

    def grid(batches):
        la, lo = (v.ravel() for v in np.meshgrid(np.arange(-90, 91, step), np.arange(-180, 180, step), indexing="ij"))
        a, b = np.radians(la), np.radians(lo)
        h = harmonics(np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a))
        for pdf in batches:
            for g, c in zip(pdf["g"], pdf["coef"]):
                yield pd.DataFrame({"g": g, "lat": la, "lon": lo, "r": np.exp(h @ np.asarray(c))})

    return fits.select("g", "coef").mapInPandas(grid, "g int, lat int, lon int, r double")


def with_norm(points: DataFrame) -> DataFrame:
    return points.withColumn("norm", norm(F.col("p")))
