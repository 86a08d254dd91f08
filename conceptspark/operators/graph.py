"""Connected components and layouts of a weighted graph (i, j, w)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptspark.operators.cofiring import both_ways
from conceptspark.operators.quantiles import percentiles
from conceptspark.runtime import stored


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(g, component): the smallest concept reachable, for every concept with an edge.

    Labels spread along edges and then jump to their label's label, so the rounds grow
    with the logarithm of the longest path.  Each round is a written table.
    """
    links = stored(both_ways(edges.select("i", "j")), "graph-links")
    labels = stored(links.groupBy("g").agg(F.least(F.col("g"), F.min("other")).alias("component")), "graph-labels")
    for _ in range(max_rounds):
        near = links.join(labels.withColumnRenamed("g", "other"), "other").groupBy("g").agg(F.min("component").alias("near"))
        step = labels.join(near, "g").select("g", F.least("component", "near").alias("next"), F.col("component").alias("was"))
        jump = step.select(F.col("g").alias("next"), F.col("next").alias("far"))
        new = stored(step.join(jump, "next").select("g", F.least("next", "far").alias("component"), "was"), "graph-labels")
        moved = new.where(F.col("component") != F.col("was")).limit(1).count()
        labels = new.select("g", "component")
        if not moved:
            return labels
    raise RuntimeError("components did not settle")


def component_sizes(edges: DataFrame) -> DataFrame:
    return components(edges).groupBy("component").agg(F.count("*").alias("size"))


def _sums(table: DataFrame, columns: list[str], width: int) -> dict[str, np.ndarray]:
    """For each named array column y, the matrix of the sums of v[a] * y[b] over all rows."""
    at = [(c, i, j) for c in columns for i in range(width) for j in range(width)]
    row = table.agg(*[F.sum(F.get("v", F.lit(i)) * F.get(c, F.lit(j))).alias(f"s{n}") for n, (c, i, j) in enumerate(at)]).first()
    out = {c: np.zeros((width, width)) for c in columns}
    for n, (c, i, j) in enumerate(at):
        out[c][i, j] = row[n] or 0.0
    return out


def _mix(column: str, by: np.ndarray) -> Column:
    """An array column times a small matrix."""
    return F.array(*[sum((F.get(column, F.lit(i)) * float(by[i, j]) for i in range(len(by))), F.lit(0.0)) for j in range(by.shape[1])])


def leading_vectors(matrix: DataFrame, nodes: DataFrame, rounds: int = 60, tol: float = 1e-5) -> tuple[DataFrame, np.ndarray, float]:
    """(table (g, r, v), eigenvalues, residual) of the second and third eigenvectors of half (I + M).

    ``matrix`` is M = D^-1/2 A D^-1/2 as (g, other, m), both ways; ``nodes`` (g, r, a, b) has
    the roots of the degrees, which are M's first eigenvector and are kept out, and two start
    vectors.  Vectors are rows of tables throughout: a round writes one product and sends
    sums of at most 6 x 6 numbers to the driver, which finds the best two vectors among the
    current ones, their residuals and the last step.  It ends when the residual is below
    ``tol`` or after ``rounds``.
    """
    whole = nodes.agg(F.sum(F.col("r") * F.col("r"))).first()[0]

    def shares(column: str, n: int) -> list[Column]:
        """How much of M's first eigenvector each of the vectors holds."""
        return [F.sum(F.get(column, F.lit(i)) * F.col("r")) / whole for i in range(n)]

    def deflated(rows: DataFrame, column: str, own) -> DataFrame:
        return rows.withColumn(column, F.array(*[F.get(column, F.lit(i)) - F.col("r") * float(c or 0.0) for i, c in enumerate(own)]))

    def product(rows: DataFrame, column: str, n: int) -> DataFrame:
        """``rows`` with hv, half (I + M) times ``column``."""
        near = rows.select(F.col("g").alias("other"), F.col(column).alias("y"))
        sums = matrix.join(near, "other").groupBy("g").agg(*[F.sum(F.col("m") * F.get("y", F.lit(i))).alias(f"y{i}") for i in range(n)])
        hv = F.array(*[(F.get(column, F.lit(i)) + F.coalesce(F.col(f"y{i}"), F.lit(0.0))) / 2 for i in range(n)])
        return rows.join(sums, "g", "left").withColumn("hv_new", hv).drop(*[f"y{i}" for i in range(n)])

    start = nodes.select("g", "r", F.array("a", "b").alias("v"))
    now = stored(product(deflated(start, "v", start.agg(*shares("v", 2)).first()), "v", 2).withColumnRenamed("hv_new", "hv"), "layout-vectors")
    width = 2
    while True:
        sums = _sums(now, ["v", "hv"], width)
        # An orthonormal basis of the space, without directions that hold nothing.
        scale = 1 / np.sqrt(np.maximum(np.diag(sums["v"]), 1e-300))
        have, turn = np.linalg.eigh(sums["v"] * scale[:, None] * scale)
        basis = (scale[:, None] * turn / np.sqrt(np.maximum(have, 1e-300)))[:, have > 1e-10]
        held = basis.T @ ((sums["hv"] + sums["hv"].T) / 2) @ basis
        values, best = np.linalg.eigh(held)
        values, best = values[::-1][:2], (basis @ best[:, ::-1])[:, :2]
        n = best.shape[1]
        step = best.copy()
        step[:2] = 0
        kept = now.select("g", "r", _mix("v", best).alias("v"), _mix("hv", best).alias("hv"), *([_mix("v", step).alias("p"), _mix("hv", step).alias("hp")] if width > 2 else []))
        off = F.array(*[F.get("hv", F.lit(i)) - F.get("v", F.lit(i)) * float(values[i]) for i in range(n)])
        kept = kept.withColumn("w", off)
        left = kept.agg(*[F.sum(F.get("w", F.lit(i)) * F.get("w", F.lit(i))) for i in range(n)], *shares("w", n)).first()
        residual = float(np.sqrt(max(left[:n])))
        rounds -= 1
        if residual <= tol or rounds <= 0:
            return kept.select("g", "r", "v"), values, residual
        grown = product(deflated(kept, "w", left[n:]), "w", n)
        more = ["p"] if width > 2 else []
        now = stored(grown.select("g", "r", F.concat("v", "w", *more).alias("v"), F.concat("hv", "hv_new", *["h" + c for c in more]).alias("hv")), "layout-vectors")
        width = n * (2 + len(more))


def spectral_layout(edges: DataFrame, concepts: DataFrame, rounds: int = 60, tol: float = 1e-5, seed: int = 0) -> DataFrame:
    """(g, x, y, component, residual) of every concept.

    The giant component is laid out by the second and third eigenvectors of
    half (I + D^-1/2 A D^-1/2), found by ``leading_vectors``, whose residual stands in every
    row of that component.  Coordinates are scaled by their 98th percentile and clipped at
    1.5.  Other concepts stand on a ring of radius 2 to 2.25, or on the unit circle where
    there are no edges.
    """
    links = stored(both_ways(edges), "layout-links")
    every = concepts.select("g").distinct()

    def unit(salt):
        key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.lit(salt), F.col("g").cast("string")).cast("binary"))
        return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / float(1 << 32)

    angle = unit("angle") * (2 * math.pi)
    nothing = F.lit(None).cast("double").alias("residual")
    if links.limit(1).count() == 0:
        return every.select("g", F.cos(angle).alias("x"), F.sin(angle).alias("y"), F.lit(None).cast("int").alias("component"), nothing)
    parts = stored(components(edges), "layout-parts")
    giant = parts.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.col("size").desc(), "component").first()
    inside = parts.where(F.col("component") == giant["component"]).select("g")
    own = links.join(inside, "g", "left_semi")
    nodes = stored(own.groupBy("g").agg(F.sqrt(F.sum("w")).alias("r"), F.max(unit("x") - 0.5).alias("a"), F.max(unit("y") - 0.5).alias("b")), "layout-nodes")
    if giant["size"] >= 3:
        far = nodes.select(F.col("g").alias("other"), F.col("r").alias("o"))
        matrix = stored(own.join(nodes.select("g", "r"), "g").join(far, "other").select("g", "other", (F.col("w") / F.col("r") / F.col("o")).alias("m")), "layout-matrix")
        vectors, _, residual = leading_vectors(matrix, nodes, rounds, tol)
        raw = stored(vectors.select("g", *[(F.coalesce(F.get("v", F.lit(i)), F.lit(0.0)) / F.col("r")).alias(c) for i, c in enumerate("xy")]), "layout-places")
        axes = raw.select(F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.abs(c).alias("n")) for c in "xy"])).alias("a")).select("a.axis", "a.n")
        cap = {r["axis"]: max(r["q"][0], 1e-12) for r in percentiles(axes, "n", [0.98], ["axis"]).collect()}  # two rows
        flat = raw.select("g", *[F.greatest(F.lit(-1.5), F.least(F.lit(1.5), F.col(c) / cap[c])).alias(c) for c in "xy"], F.lit(residual).alias("residual"))
    else:
        flat = nodes.select("g", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), nothing)
    radius = 2 + 0.25 * unit("radius")
    rest = every.join(inside, "g", "left_anti").select("g", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"), nothing)
    return flat.unionByName(rest).join(parts, "g", "left").select("g", "x", "y", "component", "residual")


def double_centred(distances: DataFrame) -> DataFrame:
    """(i, j, b) of -1/2 (d2 - row mean - column mean + grand mean), d2 squared distances of all ordered pairs."""
    d2 = distances.select("i", "j", (F.col("d") * F.col("d")).alias("d2"))
    row = d2.groupBy("i").agg(F.avg("d2").alias("ri"))
    grand = d2.agg(F.avg("d2").alias("m"))
    out = d2.join(row, "i").join(row.select(F.col("i").alias("j"), F.col("ri").alias("rj")), "j").crossJoin(F.broadcast(grand))
    return out.select("i", "j", (-0.5 * (F.col("d2") - F.col("ri") - F.col("rj") + F.col("m"))).alias("b"))
