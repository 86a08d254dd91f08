"""From a capture tree and a checkpoint to a complete artifact: one encoding pass, then tables.

Rows are read, filtered and normalised as at training, encoded once, and the firings are
stored; every table of the artifact is a query on them or on the checkpoint's blocks.  The
tables are checked as read back, and the meta row is written only after they hold.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptspark.operators import artifact, cofiring, concepts, encode, geometry, graph, layout, normalize, tokens as words
from conceptspark.runtime import stored
from conceptspark.sources import captures

#: Tables of an artifact.
TABLES = ("firings", "concepts", "quantiles", "examples", "bands", "points", "partners", "edges", "neighbours")
#: Points a cloud needs to be drawn.
LEAST_POINTS = 4


def gate_of(atoms: DataFrame, meta: dict) -> encode.Gate:
    """The gate that a checkpoint's kind asks for."""
    if meta["kind"] in ("free", "tied"):
        return encode.TopK(int(meta["l0"]))
    rows = atoms.groupBy("g").agg(F.max("theta").alias("theta")).orderBy("g").collect()
    theta = np.array([r["theta"] for r in rows])
    return encode.Soft(theta) if meta["kind"] == "soft" else encode.Threshold(theta, max(float(meta["norm_scale"]), 1e-6))


def captured_acts(spark: SparkSession, root: str, layer: int, hook: str, drop: int = 0, requests: int | None = None) -> DataFrame:
    """(token_id, unit, pos, x) of a hook's rows from position ``drop`` on, of the first requests.

    Positions stay those of the request.  A row's token_id is distinct within one evaluation.
    """
    rows = captures.read(spark, root, layer, hook).select(F.col("request_id").alias("unit"), F.col("pos").cast("int").alias("pos"), F.col("x").cast("array<double>").alias("x"))
    rows = rows if requests is None else normalize.first_units(rows, requests)
    return normalize.drop_first(rows, drop).select(F.monotonically_increasing_id().alias("token_id"), "unit", "pos", "x")


def build(spark: SparkSession, root: str, layer: int, hook: str, atoms: DataFrame, meta: dict, path: str, tokens: DataFrame | None = None, requests: int | None = None, drop: int = 0,
          top_k: int = 12, neighbours: int = 8, points: int = 200, context: int = 4, per_band: int = 4, per_unit: int = 8, threshold: float = 0.1, method: str = "graph",
          seed: int = 0, report: Callable[[str, dict], None] | None = None) -> tuple[dict[str, DataFrame], dict]:
    """Write an artifact to ``path`` and return it as ``artifact.load`` does.

    ``atoms`` (g, j, dec, enc, bias, theta) and ``meta`` are a checkpoint's tables; ``tokens``
    (unit, pos, token) those of the requests, places without one read ``<pos>``.  ``drop``
    must be what the checkpoint was trained with; it chooses the statistics too, which are
    those of all requests.  ``method`` is ``graph`` or one of ``layout.classical_mds``.
    No rows, or a checkpoint of another geometry, are an ``ArtifactError``.
    """
    artifact.check_model(atoms, meta)
    n_groups, size = int(meta["n_groups"]), int(meta["group_size"])
    key = {"layer": layer, "hook": hook, "drop_first": drop, "max_rows": -1}
    stats = artifact.cached_stats(spark, f"{path}-stats", key, lambda: normalize.norm_stats(captured_acts(spark, root, layer, hook, drop)))
    if stats.first()["d"] != meta["d"]:
        raise artifact.ArtifactError(f"rows of {stats.first()['d']} dimensions, a checkpoint of {meta['d']}")
    acts = normalize.normalize(captured_acts(spark, root, layer, hook, drop, requests), stats)
    found, progress = encode.firings_with_progress(acts, encode.Dictionary.of(atoms), gate_of(atoms, meta), report)
    found.write.mode("overwrite").parquet(f"{path}/firings")
    seen = progress.get()
    if not seen["n_rows"]:
        raise artifact.ArtifactError(f"no rows of layer {layer}, {hook} under {root}")
    firings = spark.read.parquet(f"{path}/firings")
    every = atoms.select("g").distinct()
    if tokens is None:
        tokens = spark.createDataFrame([], "unit string, pos int, token string")
    # Three tables look tokens up: those of the captured requests are read and split once.
    tokens = stored(words.of_units(tokens.select("unit", "pos", "token"), firings.select("unit").distinct()), "analysis-tokens")
    narrow = firings.drop("code")

    all_edges = stored(cofiring.edges(narrow, threshold), "analysis-edges")
    if method == "graph":
        place = graph.spectral_layout(all_edges, every, seed=seed).select("g", "x", "y")
    else:
        place = layout.classical_mds(atoms, method)
    n_tokens = int(seen["n_rows"])
    table = concepts.fire_stats_all(narrow, every, n_tokens).join(concepts.near_threshold(narrow), "g", "left").join(place, "g", "left").na.fill(0.0, ["near_threshold_frac"])
    clouds = stored(concepts.cloud_sample(firings, per_unit, points), "analysis-clouds")
    enough = clouds.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_POINTS).select("g")
    drawn = geometry.cloud_through_atoms(clouds.join(enough, "g", "left_semi"), atoms)
    named = words.lookup(clouds.select("g", "rank", "unit", "pos", "act"), tokens)
    share, half = layout.embedding_quality(atoms)
    made = {
        "concepts": table,
        "quantiles": concepts.act_quantiles(narrow),
        "examples": words.examples_with_context(concepts.top_examples(narrow, top_k), tokens, context),
        "bands": words.examples_with_context(concepts.bands(narrow, per_band), tokens, context),
        "points": drawn.join(named, ["g", "rank"]),
        "partners": cofiring.partners(narrow, neighbours),
        "edges": all_edges,
        "neighbours": geometry.nearest_blocks(atoms, neighbours),
    }
    for name, t in made.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")
    written = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    bad = {name: n for name, n in faults(written, n_groups, size).items() if n}
    if bad:
        raise artifact.ArtifactError(f"tables that do not hold: {bad}")
    artifact.save({}, {
        "layer": layer, "hook": hook, "d": int(meta["d"]), "n_groups": n_groups, "group_size": size, "kind": meta["kind"], "n_tokens": n_tokens,
        "n_units": acts.select("unit").distinct().count(), "drop_first": drop, "mean_l0": float(seen["mean_l0"]), "method": method, "seed": seed, "share_in_two": float(share), "dims_for_half": int(half),
        "threshold": float(threshold), "edges_found": cofiring.edges_found(narrow, threshold).first()[0]}, path, spark)
    return artifact.load(spark, path, list(TABLES))


def faults(tables: dict[str, DataFrame], n_groups: int, size: int) -> dict[str, int]:
    """How many rows of each table break what an artifact promises."""
    t = tables
    inside = F.col("g").between(0, n_groups - 1) & F.col("other").between(0, n_groups - 1) & (F.col("g") != F.col("other"))
    return {
        "concepts": artifact.one_row_each(t["concepts"], n_groups).count(),
        "places": t["concepts"].where(F.col("x").isNull() | F.col("y").isNull()).count(),
        "edges": artifact.bad_edges(t["edges"], n_groups).count(),
        "quantiles": artifact.bad_quantiles(t["quantiles"]).count(),
        "points": artifact.bad_points(t["points"]).count(),
        "distances": artifact.bad_distances(t["neighbours"], size).count(),
        "neighbours": t["neighbours"].where(~inside).count(),
        "partners": t["partners"].where(~inside).count(),
        "examples": artifact.uncovered(t["examples"], t["firings"].select("g").distinct()).count(),
        "bands": artifact.uncovered(t["bands"], t["firings"].select("g").distinct()).count(),
    }
