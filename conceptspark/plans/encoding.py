"""Queries on rows, statistics, encoding and decoding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from conceptspark.operators import concepts, encode, normalize
from conceptspark.operators.state import softplus_theta
from conceptspark.plans import bindings as b
from conceptspark.runtime import stored, table


def r6(c):
    return F.round(c, 6)


def _groups() -> int:
    return b.N_ATOMS // b.GROUP


def _theta(spark) -> np.ndarray:
    return 0.2 + 0.01 * np.arange(_groups())


def _model(spark, sf):
    return encode.Dictionary.of(b.atoms(spark, sf))


def _stats(acts):
    one = normalize.norm_stats(acts)
    return one.select("n", "d", "scale", F.posexplode("mean").alias("dim", "mean")).select("dim", r6("mean").alias("mean"), r6("scale").alias("scale"), "n", F.col("d").cast("long").alias("d"))


def norm_stats(spark, sf):
    return _stats(b.acts(spark, sf))


def norm_stats_drop_first(spark, sf):
    return _stats(normalize.drop_first(b.acts(spark, sf), 5))


def normalized_energy(spark, sf):
    acts = b.acts(spark, sf)
    rows = normalize.normalize(acts, normalize.norm_stats(acts))
    return rows.select("token_id", r6(encode.dot(F.col("x"), F.col("x"))).alias("energy"))


def position_mean_center(spark, sf):
    out = normalize.center_positions(b.acts(spark, sf))
    return out.groupBy("pos").agg(F.count("*").alias("n"), r6(F.sum(F.col("value") * F.col("value"))).alias("energy"))


def unit_row_counts(spark, sf):
    units = b.events(spark, sf).groupBy("unit").agg(F.count("*").alias("n"))
    return units.select("unit", F.greatest(F.col("n") - 3, F.lit(0)).alias("n"))


def steps_per_epoch(spark, sf):
    units = b.events(spark, sf).groupBy("unit").agg(F.count("*").alias("n"))
    return normalize.steps_per_epoch(units, 3, 256, 2)


def first_units(spark, sf):
    return normalize.first_units(b.acts(spark, sf), 3).select("token_id", "unit", "pos")


def inferred_d(spark, sf):
    return b.acts(spark, sf).select(F.size("x").alias("d")).groupBy("d").agg(F.count("*").alias("n"))


def epoch_batches(spark, sf):
    return normalize.epoch_batches(b.acts(spark, sf).select("token_id"), 64).groupBy("step").agg(F.count("*").alias("n"), F.sum("token_id").cast("long").alias("ids"))


def shuffle_epoch(spark, sf):
    acts = b.acts(spark, sf)
    return acts.select("token_id", normalize.shuffle_key(0, 1).alias("key")).orderBy("key", "token_id")


def _codes(fr):
    return fr.select("token_id", "g", r6("act").alias("act"), r6(F.get("code", F.lit(0)) + 0.0).alias("c0"), r6(F.get("code", F.lit(1)) + 0.0).alias("c1"))


def encode_topk(spark, sf):
    return _codes(b.firings(spark, sf))


def encode_threshold(spark, sf):
    gate = encode.Threshold(_theta(spark), 0.9)
    return _codes(encode.firings(b.acts(spark, sf), _model(spark, sf), gate))


def encode_soft(spark, sf):
    return _codes(encode.firings(b.acts(spark, sf), _model(spark, sf), encode.Soft(_theta(spark))))


def encode_tied(spark, sf):
    model = _model(spark, sf)
    model.gamma = 1 + 0.1 * np.arange(model.n_groups)
    fr = encode.firings(b.acts(spark, sf), model.orthonormal(), encode.TopK(b.L0))
    return fr.select("token_id", "g", r6("act").alias("act"))


def unit_blocks(spark, sf):
    return encode.unit_blocks(b.atoms(spark, sf)).select("g", "j", F.posexplode("dec").alias("dim", "v")).select("g", "j", "dim", r6("v").alias("v"))


def theta_softplus(spark, sf):
    groups = b.atoms(spark, sf).select("g").distinct()
    raw = (F.col("g") - 8) / F.lit(10.0)
    return groups.select("g", r6(softplus_theta(raw)).alias("theta"))


def decode_rows(spark, sf):
    out = encode.decode_table(b.firings(spark, sf), b.atoms(spark, sf))
    return out.select("token_id", "dim", r6(F.col("value") + 0.0).alias("value"))


def _reconstructed(spark, sf):
    return encode.reconstruct(b.acts(spark, sf), _model(spark, sf), encode.TopK(b.L0))


def _sse(rows):
    long = rows.select("token_id", F.posexplode(F.arrays_zip("x", "x_hat")).alias("dim", "p")).select("token_id", "dim", F.col("p.x").alias("x"), F.col("p.x_hat").alias("h"))
    mean = long.groupBy("dim").agg(F.avg("x").alias("m"))
    e = long.join(F.broadcast(mean), "dim")
    return e.agg(F.sum((F.col("x") - F.col("h")) ** 2).alias("res"), F.sum((F.col("x") - F.col("m")) ** 2).alias("tot"), F.count_distinct("token_id").alias("n"))


def reconstruct_sse(spark, sf):
    return _sse(_reconstructed(spark, sf)).select(r6("res").alias("ss_res"), r6("tot").alias("ss_tot"), "n")


def recon_r2(spark, sf):
    return _sse(_reconstructed(spark, sf)).select(r6(1 - F.col("res") / F.greatest("tot", F.lit(1e-12))).alias("r2"))


def shuffle_buffered(spark, sf):
    """Rows through a buffer of 64: each comes out once, with its own vector."""
    rows = normalize.shuffle_buffer(b.acts(spark, sf), 64, epoch=3)
    return rows.select("token_id", "unit", "pos", r6(encode.dot(F.col("x"), F.col("x"))).alias("energy"))


def encode_progress(spark, sf):
    """What the encoder's one pass counted on the way, read after its firings are written."""
    out, progress = encode.firings_with_progress(b.acts(spark, sf), _model(spark, sf), encode.TopK(b.L0))
    stored(out, "firings")
    one = progress.get()
    rows = [(one["n_rows"], one["n_firings"], one["sum_act"], one["max_act"], one["mean_l0"])]
    return spark.createDataFrame(rows, "n_rows long, n_firings long, sum_act double, max_act double, mean_l0 double").select("n_rows", "n_firings", *[r6(c).alias(c) for c in ("sum_act", "max_act", "mean_l0")])


def mean_l0(spark, sf):
    n = table(spark, sf, "embeddings").count()
    fr = encode.firings(b.acts(spark, sf), _model(spark, sf), encode.Threshold(_theta(spark), 0.9))
    return concepts.mean_l0(fr, n).select(r6("mean_l0").alias("mean_l0"))


def l21_penalty(spark, sf):
    n = table(spark, sf, "embeddings").count()
    fr = encode.firings(b.acts(spark, sf), _model(spark, sf), encode.Soft(_theta(spark)))
    return fr.agg(r6(F.sum("act") / F.lit(n)).alias("l21"))


_W = b.with_("acts", "atoms", "proj", "norms")
_F = b.with_(*b.ENCODED)
_THETA = "(0.2::DOUBLE + 0.01::DOUBLE * g)"
_STATS = """, flat AS (SELECT token_id, generate_subscripts(x, 1) - 1 AS dim, unnest(x) AS v FROM {rows}),
per AS (SELECT dim, count(*) AS n, avg(v) AS mean, avg(v * v) AS sq FROM flat GROUP BY dim),
one AS (SELECT count(*) AS d, sqrt(count(*) / greatest(sum(sq) - sum(mean * mean), 1e-12)) AS scale FROM per)
"""
_DEC = """, z AS (SELECT token_id, g, 0 AS j, c0 AS z FROM firings UNION ALL SELECT token_id, g, 1, c1 FROM firings),
flat AS (SELECT g, j, generate_subscripts(dec, 1) - 1 AS dim, unnest(dec) AS d FROM atoms),
hat AS (SELECT token_id, dim, sum(z * d) AS h FROM z JOIN flat USING (g, j) GROUP BY token_id, dim)
"""
_SSE = _F + _DEC + """, xs AS (SELECT token_id, generate_subscripts(x, 1) - 1 AS dim, unnest(x) AS x FROM acts),
means AS (SELECT dim, avg(x) AS m FROM xs GROUP BY dim),
sse AS (SELECT sum((x - coalesce(h, 0)) * (x - coalesce(h, 0))) AS res, sum((x - m) * (x - m)) AS tot, count(DISTINCT token_id) AS n
  FROM xs JOIN means USING (dim) LEFT JOIN hat USING (token_id, dim))
"""
_ORTHO = """, pair AS (SELECT a.g, a.dec AS b1, b.dec AS b2, sqrt(list_dot_product(a.dec, a.dec)) AS n1, list_dot_product(a.dec, b.dec) AS b12, list_dot_product(b.dec, b.dec) AS b22
  FROM atoms a JOIN atoms b ON a.g = b.g AND a.j = 0 AND b.j = 1)
"""

QUERIES = {
    f.__name__: f
    for f in (norm_stats, norm_stats_drop_first, normalized_energy, position_mean_center, unit_row_counts, steps_per_epoch, first_units, inferred_d, epoch_batches, shuffle_epoch,
              encode_topk, encode_threshold, encode_soft, encode_tied, unit_blocks, theta_softplus, decode_rows, reconstruct_sse, recon_r2, mean_l0, l21_penalty, shuffle_buffered, encode_progress)
}
_SELECT_STATS = "SELECT CAST(dim AS INTEGER) AS dim, round(mean, 6) AS mean, round((SELECT scale FROM one), 6) AS scale, n, (SELECT d FROM one) AS d FROM per"
_CODES = "SELECT token_id, g, round(act, 6) AS act, round(c0 + 0.0, 6) AS c0, round(c1 + 0.0, 6) AS c1 FROM "
ORACLE_SQL = {
    "norm_stats": b.with_("acts") + _STATS.format(rows="acts") + _SELECT_STATS,
    "norm_stats_drop_first": b.with_("acts") + ", late AS (SELECT * FROM acts WHERE pos >= 5)" + _STATS.format(rows="late") + _SELECT_STATS,
    "normalized_energy": b.with_("acts") + _STATS.format(rows="acts") + """SELECT token_id, round(sum(((v - mean) * (SELECT scale FROM one)) * ((v - mean) * (SELECT scale FROM one))), 6) AS energy
FROM flat JOIN per USING (dim) GROUP BY token_id""",
    "position_mean_center": b.with_("acts") + """, flat AS (SELECT token_id, pos, generate_subscripts(x, 1) - 1 AS dim, unnest(x) AS v FROM acts),
m AS (SELECT pos, dim, avg(v) AS m FROM flat GROUP BY pos, dim)
SELECT pos, count(*) AS n, round(sum((v - m) * (v - m)), 6) AS energy FROM flat JOIN m USING (pos, dim) GROUP BY pos""",
    "unit_row_counts": "SELECT user_id AS unit, greatest(count(*) - 3, 0) AS n FROM events GROUP BY user_id",
    "steps_per_epoch": "WITH u AS (SELECT greatest(count(*) - 3, 0) AS n FROM events GROUP BY user_id) SELECT greatest(1, CAST(sum(n) AS BIGINT) // 2 // 256) AS steps FROM u",
    "first_units": b.with_("acts") + "SELECT token_id, unit, pos FROM (SELECT *, dense_rank() OVER (ORDER BY unit) AS r FROM acts) WHERE r <= 3",
    "inferred_d": "SELECT CAST(len(embedding) AS INTEGER) AS d, count(*) AS n FROM embeddings GROUP BY 1",
    "epoch_batches": """WITH ks AS (SELECT vec_id AS token_id, row_number() OVER (ORDER BY md5('0-0-' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS k, count(*) OVER () AS n FROM embeddings)
SELECT k // 64 AS step, count(*) AS n, CAST(sum(token_id) AS BIGINT) AS ids FROM ks WHERE k // 64 < n // 64 GROUP BY 1""",
    "shuffle_epoch": "SELECT vec_id AS token_id, md5('0-1-' || CAST(vec_id AS VARCHAR)) AS key FROM embeddings",
    "encode_topk": _F + _CODES + "firings",
    "encode_threshold": _W + _CODES + f"norms WHERE act / 0.9::DOUBLE > {_THETA}",
    "encode_soft": _W + f", s AS (SELECT token_id, g, act AS a, greatest(1 - {_THETA} / greatest(act, 1e-8), 0) AS k, c0, c1 FROM norms) SELECT token_id, g, round(a * k, 6) AS act, round(c0 * k + 0.0, 6) AS c0, round(c1 * k + 0.0, 6) AS c1 FROM s WHERE a * k > 1e-6",
    "encode_tied": b.with_("acts", "atoms") + _ORTHO + """, p AS (SELECT token_id, g, list_dot_product(x, b1) / n1 AS p1, list_dot_product(x, b2) AS xb, b12 / n1 AS r, b22 FROM acts CROSS JOIN pair),
n AS (SELECT token_id, g, (1 + 0.1::DOUBLE * g) * sqrt(p1 * p1 + (xb - r * p1) * (xb - r * p1) / (b22 - r * r)) AS act FROM p)
SELECT token_id, g, round(act, 6) AS act FROM (SELECT *, row_number() OVER (PARTITION BY token_id ORDER BY act DESC, g) AS rn FROM n) WHERE rn <= 4""",
    "unit_blocks": b.with_("atoms") + """, n AS (SELECT g, greatest(sqrt(sum(list_dot_product(dec, dec))), 1e-8) AS norm FROM atoms GROUP BY g),
flat AS (SELECT g, j, generate_subscripts(dec, 1) - 1 AS dim, unnest(dec) AS v FROM atoms)
SELECT g, j, CAST(dim AS INTEGER) AS dim, round(v / norm, 6) AS v FROM flat JOIN n USING (g)""",
    "theta_softplus": b.with_("atoms") + "SELECT DISTINCT g, round(ln(1 + exp((g - 8) / 10.0::DOUBLE * 10)), 6) AS theta FROM atoms",
    "decode_rows": _F + _DEC + "SELECT token_id, CAST(dim AS INTEGER) AS dim, round(h + 0.0, 6) AS value FROM hat",
    "reconstruct_sse": _SSE + "SELECT round(res, 6) AS ss_res, round(tot, 6) AS ss_tot, n FROM sse",
    "recon_r2": _SSE + "SELECT round(1 - res / greatest(tot, 1e-12), 6) AS r2 FROM sse",
    "shuffle_buffered": b.with_("acts") + "SELECT token_id, unit, pos, round(list_dot_product(x, x), 6) AS energy FROM acts",
    "encode_progress": b.with_(*b.ENCODED) + "SELECT (SELECT count(*) FROM acts) AS n_rows, count(*) AS n_firings, round(sum(act), 6) AS sum_act, round(max(act), 6) AS max_act, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM acts), 6) AS mean_l0 FROM firings",
    "mean_l0": _W + f"SELECT round(count(*) FILTER (WHERE act / 0.9::DOUBLE > {_THETA} AND act > 1e-6) / (SELECT CAST(count(*) AS DOUBLE) FROM acts), 6) AS mean_l0 FROM norms",
    "l21_penalty": _W + f"SELECT round(sum(greatest(act - {_THETA}, 0)) / (SELECT CAST(count(*) AS DOUBLE) FROM acts), 6) AS l21 FROM norms WHERE act - {_THETA} > 1e-6",
}
