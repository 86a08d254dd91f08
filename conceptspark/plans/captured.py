"""Queries on capture trees, which are written from the embeddings in all three layouts."""

from __future__ import annotations

import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptspark.operators import analysis, artifact, normalize
from conceptspark.plans import bindings as b
from conceptspark.runtime import shared_folder
from conceptspark.sources import captures
from conceptspark.streaming import running

LAYOUTS = ("per_file", "packed", "sharded")


def rows(spark: SparkSession, sf: str) -> DataFrame:
    """A label as a request: layer 8 holds whole vectors, layer 9 their first sixteen numbers."""
    a = b.acts(spark, sf).select(F.concat(F.lit("r"), "unit").alias("request_id"), F.col("unit").cast("int").alias("label"), "pos", "x")
    whole = a.select("request_id", "label", F.lit(8).alias("layer"), F.lit("resid").alias("hook"), "pos", "x")
    return whole.unionByName(a.select("request_id", "label", F.lit(9).alias("layer"), F.lit("mlp").alias("hook"), "pos", F.slice("x", 1, 16).alias("x")))


@cache
def _tree(app: str, sf: str) -> str:
    spark = SparkSession.getActiveSession()
    root = f"{shared_folder(spark)}/captures-{uuid.uuid4().hex}"
    for i, layout in enumerate(LAYOUTS):
        captures.write(rows(spark, sf).where(F.col("label") % 3 == i), root, "run", layout)
    return root


def tree(spark: SparkSession, sf: str) -> str:
    """The tree of this session: a request's layout goes by its label."""
    return _tree(spark.sparkContext.applicationId, sf)


def _shown(read: DataFrame) -> DataFrame:
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    return read.select("request_id", "layer", "hook", "pos", F.size("x").alias("d"), F.round(square, 4).alias("square"), F.round(F.get("x", F.lit(0)).cast("double"), 5).alias("first"))


def capture_rows(spark, sf):
    """Rows of one hook, out of all layouts, in splits of a few rows."""
    return _shown(captures.read(spark, tree(spark, sf), 8, "resid", split_bytes=4096))


def capture_request(spark, sf):
    """All hooks of one request, whose layout is found out by the reader."""
    return _shown(captures.read(spark, tree(spark, sf), request_id="r2"))


def capture_units(spark, sf):
    """Units that may hold the hook, and their rows from sidecars alone."""
    found = captures.units(captures.sidecars(spark, tree(spark, sf)), 9, "mlp")
    return found.groupBy("kind").agg(F.sum("n").alias("n_rows"))


def capture_rows_left(spark, sf):
    """Rows and steps of an epoch after two positions of every request are skipped, from sidecars alone."""
    e = captures.placed(captures.sidecars(spark, tree(spark, sf)), 8, "resid")
    units = e.groupBy(F.col("request_id").alias("unit")).agg(F.sum("rows").alias("n"))
    return normalize.row_count(units, 2).crossJoin(normalize.steps_per_epoch(units, 2, 32, 2))


def capture_last_stage(spark, sf):
    """A request stored by two stages: the last index stands."""
    root = f"{shared_folder(spark)}/captures-{uuid.uuid4().hex}"
    some = rows(spark, sf).where("layer = 8")
    captures.write(some, root, "run", "packed", name="packed-pp0")
    captures.write(some.withColumn("x", F.transform("x", lambda v: v * 2)).where("label <= 4"), root, "run", "packed", name="packed-pp1")
    return _shown(captures.read(spark, root, 8, "resid"))


def capture_norm_stats(spark, sf):
    """Statistics of captured rows, computed once and then loaded."""
    root = tree(spark, sf)

    def compute():
        acts = captures.read(spark, root, 8, "resid").select(F.col("pos").alias("token_id"), "pos", F.col("x").cast("array<double>").alias("x"))
        return normalize.norm_stats(normalize.drop_first(acts, 1))

    key = {"layer": 8, "hook": "resid", "drop_first": 1, "max_rows": -1}
    artifact.cached_stats(spark, f"{root}-stats", key, compute)
    out = artifact.cached_stats(spark, f"{root}-stats", key, compute)
    return out.select("n", "d", F.round("scale", 5).alias("scale"))


def capture_stream(spark, sf):
    """Sealed shards as a stream of rows."""
    out = f"{shared_folder(spark)}/captured-{uuid.uuid4().hex}"
    running.sealed_shards(spark, tree(spark, sf), 8, "resid", f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return _shown(spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows"))


@cache
def _artifact(app: str, sf: str) -> str:
    spark = SparkSession.getActiveSession()
    path = f"{shared_folder(spark)}/artifact-{uuid.uuid4().hex}"
    atoms = b.atoms(spark, sf)
    g = b.N_ATOMS // b.GROUP
    meta = {"kind": "free", "n_groups": g, "group_size": b.GROUP, "d": normalize.infer_d(b.acts(spark, sf)), "l0": b.L0}
    # A request is a label: texts of other documents are not split into words.
    toks = b.tokens(spark, sf, b.acts(spark, sf).select("unit")).select(F.concat(F.lit("r"), "unit").alias("unit"), "pos", "token")
    analysis.build(spark, tree(spark, sf), 8, "resid", atoms, meta, path, toks, drop=1)
    return path


def built(spark: SparkSession, sf: str, *names: str) -> tuple[list[DataFrame], dict]:
    """Tables of this session's artifact: the tree's rows from position 1 on, a dictionary of the first embeddings, words of documents as tokens."""
    tables, meta = artifact.load(spark, _artifact(spark.sparkContext.applicationId, sf), list(names))
    return [tables[n] for n in names], meta


def analysis_meta(spark, sf):
    meta = built(spark, sf)[1]
    row = tuple(meta[k] for k in ("n_tokens", "n_units", "edges_found")) + (round(meta["mean_l0"], 6),)
    return spark.createDataFrame([row], "n_tokens long, n_units long, edges_found long, mean_l0 double")


def analysis_concepts(spark, sf):
    [(c, q), _] = built(spark, sf, "concepts", "quantiles")
    shown = [F.round(n, 5).alias(n) for n in ("mean_act", "max_act", "fire_rate", "near_threshold_frac", "q_min", "q25", "q50", "q75", "q_max")]
    return c.join(q, "g", "left").select("g", F.col("n_fire").cast("long").alias("n_fire"), *shown)


def analysis_edges(spark, sf):
    return built(spark, sf, "edges")[0][0].select("i", "j", F.round("w", 6).alias("w"))


def analysis_examples(spark, sf):
    """Strongest firings with their tokens."""
    return built(spark, sf, "examples")[0][0].select("g", "rank", "unit", "pos", "token", F.round("act", 5).alias("act"))


def analysis_points(spark, sf):
    """Manifold points with tokens: the norm of a point about its cloud's centre does not depend on the axes."""
    p = built(spark, sf, "points")[0][0]
    return p.select("g", "rank", "unit", "pos", "token", F.round(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2), 4).alias("r"))


QUERIES = {f.__name__: f for f in (capture_rows, capture_request, capture_units, capture_rows_left, capture_last_stage, capture_norm_stats, capture_stream,
                                   analysis_meta, analysis_concepts, analysis_edges, analysis_examples, analysis_points)}

_C = b.with_("acts") + """, f AS (SELECT 'r' || unit AS request_id, CAST(unit AS INTEGER) AS label, pos, CAST(CAST(x AS FLOAT[]) AS DOUBLE[]) AS x FROM acts),
c AS (SELECT request_id, label, 8 AS layer, 'resid' AS hook, pos, x FROM f UNION ALL SELECT request_id, label, 9, 'mlp', pos, x[1:16] FROM f)
"""
_SHOWN = "SELECT request_id, layer, hook, CAST(pos AS BIGINT) AS pos, CAST(len(x) AS INTEGER) AS d, round(list_dot_product(x, x), 4) AS square, round(x[1], 5) AS first FROM "
ORACLE_SQL = {
    "capture_rows": _C + _SHOWN + "c WHERE layer = 8",
    "capture_request": _C + _SHOWN + "c WHERE request_id = 'r2'",
    "capture_units": _C + "SELECT ['per_file', 'packed', 'sharded'][label % 3 + 1] AS kind, count(*) AS n_rows FROM c WHERE layer = 9 GROUP BY 1",
    "capture_rows_left": _C + ", u AS (SELECT request_id, greatest(count(*) - 2, 0) AS n FROM c WHERE layer = 8 GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(greatest(1, sum(n) // 2 // 32) AS BIGINT) AS steps FROM u",
    "capture_last_stage": _C + ", l AS (SELECT request_id, layer, hook, pos, CASE WHEN label <= 4 THEN list_transform(x, lambda v: v * 2) ELSE x END AS x FROM c WHERE layer = 8) " + _SHOWN + "l",
    "capture_norm_stats": _C + ", v AS (SELECT generate_subscripts(x, 1) AS i, unnest(x) AS v FROM c WHERE layer = 8 AND pos >= 1), m AS (SELECT i, count(*) AS n, avg(v) AS m, avg(v * v) AS s FROM v GROUP BY i) SELECT max(n) AS n, count(*) AS d, round(sqrt(count(*) / greatest(sum(s) - sum(m * m), 1e-12)), 5) AS scale FROM m",
    "capture_stream": _C + _SHOWN + "c WHERE layer = 8 AND label % 3 = 2",
}

# The artifact's firings: normalised captured rows from position 1 on, encoded as those of the bindings.
_A = _C + f""", a AS (SELECT row_number() OVER (ORDER BY request_id, pos) AS tid, request_id AS unit, pos, x FROM c WHERE layer = 8 AND pos >= 1),
v AS (SELECT tid, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM a),
m AS (SELECT i, avg(v) AS m, avg(v * v) AS s FROM v GROUP BY i),
st AS (SELECT list(m ORDER BY i) AS mean, sqrt(count(*) / greatest(sum(s) - sum(m * m), 1e-12)) AS scale FROM m),
nx AS (SELECT tid, unit, pos, list_transform(list_zip(x, mean), lambda t: (t[1] - t[2]) * scale) AS x FROM a, st),
{b.SQL["atoms"]},
pr AS (SELECT tid, unit, pos, g, j, dec, list_dot_product(x, dec) AS p FROM nx CROSS JOIN atoms),
nm AS (SELECT tid, unit, pos, g, sqrt(sum(p * p)) AS act, max(CASE WHEN j = 0 THEN p END) AS c0, max(CASE WHEN j = 1 THEN p END) AS c1 FROM pr GROUP BY tid, unit, pos, g),
fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY act DESC, g) AS rn FROM nm) WHERE rn <= {b.L0} AND act > 1e-6),
cn AS (SELECT g, count(*) AS n FROM fr GROUP BY g),
bo AS (SELECT p.g AS i, q.g AS j, count(*) AS n FROM fr p JOIN fr q ON p.tid = q.tid AND p.g < q.g GROUP BY p.g, q.g),
ed AS (SELECT i, j, bo.n / (ci.n + cj.n - bo.n) AS w FROM bo JOIN cn ci ON ci.g = i JOIN cn cj ON cj.g = j),
{b.SQL["tokens"]},
tk AS (SELECT 'r' || unit AS unit, pos, token FROM tokens)
"""
_TOKEN = "coalesce(translate(token, 'ĠĊĉ', ' ' || chr(10) || chr(9)), '<' || f.pos || '>') AS token"
ORACLE_SQL |= {
    "analysis_meta": _A + "SELECT (SELECT count(*) FROM a) AS n_tokens, (SELECT count(DISTINCT unit) FROM a) AS n_units, (SELECT count(*) FROM ed WHERE w >= 0.1) AS edges_found, (SELECT round(count(*) / (SELECT count(*) FROM a), 6) FROM fr) AS mean_l0",
    "analysis_concepts": _A + """, r AS (SELECT g, act, row_number() OVER (PARTITION BY g ORDER BY act DESC, unit, pos) - 1 AS rank, count(*) OVER (PARTITION BY g) AS n, max(act) OVER (PARTITION BY g) AS top FROM fr),
s AS (SELECT g, count(*) AS n_fire, avg(act) AS mean_act, max(act) AS max_act, count(*) / (SELECT count(*) FROM a) AS fire_rate, avg(CASE WHEN act < 0.4 * top THEN 1.0 ELSE 0.0 END) AS near_threshold_frac,
  max(CASE WHEN rank = n - 1 THEN act END) AS q_min, max(CASE WHEN rank = floor(0.75 * (n - 1)) THEN act END) AS q25, max(CASE WHEN rank = floor(0.5 * (n - 1)) THEN act END) AS q50,
  max(CASE WHEN rank = floor(0.25 * (n - 1)) THEN act END) AS q75, max(CASE WHEN rank = 0 THEN act END) AS q_max FROM r GROUP BY g)
SELECT e.g, coalesce(n_fire, 0) AS n_fire, round(coalesce(mean_act, 0), 5) AS mean_act, round(coalesce(max_act, 0), 5) AS max_act, round(coalesce(fire_rate, 0), 5) AS fire_rate,
  round(coalesce(near_threshold_frac, 0), 5) AS near_threshold_frac, round(q_min, 5) AS q_min, round(q25, 5) AS q25, round(q50, 5) AS q50, round(q75, 5) AS q75, round(q_max, 5) AS q_max
FROM (SELECT DISTINCT g FROM atoms) e LEFT JOIN s ON s.g = e.g""",
    "analysis_edges": _A + "SELECT i, j, round(w, 6) AS w FROM ed WHERE w >= 0.1",
    "analysis_examples": _A + f"""SELECT f.g, CAST(f.rank AS INTEGER) AS rank, f.unit, CAST(f.pos AS INTEGER) AS pos, {_TOKEN}, round(f.act, 5) AS act
FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY act DESC, unit, pos) AS rank FROM fr) f LEFT JOIN tk ON tk.unit = f.unit AND tk.pos = f.pos WHERE f.rank <= 12""",
    "analysis_points": _A + f""", u AS (SELECT *, row_number() OVER (PARTITION BY g, unit ORDER BY act DESC, pos) AS k FROM fr),
cl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY unit, k) AS rank FROM u WHERE k <= 8) WHERE rank <= 200),
gm AS (SELECT p.g, list_dot_product(p.dec, p.dec) AS a00, list_dot_product(p.dec, q.dec) AS a01, list_dot_product(q.dec, q.dec) AS a11 FROM atoms p JOIN atoms q ON p.g = q.g AND p.j = 0 AND q.j = 1),
ce AS (SELECT g, avg(c0) AS m0, avg(c1) AS m1, count(*) AS n FROM cl GROUP BY g)
SELECT f.g, CAST(f.rank AS INTEGER) AS rank, f.unit, CAST(f.pos AS INTEGER) AS pos, {_TOKEN},
  round(sqrt((c0 - m0) ** 2 * a00 + 2 * (c0 - m0) * (c1 - m1) * a01 + (c1 - m1) ** 2 * a11), 4) AS r
FROM cl f JOIN ce ON ce.g = f.g AND ce.n >= 4 JOIN gm ON gm.g = f.g LEFT JOIN tk ON tk.unit = f.unit AND tk.pos = f.pos""",
}
