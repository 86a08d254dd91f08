"""Queries on subspaces, shapes, running state, training and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from conceptspark.operators import artifact, cofiring, concepts, encode, geometry, graph, layout, shapes, state, train, train_blocks as blocks
from conceptspark.plans import bindings as b
from conceptspark.runtime import shared_folder, stored
from conceptspark.streaming import running


def r6(c):
    return F.round(c, 6)


def _norms(spark, sf):
    every = encode.TopK(b.N_ATOMS)
    return encode.firings(b.acts(spark, sf), encode.Dictionary.of(b.atoms(spark, sf)), every)


def _points(spark, sf):
    """The first three dimensions of every row, a unit as a concept."""
    return b.acts(spark, sf).select(F.col("unit").cast("int").alias("g"), (F.col("pos") + 1).alias("rank"), F.slice("x", 1, 3).alias("p"))


def theta_init(spark, sf):
    return state.theta_init(_norms(spark, sf), 4, b.N_ATOMS // b.GROUP).select(r6("scale").alias("scale"), r6("theta").alias("theta"), r6("raw_theta").alias("raw_theta"))


def window_occupancy(spark, sf):
    return state.window_occupancy(_norms(spark, sf), 0.17, 1.9, 0.1, 5.0).select(r6("occupancy").alias("occupancy"), "stranded")


def dead_topk(spark, sf):
    """Blocks whose mean activation is below that of all count as dead."""
    norms = _norms(spark, sf)
    mean = norms.agg(F.avg("act").alias("mean"))
    dead = norms.groupBy("g").agg(F.avg("act").alias("own")).join(mean, F.col("own") < F.col("mean")).select("g")
    return state.dead_topk(norms, dead, 3).select("token_id", F.col("rank").cast("long").alias("rank"), "g", r6("act").alias("act"))


def tokens_since_fired(spark, sf):
    return state.tokens_since_fired(b.events(spark, sf))


def dead_concepts_by_silence(spark, sf):
    return state.dead_mask(state.tokens_since_fired(b.events(spark, sf)), 2)


def ema_scale(spark, sf):
    steps = state.batch_scale(b.events(spark, sf), "token_id", 500)
    return state.ema(steps, "step", "value").select("step", r6("ema").alias("ema"))


def l0_controller(spark, sf):
    steps = state.batch_scale(b.events(spark, sf), "token_id", 500).orderBy("step").collect()
    c = state.L0Controller(target=40.0, gain=0.05, kp=2.0)
    rows = []
    for r in steps:  # one number per step
        adj, prop = c.update(r["value"])
        rows.append((r["step"], adj, prop, c.coefficient(0.01)))
    return spark.createDataFrame(rows, "step long, adj double, prop double, coef double").select("step", r6("adj").alias("adj"), r6("prop").alias("prop"), r6("coef").alias("coef"))


def sparsity_flags(spark, sf):
    l0 = b.firings(spark, sf).where("act > 0.25").groupBy("unit").agg((F.count("*") / F.count_distinct("token_id")).alias("l0"))
    return l0.select("unit", r6("l0").alias("l0"), state.l0_off_target(F.col("l0"), 4.0, 1.5).alias("off"))


def block_basis_k2(spark, sf):
    q = geometry.bases(b.atoms(spark, sf)).select("g", "j", F.posexplode("q").alias("dim", "v"))
    # Signs of a basis are free; projections onto the span are not.
    p = q.alias("a").join(q.alias("c"), (F.col("a.g") == F.col("c.g")) & (F.col("a.j") == F.col("c.j")) & (F.col("a.dim") <= F.col("c.dim")))
    return p.groupBy(F.col("a.g").alias("g"), F.col("a.dim").alias("d1"), F.col("c.dim").alias("d2")).agg(r6(F.sum(F.col("a.v") * F.col("c.v")) + 0.0).alias("p"))


def chordal_topn(spark, sf):
    out = geometry.nearest_blocks(b.atoms(spark, sf), 8)
    return out.select("g", F.col("rank").cast("long").alias("rank"), "other", r6("d").alias("d"))


def chordal_summary(spark, sf):
    out = geometry.chordal_summary(geometry.chordal(b.atoms(spark, sf)), 2, 64)
    return out.select("n_pairs", *[r6(c).alias(c) for c in ("median", "mean", "spread", "random")])


def shape_participation(spark, sf):
    return shapes.participation(_points(spark, sf)).select("g", "n", r6("participation").alias("participation"))


def shape_planar(spark, sf):
    return shapes.planar(_points(spark, sf)).select("g", r6("annularity").alias("annularity"), r6("hollow").alias("hollow"))


def shape_antipodal(spark, sf):
    return shapes.antipodal(_points(spark, sf)).select("g", r6("antipodal").alias("antipodal"))


def shape_counts(spark, sf):
    return shapes.counts(shapes.census(_points(spark, sf)), 1.95, 0.82)


def shape_gallery(spark, sf):
    return shapes.gallery(shapes.census(_points(spark, sf)), 5).select("g", r6("score").alias("score"))


def radial_clip(spark, sf):
    out = geometry.radial_clip(_points(spark, sf))
    return out.select("g", "rank", *[r6(F.get("p", F.lit(i)) + 0.0).alias(f"p{i}") for i in range(3)])


def direction_color(spark, sf):
    out = _points(spark, sf).withColumn("c", geometry.direction_color(F.col("p")))
    return out.select("g", "rank", *[r6(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(3)])


def intensity(spark, sf):
    return geometry.intensity(_points(spark, sf)).select("g", "rank", r6("intensity").alias("intensity"))


def lat_lon(spark, sf):
    x, y, z = (F.get("p", F.lit(i)) for i in range(3))
    lat, lon = geometry.lat_lon(x, y, z)
    return _points(spark, sf).select("g", "rank", r6(lat).alias("lat"), r6(lon).alias("lon"))


def quantile_violations(spark, sf):
    return artifact.bad_quantiles(concepts.act_quantiles(b.basket(spark, sf)).withColumn("q25", F.col("q25") - F.col("g") * 300))


def edge_violations(spark, sf):
    return artifact.bad_edges(cofiring.edges(b.basket(spark, sf), 0.025), 90).select("i", "j")


def coverage_violations(spark, sf):
    stats = concepts.fire_stats(b.basket(spark, sf).where("act > 104500"), 1)
    return artifact.one_row_each(stats, 100).select("g", "n")


def nonzero_points(spark, sf):
    """Points of whole numbers; those that are zero in all three are left out."""
    whole = _points(spark, sf).withColumn("p", F.transform("p", lambda x: (x * 5).cast("int")))
    return geometry.without_zeros(whole).groupBy("g").agg(F.count("*").alias("n"))


def uncovered_concepts(spark, sf):
    every = b.basket(spark, sf).select("g").distinct()
    return artifact.uncovered(cofiring.edges(b.basket(spark, sf), 0.04).select(F.col("i").alias("g")), every)


def point_violations(spark, sf):
    """Points of a manifold without a token or a coordinate; short texts leave places without one."""
    x, y, z = (F.get("p", F.lit(i)) for i in range(3))
    toks = b.tokens(spark, sf).select(F.col("unit").cast("string").alias("doc"), F.col("pos").alias("at"), "token")
    points = b.acts(spark, sf).select("token_id", F.col("token_id").cast("string").alias("doc"), F.slice("x", 1, 3).alias("p"))
    named = points.join(toks.where("at = 9"), "doc", "left").select("token_id", x.alias("x"), y.alias("y"), z.alias("z"), "token")
    return artifact.bad_points(named).select("token_id")


def distance_violations(spark, sf):
    """Distances beyond what blocks of one dimension allow."""
    return artifact.bad_distances(geometry.chordal(b.atoms(spark, sf)), 1).select("i", "j", r6("d").alias("d"))


def spectral_layout(spark, sf):
    edges = cofiring.edges(b.firings(spark, sf), 0.1)
    return graph.spectral_layout(edges, b.atoms(spark, sf).select("g").distinct())


def _all_pairs(spark, sf):
    d = stored(geometry.chordal(b.atoms(spark, sf)), "chordal")
    own = b.atoms(spark, sf).select(F.col("g").alias("i"), F.col("g").alias("j"), F.lit(0.0).alias("d")).distinct()
    return d.select("i", "j", "d").unionByName(d.select(F.col("j").alias("i"), F.col("i").alias("j"), "d")).unionByName(own)


def classical_mds(spark, sf):
    return layout.classical_mds(b.atoms(spark, sf))


def double_centred(spark, sf):
    return graph.double_centred(_all_pairs(spark, sf)).select("i", "j", r6(F.col("b") + 0.0).alias("b"))


def cloud_pca3(spark, sf):
    cloud = concepts.cloud_sample(b.firings(spark, sf), 8, 200)
    return geometry.cloud_through_atoms(cloud, b.atoms(spark, sf))


def overlay_values(spark, sf):
    fr = b.firings(spark, sf)
    out = geometry.overlay(fr, geometry.main_axes(concepts.cloud_sample(fr, 8, 200)))
    return out.select("g", "unit", "pos", r6("act").alias("act"), *[r6(F.get("p", F.lit(i))).alias(f"p{i}") for i in range(2)])


def embedding_quality(spark, sf):
    share, half = layout.embedding_quality(b.atoms(spark, sf))
    return spark.createDataFrame([(share, half)], "share_in_two double, dims_for_half int")


def map_nodes(spark, sf):
    fr = b.firings(spark, sf)
    place = graph.spectral_layout(cofiring.edges(fr, 0.1), b.atoms(spark, sf).select("g").distinct())
    first = concepts.top_examples(fr, 1).select("g", F.concat_ws(":", "unit", "pos").alias("top_token"))
    n = b.acts(spark, sf).count()
    return place.join(concepts.fire_stats(fr, n), "g", "left").join(first, "g", "left").select("g", "x", "y", "component", "fire_rate", F.log10(F.greatest("fire_rate", F.lit(1e-6))).alias("log_rate"), "top_token")


def sphere_fit(spark, sf):
    return shapes.sphere_fit(geometry.sphere_points(_points(spark, sf).select("g", "rank", F.col("p").alias("code"))))


def sphere_grid(spark, sf):
    return shapes.sphere_grid(sphere_fit(spark, sf))


def _trained(spark, sf, kind):
    model = train.BlockModel(kind, 32, 2, 64, l0=4).init(0)
    acts = b.acts(spark, sf)
    if kind == "threshold":
        train.warm_up(acts, model, 4)
    log = train.fit(acts, model, epochs=2, batch=256, rate=0.01)
    return spark.createDataFrame([(kind, i, float(r["recon"]), float(r["l0"]), float(r["loss"])) for i, r in enumerate(log)], "kind string, step int, recon double, l0 double, loss double")


def train_free(spark, sf):
    return _trained(spark, sf, "free")


def train_tied(spark, sf):
    return _trained(spark, sf, "tied")


def train_threshold(spark, sf):
    return _trained(spark, sf, "threshold")


def train_soft(spark, sf):
    return _trained(spark, sf, "soft")


def train_blocks(spark, sf):
    """Parameters in tables; batches of 2048 rows, or of a quarter of the rows where these are fewer than four such batches."""
    acts = b.acts(spark, sf)
    batch = max(1, min(2048, acts.count() // 4))
    _, log = blocks.train_blocks(acts, train.BlockModel("free", 32, 2, 64, l0=4), _place(spark, "run"), epochs=1, batch=batch, rate=0.01)
    return spark.createDataFrame([(r["step"], float(r["recon"]), float(r["l0"]), int(r["dead"]), r.get("r2")) for r in log], "step int, recon double, l0 double, dead long, r2 double")


def _event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return rows.select(F.col("event_id").alias("token_id"), F.col("event_type").alias("g"), F.col("value").alias("act"))


def _place(spark, name):
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stream_fire_counts(spark, sf):
    """The event files as a stream, counted to the end."""
    out = _place(spark, "stream-counts")

    def put(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/now")

    q = running.fire_counts(_event_stream(spark, sf)).writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/now").select("g", "n_fire", r6("sum_act").alias("sum_act"), "max_act")


def stream_scale(spark, sf):
    out = _place(spark, "stream-scale")
    kept = running.BatchState(f"{out}/state")
    q = _event_stream(spark, sf).writeStream.foreachBatch(running.moving_scale(kept)).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return kept.current(spark, running.SCALE).select(r6("scale").alias("scale"))


def stream_silence(spark, sf):
    out = _place(spark, "stream-silence")
    kept = running.BatchState(f"{out}/state")
    q = _event_stream(spark, sf).writeStream.foreachBatch(running.silence(kept)).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return running.silence_now(spark, kept)


QUERIES = {
    f.__name__: f
    for f in (theta_init, window_occupancy, dead_topk, tokens_since_fired, dead_concepts_by_silence, ema_scale, l0_controller, sparsity_flags, block_basis_k2, chordal_topn, chordal_summary, shape_participation,
              shape_planar, shape_antipodal, shape_counts, shape_gallery, radial_clip, direction_color, intensity, lat_lon, quantile_violations, edge_violations, coverage_violations, nonzero_points, uncovered_concepts, point_violations, distance_violations, spectral_layout, classical_mds,
              double_centred, cloud_pca3, overlay_values, embedding_quality, map_nodes, sphere_fit, sphere_grid, train_free, train_tied, train_threshold, train_soft, train_blocks, stream_fire_counts, stream_scale, stream_silence)
}

_W = b.with_("acts", "atoms", "proj", "norms")
_F = b.with_(*b.ENCODED)
_A = b.with_("atoms")
_P = b.with_("acts") + ", pts AS (SELECT CAST(unit AS INTEGER) AS g, pos + 1 AS rank, x[1] AS x, x[2] AS y, x[3] AS z, sqrt(x[1] * x[1] + x[2] * x[2] + x[3] * x[3]) AS nrm FROM acts)\n"
_PLANAR = """, mid AS (SELECT g, avg(x) AS mx, avg(y) AS my FROM pts GROUP BY g),
rad AS (SELECT g, sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) AS r FROM pts JOIN mid USING (g)),
cap AS (SELECT g, quantile_cont(r, 0.98) AS rmax FROM rad GROUP BY g),
pl AS (SELECT g, avg(r) / greatest(stddev_pop(r), 1e-9) AS annularity, avg(CASE WHEN r < 0.4::DOUBLE * rmax THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS inr FROM rad JOIN cap USING (g) GROUP BY g),
planar AS (SELECT g, annularity, CASE WHEN inr < 0.16::DOUBLE THEN 1 - inr / 0.16::DOUBLE ELSE 0.0::DOUBLE END AS hollow FROM pl)
"""
_ANTI = """, few AS (SELECT * FROM pts WHERE rank <= 200),
near AS (SELECT a.g, a.rank, min(sqrt((a.x + c.x) * (a.x + c.x) + (a.y + c.y) * (a.y + c.y) + (a.z + c.z) * (a.z + c.z))) AS d, max(a.nrm) AS nrm FROM few a JOIN few c USING (g) GROUP BY a.g, a.rank),
antip AS (SELECT g, 1 - quantile_cont(d, 0.5) / greatest(2 * avg(nrm), 1e-12) AS antipodal FROM near GROUP BY g)
"""
_STEPS = "steps AS (SELECT event_id // 500 AS step, avg(value) AS v FROM events GROUP BY 1), ord AS (SELECT step, v, row_number() OVER (ORDER BY step) AS n FROM steps)"
_CHORDAL = _A + """, two AS (SELECT a.g, a.dec AS b1, c.dec AS b2, sqrt(list_dot_product(a.dec, a.dec)) AS n1, list_dot_product(a.dec, c.dec) / sqrt(list_dot_product(a.dec, a.dec)) AS r,
  list_dot_product(c.dec, c.dec) AS b22 FROM atoms a JOIN atoms c ON a.g = c.g AND a.j = 0 AND c.j = 1),
m AS (SELECT p.g AS i, q.g AS j, list_dot_product(p.b1, q.b1) / (p.n1 * q.n1) AS s11, list_dot_product(p.b1, q.b2) / p.n1 AS t12, list_dot_product(p.b2, q.b1) / q.n1 AS t21, list_dot_product(p.b2, q.b2) AS t22,
  p.r AS rp, q.r AS rq, sqrt(p.b22 - p.r * p.r) AS up, sqrt(q.b22 - q.r * q.r) AS uq FROM two p JOIN two q ON p.g < q.g),
s AS (SELECT i, j, s11, (t12 - rq * s11) / uq AS s12, (t21 - rp * s11) / up AS s21, (t22 - rq * t21 - rp * t12 + rp * rq * s11) / (up * uq) AS s22 FROM m),
ch AS (SELECT i, j, sqrt(greatest(2 - (s11 * s11 + s12 * s12 + s21 * s21 + s22 * s22), 0)) AS d FROM s),
ways AS (SELECT i AS g, j AS other, d FROM ch UNION ALL SELECT j, i, d FROM ch)
"""
_LAST = "l AS (SELECT g, max(ROW(ts, event_id)) AS last FROM e GROUP BY g) SELECT g, (SELECT count(*) FROM e WHERE ROW(e.ts, e.event_id) > l.last) AS since FROM l"

ORACLE_SQL = {
    "theta_init": _W + ", o AS (SELECT avg(act) AS scale, quantile_cont(act, 0.75) AS q FROM norms), t AS (SELECT scale, greatest(q / scale, 1e-3) AS theta FROM o) SELECT round(scale, 6) AS scale, round(theta, 6) AS theta, round(ln(exp(theta) - 1) / 10, 6) AS raw_theta FROM t",
    "window_occupancy": _W + """, k AS (SELECT g, 1 / (pi() * 0.1::DOUBLE * (1 + ((act / 0.17::DOUBLE - 1.9::DOUBLE) / 0.1::DOUBLE) * ((act / 0.17::DOUBLE - 1.9::DOUBLE) / 0.1::DOUBLE))) AS k FROM norms),
s AS (SELECT g, sum(k) AS mass, count(*) AS n FROM k GROUP BY g) SELECT round(sum(mass) / sum(n) * (pi() * 0.1::DOUBLE), 6) AS occupancy, count(*) FILTER (WHERE mass < 5.0) AS stranded FROM s""",
    "dead_topk": _W + "SELECT token_id, rank, g, round(act, 6) AS act FROM (SELECT *, row_number() OVER (PARTITION BY token_id ORDER BY act DESC, g) AS rank FROM norms WHERE g IN (SELECT g FROM norms GROUP BY g HAVING avg(act) < (SELECT avg(act) FROM norms))) WHERE rank <= 3",
    "tokens_since_fired": "WITH e AS (SELECT event_id, ts, event_type AS g FROM events), " + _LAST,
    "dead_concepts_by_silence": "WITH e AS (SELECT event_id, ts, event_type AS g FROM events), t AS (WITH " + _LAST + ") SELECT g, since FROM t WHERE since > 2",
    "ema_scale": "WITH RECURSIVE " + _STEPS + ", r AS (SELECT n, step, v AS e FROM ord WHERE n = 1 UNION ALL SELECT o.n, o.step, 0.99::DOUBLE * r.e + (1 - 0.99::DOUBLE) * o.v FROM r JOIN ord o ON o.n = r.n + 1) SELECT step, round(greatest(e, 1e-6), 6) AS ema FROM r",
    "l0_controller": "WITH RECURSIVE " + _STEPS + """, r AS (
  SELECT n, step, v AS e, least(1.0::DOUBLE, greatest(-1.0::DOUBLE, ln(greatest(v, 1e-6) / 40.0::DOUBLE))) AS err, least(2.0::DOUBLE, greatest(-2.0::DOUBLE, 0.05::DOUBLE * least(1.0::DOUBLE, greatest(-1.0::DOUBLE, ln(greatest(v, 1e-6) / 40.0::DOUBLE))))) AS adj FROM ord WHERE n = 1
  UNION ALL
  SELECT n, step, e, err, CASE WHEN abs(adj) >= 2 AND err * adj > 0 THEN adj ELSE least(2.0::DOUBLE, greatest(-2.0::DOUBLE, adj + 0.05::DOUBLE * err)) END FROM (
    SELECT o.n, o.step, 0.99::DOUBLE * r.e + (1 - 0.99::DOUBLE) * o.v AS e, least(1.0::DOUBLE, greatest(-1.0::DOUBLE, ln(greatest(0.99::DOUBLE * r.e + (1 - 0.99::DOUBLE) * o.v, 1e-6) / 40.0::DOUBLE))) AS err, r.adj FROM r JOIN ord o ON o.n = r.n + 1))
SELECT step, round(adj, 6) AS adj, round(2 * err, 6) AS prop, round(0.01::DOUBLE * exp(least(4.0::DOUBLE, greatest(-4.0::DOUBLE, 2 * err + adj))), 6) AS coef FROM r""",
    "sparsity_flags": _F + ", l AS (SELECT unit, count(*) / CAST(count(DISTINCT token_id) AS DOUBLE) AS l0 FROM firings WHERE act > 0.25 GROUP BY unit) SELECT unit, round(l0, 6) AS l0, l0 > 6.0 OR l0 < 4.0::DOUBLE / 1.5::DOUBLE AS off FROM l",
    "block_basis_k2": _A + """, two AS (SELECT a.g, a.dec AS b1, c.dec AS b2, sqrt(list_dot_product(a.dec, a.dec)) AS n1, list_dot_product(a.dec, c.dec) / sqrt(list_dot_product(a.dec, a.dec)) AS r, list_dot_product(c.dec, c.dec) AS b22 FROM atoms a JOIN atoms c ON a.g = c.g AND a.j = 0 AND c.j = 1),
q AS (SELECT g, generate_subscripts(b1, 1) - 1 AS dim, unnest(b1) / n1 AS q1, (unnest(b2) - r * unnest(b1) / n1) / sqrt(b22 - r * r) AS q2 FROM two)
SELECT a.g, CAST(a.dim AS INTEGER) AS d1, CAST(c.dim AS INTEGER) AS d2, round(a.q1 * c.q1 + a.q2 * c.q2 + 0.0, 6) AS p FROM q a JOIN q c ON a.g = c.g AND a.dim <= c.dim""",
    "chordal_topn": _CHORDAL + ", k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY d, other) AS rank FROM ways) SELECT g, rank, other, round(d, 6) AS d FROM k WHERE rank <= 8",
    "chordal_summary": _CHORDAL + "SELECT count(*) AS n_pairs, round(quantile_cont(d, 0.5), 6) AS median, round(avg(d), 6) AS mean, round(stddev_pop(d) / avg(d), 6) AS spread, round(sqrt(2 - 4 / 64.0::DOUBLE), 6) AS random FROM ch",
    "shape_participation": _P + """, c AS (SELECT g, count(*) AS n, var_samp(x) AS xx, var_samp(y) AS yy, var_samp(z) AS zz, covar_samp(x, y) AS xy, covar_samp(x, z) AS xz, covar_samp(y, z) AS yz FROM pts GROUP BY g)
SELECT g, n, round((xx + yy + zz) * (xx + yy + zz) / (xx * xx + yy * yy + zz * zz + 2 * (xy * xy + xz * xz + yz * yz)), 6) AS participation FROM c""",
    "shape_planar": _P + _PLANAR + "SELECT g, round(annularity, 6) AS annularity, round(hollow, 6) AS hollow FROM planar",
    "shape_antipodal": _P + _ANTI + "SELECT g, round(antipodal, 6) AS antipodal FROM antip",
    "shape_counts": _P + _PLANAR + _ANTI + ", big AS (SELECT g FROM pts GROUP BY g HAVING count(*) >= 30) SELECT count(*) AS n, count(*) FILTER (WHERE annularity > 1.95) AS ring_like, count(*) FILTER (WHERE antipodal > 0.82) AS antipodal FROM big JOIN planar USING (g) JOIN antip USING (g)",
    "shape_gallery": _P + _PLANAR + ", big AS (SELECT g FROM pts GROUP BY g HAVING count(*) >= 30) SELECT g, round(annularity * (1 + hollow), 6) AS score FROM big JOIN planar USING (g) ORDER BY annularity * (1 + hollow) DESC, g LIMIT 5",
    "radial_clip": _P + ", c AS (SELECT g, quantile_cont(nrm, 0.98) AS cap FROM pts GROUP BY g), f AS (SELECT *, least(1.0::DOUBLE, cap / greatest(nrm, 1e-12)) AS k FROM pts JOIN c USING (g)) SELECT g, rank, round(x * k + 0.0, 6) AS p0, round(y * k + 0.0, 6) AS p1, round(z * k + 0.0, 6) AS p2 FROM f",
    "direction_color": _P + "SELECT g, rank, " + ", ".join(f"round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE + 0.5::DOUBLE * {c} / greatest(nrm, 1e-12) * 0.9::DOUBLE)), 6) AS c{i}" for i, c in enumerate("xyz")) + " FROM pts",
    "intensity": _P + "SELECT g, rank, round(nrm / greatest(max(nrm) OVER (PARTITION BY g), 1e-12), 6) AS intensity FROM pts",
    "lat_lon": _P + "SELECT g, rank, round(degrees(asin(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, z / greatest(nrm, 1e-12))))), 6) AS lat, round(degrees(atan2(y, x)), 6) AS lon FROM pts",
    "quantile_violations": b.with_("basket") + """, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY act DESC, token_id) - 1 AS rank, count(*) OVER (PARTITION BY g) AS n FROM basket),
q AS (SELECT g, min(act) AS q_min, max(CASE WHEN rank = floor(0.75::DOUBLE * (n - 1)) THEN act END) - g * 300 AS q25, max(CASE WHEN rank = floor(0.5::DOUBLE * (n - 1)) THEN act END) AS q50, max(CASE WHEN rank = floor(0.25::DOUBLE * (n - 1)) THEN act END) AS q75, max(act) AS q_max FROM r GROUP BY g)
SELECT * FROM q WHERE q25 < q_min - 1e-3 OR q50 < q25 - 1e-3 OR q75 < q50 - 1e-3 OR q_max < q75 - 1e-3""",
    "edge_violations": b.with_("basket") + """, cnt AS (SELECT g, count(*) AS n FROM basket GROUP BY g), prs AS (SELECT a.g AS i, c.g AS j, count(*) AS n_both FROM basket a JOIN basket c ON a.token_id = c.token_id AND a.g < c.g GROUP BY 1, 2)
SELECT i, j FROM prs JOIN cnt x ON x.g = i JOIN cnt y ON y.g = j WHERE n_both / CAST(x.n + y.n - n_both AS DOUBLE) >= 0.025 AND j >= 90""",
    "coverage_violations": b.with_("basket") + """, c AS (SELECT g, 1 AS n FROM basket WHERE act > 104500 GROUP BY g), w AS (SELECT CAST(range AS BIGINT) AS k FROM range(100))
SELECT coalesce(w.k, c.g) AS g, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM w FULL JOIN c ON c.g = w.k WHERE w.k IS NULL OR c.g IS NULL""",
    "nonzero_points": _P + "SELECT g, count(*) AS n FROM pts WHERE trunc(x * 5) <> 0 OR trunc(y * 5) <> 0 OR trunc(z * 5) <> 0 GROUP BY g",
    "uncovered_concepts": b.with_("basket") + """, cnt AS (SELECT g, count(*) AS n FROM basket GROUP BY g), prs AS (SELECT a.g AS i, c.g AS j, count(*) AS n_both FROM basket a JOIN basket c ON a.token_id = c.token_id AND a.g < c.g GROUP BY 1, 2)
SELECT g FROM cnt EXCEPT SELECT i FROM prs JOIN cnt x ON x.g = i JOIN cnt y ON y.g = j WHERE n_both / CAST(x.n + y.n - n_both AS DOUBLE) >= 0.04""",
    "point_violations": b.with_("acts", "tokens") + "SELECT token_id FROM acts LEFT JOIN (SELECT unit AS doc, token FROM tokens WHERE pos = 9) t ON t.doc = acts.token_id WHERE token IS NULL",
    "distance_violations": _CHORDAL + "SELECT i, j, round(d, 6) AS d FROM ch WHERE NOT d BETWEEN -1e-6 AND 1.001",
    "double_centred": _CHORDAL + """, d2 AS (SELECT g AS i, other AS j, d * d AS d2 FROM ways UNION ALL SELECT DISTINCT g, g, 0.0::DOUBLE FROM atoms),
r AS (SELECT i, avg(d2) AS r FROM d2 GROUP BY i) SELECT d2.i, d2.j, round(-0.5::DOUBLE * (d2 - x.r - y.r + (SELECT avg(d2) FROM d2)) + 0.0, 6) AS b FROM d2 JOIN r x ON x.i = d2.i JOIN r y ON y.i = d2.j""",
    "stream_fire_counts": "SELECT event_type AS g, count(*) AS n_fire, round(sum(value), 6) AS sum_act, max(value) AS max_act FROM events GROUP BY event_type",
    "stream_scale": "SELECT round(avg(value), 6) AS scale FROM events",
    "stream_silence": "SELECT DISTINCT event_type AS g, CAST(0 AS BIGINT) AS since FROM events",
}
