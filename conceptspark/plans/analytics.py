"""Queries on firings: statistics, bands, examples, tokens, co-firing, requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from conceptspark.operators import cofiring, concepts, graph, requests, tokens
from conceptspark.plans import bindings as b
from conceptspark.runtime import table


def r6(c):
    return F.round(c, 6)


def _n_tokens(spark, sf):
    return b.basket(spark, sf).select("token_id").distinct().count()


def concept_fire_stats(spark, sf):
    out = concepts.fire_stats(b.basket(spark, sf), _n_tokens(spark, sf))
    return out.select("g", "n_fire", r6("mean_act").alias("mean_act"), "max_act", r6("fire_rate").alias("fire_rate"))


def concept_fire_stats_all(spark, sf):
    every = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("g"))
    loud = b.basket(spark, sf).where(F.col("act") > 104000)
    out = concepts.fire_stats_all(loud, every, _n_tokens(spark, sf))
    return out.select("g", "n_fire", r6("mean_act").alias("mean_act"), r6("fire_rate").alias("fire_rate"))


def dead_concepts(spark, sf):
    every = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("g"))
    loud = b.basket(spark, sf).where(F.col("act") > 104500)
    return concepts.dead(every, loud)


def live_count(spark, sf):
    return b.firings(spark, sf).agg(F.count_distinct("g").alias("live"))


def energy_top20(spark, sf):
    return concepts.energy_top(b.basket(spark, sf)).select("g", "n_fire", F.round(F.col("energy") / 1e6, 4).alias("energy"))


def fire_rate_hist(spark, sf):
    return concepts.rate_histogram(concepts.fire_stats(b.basket(spark, sf), _n_tokens(spark, sf)))


def rate_percentiles(spark, sf):
    stats = concepts.fire_stats(b.basket(spark, sf), _n_tokens(spark, sf))
    return concepts.summary(stats, "mean_act").select("p", r6("value").alias("value"))


def act_quantiles(spark, sf):
    return concepts.act_quantiles(b.basket(spark, sf))


def act_quantiles_events(spark, sf):
    return concepts.act_quantiles(b.events(spark, sf))


def near_threshold(spark, sf):
    return concepts.near_threshold(b.basket(spark, sf)).select("g", r6("near_threshold_frac").alias("near_threshold_frac"))


def act_bands(spark, sf):
    out = concepts.bands(b.basket(spark, sf))
    return out.select("g", "band", F.col("rank").cast("long").alias("rank"), "token_id", "act", F.col("rank_lo").cast("long").alias("rank_lo"), "lo_act", "hi_act", "weak")


def top_examples(spark, sf):
    out = concepts.top_examples(b.events(spark, sf), 12)
    return out.select("g", F.col("rank").cast("long").alias("rank"), "unit", "pos", "act")


def weakest_dropped(spark, sf):
    out = concepts.drop_weakest(b.basket(spark, sf), 0.25)
    return out.groupBy("g").agg(F.count("*").alias("n"), F.min("act").alias("least"))


def concepts_with_firings(spark, sf):
    return b.basket(spark, sf).groupBy("g").agg(F.count("*").alias("n_fire")).where(F.col("n_fire") >= 400)


def cloud_sample(spark, sf):
    out = concepts.cloud_sample(b.events(spark, sf), 8, 200)
    return out.select("g", F.col("rank").cast("long").alias("rank"), "unit", "pos", "act")


def uniform_sample(spark, sf):
    out = concepts.uniform_sample(b.basket(spark, sf), 50)
    return out.select("g", F.col("rank").cast("long").alias("rank"), "token_id")


def unit_energy_topn(spark, sf):
    out = concepts.unit_energy_top(b.events(spark, sf), 3)
    return out.select("g", F.col("rank").cast("long").alias("rank"), "unit", r6("energy").alias("energy"))


def ragged_offsets(spark, sf):
    return concepts.ragged_offsets(b.basket(spark, sf))


def fired_union(spark, sf):
    return b.basket(spark, sf).where("act > 50000").select("g").unionByName(b.basket(spark, sf).where("act <= 50000").select("g")).distinct()


def examples_with_context(spark, sf):
    toks = b.tokens(spark, sf)
    picked = toks.where(F.length("token") >= 12).select(F.lit(0).alias("g"), "unit", "pos")
    out = tokens.examples_with_context(picked, toks, 4)
    return out.select("unit", "pos", "token", "context_before", "context_after")


def missing_tokens(spark, sf):
    toks = b.tokens(spark, sf)
    ev = b.events(spark, sf).select("unit", F.col("pos").cast("int").alias("pos"), "token_id")
    return tokens.lookup(ev, toks).select("token_id", "token")


def clean_tokens(spark, sf):
    marked = b.tokens(spark, sf).select(F.concat(F.lit("Ġ"), "token", F.lit("Ċĉ")).alias("token"))
    return marked.select(tokens.clean(F.col("token")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def vocab_encode(spark, sf):
    return tokens.vocabulary(b.tokens(spark, sf)).select("token", F.col("token_id").cast("long").alias("token_id"))


def token_search(spark, sf):
    toks = b.tokens(spark, sf)
    return tokens.find_concept(toks.select(F.col("unit").alias("g"), "token"), " TION ")


def coact_counts(spark, sf):
    return cofiring.pair_counts(b.basket(spark, sf))


def coact_topn(spark, sf):
    out = cofiring.partners(b.firings(spark, sf), 8)
    return out.select("g", F.col("rank").cast("long").alias("rank"), "other", "n_both", r6("jaccard").alias("jaccard"))


def coact_edges(spark, sf):
    return cofiring.edges(b.basket(spark, sf), 0.025).select("i", "j", r6("w").alias("w"))


def coact_edges_firings(spark, sf):
    return cofiring.edges(b.firings(spark, sf), 0.1).select("i", "j", r6("w").alias("w"))


def coact_edges_found(spark, sf):
    return cofiring.edges_found(b.firings(spark, sf), 0.1)


def coact_degree(spark, sf):
    return cofiring.degree(cofiring.edges(b.basket(spark, sf), 0.025)).select("g", "degree", r6("strength").alias("strength"))


def edges_of_concept(spark, sf):
    return cofiring.edges_of(cofiring.edges(b.firings(spark, sf), 0.1), 3).select("other", r6("w").alias("w"))


def edge_split(spark, sf):
    return cofiring.split_edges(cofiring.edges(b.firings(spark, sf), 0.1), 3).groupBy("incident").agg(F.count("*").alias("n"), r6(F.sum("w")).alias("w"))


def components(spark, sf):
    return graph.components(cofiring.edges(b.firings(spark, sf), 0.16))


def component_sizes(spark, sf):
    return graph.component_sizes(cofiring.edges(b.firings(spark, sf), 0.16))


def concept_detail(spark, sf):
    fr = b.basket(spark, sf)
    stats = concepts.fire_stats(fr, _n_tokens(spark, sf)).join(concepts.act_quantiles(fr), "g")
    return stats.select("g", r6(100 * F.col("fire_rate")).alias("rate_percent"), "n_fire", r6("mean_act").alias("mean_act"), "max_act", "q50", r6(100 * F.col("q50") / F.col("max_act")).alias("median_percent_of_max"))


def most_active(spark, sf):
    return concepts.fire_stats(b.basket(spark, sf), _n_tokens(spark, sf)).orderBy(F.col("fire_rate").desc(), "g").limit(1).select("g", "n_fire")


def partner_labels(spark, sf):
    fr = b.basket(spark, sf)
    first = concepts.top_examples(fr, 1).select(F.col("g").alias("other"), F.col("token_id").alias("top_token"))
    out = cofiring.partners(fr, 3).join(first, "other", "left")
    return out.select("g", F.col("rank").cast("long").alias("rank"), "other", "top_token")


def band_listing(spark, sf):
    out = concepts.bands(b.events(spark, sf)).where(F.col("g") == "click")
    top = b.events(spark, sf).where(F.col("g") == "click").agg(F.max("act").alias("top"))
    return out.crossJoin(F.broadcast(top)).select("band", F.col("rank").cast("long").alias("rank"), "act", r6(100 * F.col("act") / F.col("top")).alias("percent_of_max"), "weak")


def prompts(spark, sf):
    return requests.parse_prompts(b.prompts(spark, sf)).select(F.col("idx").cast("long").alias("idx"), "prompt")


def request_manifest(spark, sf):
    out = requests.manifest(requests.parse_prompts(b.prompts(spark, sf)), ["http://a", "http://b", "http://c"], "run", {"resid": [8, 16]})
    return out.select("request_id", "server", F.get_json_object("body", "$.prompt").alias("prompt"), F.get_json_object("body", "$.capture.hooks.resid").alias("layers"))


def capture_accounting(spark, sf):
    e = table(spark, sf, "events")
    results = e.select(F.when(F.col("event_id") % 11 == 0, 500).otherwise(200).alias("status"), F.when(F.col("event_id") % 13 == 0, "timeout").alias("error"), F.when(F.col("event_id") % 17 == 0, "part").alias("partial_error"),
                       F.expr("transform(sequence(0, cast(event_id % 3 as int)), i -> concat('f', i))").alias("paths"))
    return requests.accounting(results).select("outcome", "n", F.col("files").cast("long").alias("files"))


QUERIES = {
    f.__name__: f
    for f in (concept_fire_stats, concept_fire_stats_all, dead_concepts, live_count, energy_top20, fire_rate_hist, rate_percentiles, act_quantiles, act_quantiles_events, near_threshold, act_bands, top_examples,
              weakest_dropped, concepts_with_firings, cloud_sample, uniform_sample, unit_energy_topn, ragged_offsets, fired_union, examples_with_context, missing_tokens, clean_tokens, vocab_encode, token_search,
              coact_counts, coact_topn, coact_edges, coact_edges_firings, coact_edges_found, coact_degree, edges_of_concept, edge_split, components, component_sizes, concept_detail, most_active, partner_labels,
              band_listing, prompts, request_manifest, capture_accounting)
}

_B = b.with_("basket")
_NT = "(SELECT CAST(count(DISTINCT token_id) AS DOUBLE) FROM basket)"
_F = b.with_(*b.ENCODED)


def _rank(rows, ties):
    return f", r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY act DESC, {ties}) - 1 AS rank, count(*) OVER (PARTITION BY g) AS n, max(act) OVER (PARTITION BY g) AS top FROM {rows})\n"


_PICK = """SELECT g, min(act) AS q_min, max(CASE WHEN rank = floor(0.75::DOUBLE * (n - 1)) THEN act END) AS q25, max(CASE WHEN rank = floor(0.5::DOUBLE * (n - 1)) THEN act END) AS q50,
 max(CASE WHEN rank = floor(0.25::DOUBLE * (n - 1)) THEN act END) AS q75, max(act) AS q_max FROM r GROUP BY g"""
_BANDS = """, bnd AS (SELECT * FROM (VALUES ('top', 0.0::DOUBLE), ('p75', 0.25::DOUBLE), ('p50', 0.5::DOUBLE), ('p10', 0.9::DOUBLE)) v(band, f)),
hit AS (SELECT r.*, band, least(CAST(floor(f * n) AS BIGINT), n - 1) AS rank_lo FROM r CROSS JOIN bnd),
inb AS (SELECT *, min(act) OVER (PARTITION BY g, band) AS lo_act, max(act) OVER (PARTITION BY g, band) AS hi_act FROM hit WHERE rank >= rank_lo AND rank < rank_lo + 4)
"""
_PAIRS = """, cnt AS (SELECT g, count(DISTINCT token_id) AS n FROM {rows} GROUP BY g),
prs AS (SELECT a.g AS i, b.g AS j, count(*) AS n_both FROM {rows} a JOIN {rows} b ON a.token_id = b.token_id AND a.g < b.g GROUP BY 1, 2),
jac AS (SELECT i, j, n_both, n_both / CAST(x.n + y.n - n_both AS DOUBLE) AS w FROM prs JOIN cnt x ON x.g = i JOIN cnt y ON y.g = j),
ways AS (SELECT i AS g, j AS other, n_both, w FROM jac UNION ALL SELECT j, i, n_both, w FROM jac)
"""
_JB, _JF = _B + _PAIRS.format(rows="basket"), _F + _PAIRS.format(rows="firings")
_COMP = "WITH RECURSIVE " + _F.removeprefix("WITH ") + _PAIRS.format(rows="firings") + """, e AS (SELECT i AS a, j AS b FROM jac WHERE w >= 0.16 UNION ALL SELECT j, i FROM jac WHERE w >= 0.16),
reach AS (SELECT a AS g, a AS other FROM e UNION SELECT reach.g, e.b FROM reach JOIN e ON reach.other = e.a),
comp AS (SELECT g, min(other) AS component FROM reach GROUP BY g)
"""
_CTX = """, near AS (SELECT unit, pos, token, coalesce(string_agg(token, '') OVER (PARTITION BY unit ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '') AS context_before,
 coalesce(string_agg(token, '') OVER (PARTITION BY unit ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), '') AS context_after FROM tokens)
"""
_PROMPTS = r"""WITH u AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx, text FROM conversations WHERE role = 'user'),
p AS (SELECT idx, CASE WHEN idx % 3 = 0 THEN text ELSE trim(regexp_replace(text, '[\r\n]+', ' ', 'g'), ' ') END AS prompt FROM u),
q AS (SELECT * FROM p WHERE idx % 3 = 0 OR prompt <> '')
"""

ORACLE_SQL = {
    "concept_fire_stats": _B + f"SELECT g, count(*) AS n_fire, round(avg(act), 6) AS mean_act, max(act) AS max_act, round(count(*) / {_NT}, 6) AS fire_rate FROM basket GROUP BY g",
    "concept_fire_stats_all": _B + f"SELECT s_suppkey AS g, count(token_id) AS n_fire, round(coalesce(avg(act), 0), 6) AS mean_act, round(count(token_id) / {_NT}, 6) AS fire_rate FROM supplier LEFT JOIN (SELECT * FROM basket WHERE act > 104000) ON g = s_suppkey GROUP BY s_suppkey",
    "dead_concepts": _B + "SELECT s_suppkey AS g FROM supplier EXCEPT SELECT g FROM basket WHERE act > 104500",
    "live_count": _F + "SELECT count(DISTINCT g) AS live FROM firings",
    "energy_top20": _B + "SELECT g, count(*) AS n_fire, round(sum(act * act) / 1e6, 4) AS energy FROM basket GROUP BY g HAVING count(*) >= 100 ORDER BY sum(act * act) DESC, g LIMIT 20",
    "fire_rate_hist": _B + f", s AS (SELECT count(*) / {_NT} AS fr FROM basket GROUP BY g) SELECT CAST(least(59, floor((log10(greatest(fr, 1e-6)) + 6) / 0.1::DOUBLE)) AS INTEGER) AS bin, count(*) AS n FROM s GROUP BY 1",
    "rate_percentiles": _B + ", s AS (SELECT avg(act) AS m FROM basket GROUP BY g), p AS (SELECT unnest([0.05::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 0.95::DOUBLE]) AS p, unnest(quantile_cont(m, [0.05, 0.25, 0.5, 0.75, 0.95])) AS v FROM s) SELECT p, round(v, 6) AS value FROM p",
    "act_quantiles": _B + _rank("basket", "token_id") + _PICK,
    "act_quantiles_events": b.with_("ev") + _rank("ev", "unit, pos") + _PICK,
    "near_threshold": _B + _rank("basket", "token_id") + "SELECT g, round(avg(CASE WHEN act < 0.4::DOUBLE * top THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS near_threshold_frac FROM r GROUP BY g",
    "act_bands": _B + _rank("basket", "token_id") + _BANDS + "SELECT g, band, rank, token_id, act, rank_lo, lo_act, hi_act, hi_act < 0.4::DOUBLE * top AS weak FROM inb",
    "top_examples": b.with_("ev") + _rank("ev", "unit, pos") + "SELECT g, rank + 1 AS rank, unit, pos, act FROM r WHERE rank < 12",
    "weakest_dropped": _B + ", c AS (SELECT g, quantile_cont(act, 0.25) AS cut, count(*) AS k FROM basket GROUP BY g) SELECT g, count(*) AS n, min(act) AS least FROM basket JOIN c USING (g) WHERE k <= 8 OR act >= cut GROUP BY g",
    "concepts_with_firings": _B + "SELECT g, count(*) AS n_fire FROM basket GROUP BY g HAVING count(*) >= 400",
    "cloud_sample": b.with_("ev") + """, a AS (SELECT *, row_number() OVER (PARTITION BY g, unit ORDER BY act DESC, pos) AS q FROM ev),
c AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY unit, q) AS rank FROM a WHERE q <= 8) SELECT g, rank, unit, pos, act FROM c WHERE rank <= 200""",
    "uniform_sample": _B + ", s AS (SELECT g, token_id, row_number() OVER (PARTITION BY g ORDER BY md5('0-' || CAST(g AS VARCHAR) || '-' || CAST(token_id AS VARCHAR)), token_id) AS rank FROM basket) SELECT g, rank, token_id FROM s WHERE rank <= 50",
    "unit_energy_topn": b.with_("ev") + ", e AS (SELECT g, unit, sum(act * act) AS e FROM ev GROUP BY g, unit), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY e DESC, unit) AS rank FROM e) SELECT g, rank, unit, round(e, 6) AS energy FROM r WHERE rank <= 3",
    "ragged_offsets": _B + ", n AS (SELECT g, count(*) AS n FROM basket GROUP BY g) SELECT g, n, CAST(coalesce(sum(n) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM n",
    "fired_union": _B + "SELECT g FROM basket WHERE act > 50000 UNION SELECT g FROM basket WHERE act <= 50000",
    "examples_with_context": b.with_("tokens") + _CTX + "SELECT unit, pos, token, context_before, context_after FROM near WHERE length(token) >= 12",
    "missing_tokens": b.with_("ev", "tokens") + "SELECT ev.token_id, coalesce(t.token, '<' || CAST(ev.pos AS VARCHAR) || '>') AS token FROM ev LEFT JOIN tokens t ON t.unit = ev.unit AND t.pos = ev.pos",
    "clean_tokens": b.with_("tokens") + "SELECT ' ' || token || chr(10) || chr(9) AS token, count(*) AS n FROM tokens GROUP BY 1",
    "vocab_encode": b.with_("tokens") + "SELECT token, row_number() OVER (ORDER BY encode(token)) AS token_id FROM (SELECT DISTINCT token FROM tokens)",
    "token_search": b.with_("tokens") + "SELECT min(unit) AS g FROM tokens WHERE contains(lower(token), 'tion')",
    "coact_counts": _JB + "SELECT i, j, n_both FROM prs",
    "coact_topn": _JF + ", k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY w DESC, other) AS rank FROM ways) SELECT g, rank, other, n_both, round(w, 6) AS jaccard FROM k WHERE rank <= 8",
    "coact_edges": _JB + "SELECT i, j, round(w, 6) AS w FROM jac WHERE w >= 0.025",
    "coact_edges_firings": _JF + "SELECT i, j, round(w, 6) AS w FROM jac WHERE w >= 0.1",
    "coact_edges_found": _JF + "SELECT count(*) AS found FROM jac WHERE w >= 0.1",
    "coact_degree": _JB + "SELECT g, count(*) AS degree, round(sum(w), 6) AS strength FROM ways WHERE w >= 0.025 GROUP BY g",
    "edges_of_concept": _JF + "SELECT other, round(w, 6) AS w FROM ways WHERE g = 3 AND w >= 0.1",
    "edge_split": _JF + "SELECT i = 3 OR j = 3 AS incident, count(*) AS n, round(sum(w), 6) AS w FROM jac WHERE w >= 0.1 GROUP BY 1",
    "components": _COMP + "SELECT g, component FROM comp",
    "component_sizes": _COMP + "SELECT component, count(*) AS size FROM comp GROUP BY component",
    "concept_detail": _B + _rank("basket", "token_id") + f", q AS ({_PICK}), s AS (SELECT g, count(*) AS n_fire, avg(act) AS m, max(act) AS max_act FROM basket GROUP BY g) SELECT g, round(100 * n_fire / {_NT}, 6) AS rate_percent, n_fire, round(m, 6) AS mean_act, max_act, q50, round(100 * q50 / max_act, 6) AS median_percent_of_max FROM s JOIN q USING (g)",
    "most_active": _B + "SELECT g, count(*) AS n_fire FROM basket GROUP BY g ORDER BY n_fire DESC, g LIMIT 1",
    "partner_labels": _JB + ", f AS (SELECT g, token_id FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY act DESC, token_id) AS q FROM basket) WHERE q = 1), k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY w DESC, other) AS rank FROM ways) SELECT k.g, rank, other, token_id AS top_token FROM k LEFT JOIN f ON f.g = other WHERE rank <= 3",
    "band_listing": b.with_("ev") + _rank("ev", "unit, pos") + _BANDS + "SELECT band, rank, act, round(100 * act / top, 6) AS percent_of_max, hi_act < 0.4::DOUBLE * top AS weak FROM inb WHERE g = 'click'",
    "prompts": _PROMPTS + "SELECT idx, prompt FROM q",
    "request_manifest": _PROMPTS + ", m AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS n, prompt FROM q) SELECT 'run-' || lpad(CAST(n AS VARCHAR), 8, '0') AS request_id, ['http://a', 'http://b', 'http://c'][CAST(n % 3 + 1 AS INTEGER)] AS server, prompt, '[8,16]' AS layers FROM m",
    "capture_accounting": "SELECT CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0 THEN 'retry' ELSE 'ok' END AS outcome, count(*) AS n, CAST(sum(event_id % 3 + 1) AS BIGINT) AS files FROM events GROUP BY 1",
}
