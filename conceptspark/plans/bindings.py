"""How the given tables stand in for activation rows, dictionaries and firings.

Each binding has a DataFrame form and, for the oracles, a DuckDB common table expression
of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptspark.operators import encode
from conceptspark.runtime import table

N_ATOMS = 32
GROUP = 2
L0 = 4


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token_id, unit, pos, x): embeddings as activation rows, a label as a unit."""
    e = table(spark, sf_dir, "embeddings")
    pos = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.col("vec_id").alias("token_id"), F.col("label").cast("string").alias("unit"), pos.alias("pos"), F.col("embedding").cast("array<double>").alias("x"))


def atoms(spark: SparkSession, sf_dir: str, n_atoms: int = N_ATOMS) -> DataFrame:
    """(g, j, dec): the first embeddings as a dictionary of blocks of two."""
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id") < n_atoms)
    return e.select(F.expr(f"cast(vec_id div {GROUP} as int)").alias("g"), (F.col("vec_id") % GROUP).cast("int").alias("j"), F.col("embedding").cast("array<double>").alias("dec"))


def firings(spark: SparkSession, sf_dir: str, n_atoms: int = N_ATOMS, l0: int = L0) -> DataFrame:
    """(token_id, unit, pos, g, act, code) of the rows of ``acts`` encoded by ``atoms``."""
    model = encode.Dictionary.of(atoms(spark, sf_dir, n_atoms))
    return encode.firings(acts(spark, sf_dir), model, encode.TopK(l0))


def basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token_id, g, act): orders as tokens, suppliers as concepts, the largest price as activation."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("token_id"), F.col("l_suppkey").alias("g")).agg(F.max("l_extendedprice").alias("act"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token_id, unit, pos, g, act, ts): events as positioned firings of their user's sequence."""
    e = table(spark, sf_dir, "events")
    pos = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("event_id").alias("token_id"), F.col("user_id").alias("unit"), pos.alias("pos"), F.col("event_type").alias("g"), F.col("value").alias("act"), "ts")


def tokens(spark: SparkSession, sf_dir: str, units: DataFrame | None = None) -> DataFrame:
    """(unit, pos, token): the words of every document, or of those whose ids are ``units`` (unit, few)."""
    d = table(spark, sf_dir, "documents")
    if units is not None:
        d = d.join(F.broadcast(units.select(F.col("unit").cast("long").alias("doc_id")).distinct()), "doc_id", "left_semi")
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return d.select(F.col("doc_id").alias("unit"), F.posexplode(words).alias("pos", "token"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, line): user turns as lines of a prompt file, every third one as JSON."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    idx = F.row_number().over(W.orderBy("conv_id", "turn")) - 1
    line = F.when(F.col("idx") % 3 == 0, F.to_json(F.struct(F.col("text").alias("prompt")))).otherwise(F.regexp_replace("text", r"[\r\n]+", " "))
    return c.select("conv_id", "turn", "text", idx.alias("idx")).select("idx", line.alias("line"))


SQL = {
    "acts": """acts AS (SELECT vec_id AS token_id, CAST(label AS VARCHAR) AS unit,
  CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS pos, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)""",
    "atoms": f"""atoms AS (SELECT CAST(vec_id // {GROUP} AS INTEGER) AS g, CAST(vec_id % {GROUP} AS INTEGER) AS j,
  CAST(embedding AS DOUBLE[]) AS dec FROM embeddings WHERE vec_id < {N_ATOMS})""",
    "proj": "proj AS (SELECT token_id, unit, pos, g, j, list_dot_product(x, dec) AS p FROM acts CROSS JOIN atoms)",
    "norms": "norms AS (SELECT token_id, unit, pos, g, sqrt(sum(p * p)) AS act, max(CASE WHEN j = 0 THEN p END) AS c0, max(CASE WHEN j = 1 THEN p END) AS c1 FROM proj GROUP BY token_id, unit, pos, g)",
    "firings": f"""firings AS (SELECT token_id, unit, pos, g, act, c0, c1 FROM
  (SELECT *, row_number() OVER (PARTITION BY token_id ORDER BY act DESC, g) AS rn FROM norms) WHERE rn <= {L0} AND act > 1e-6)""",
    "basket": "basket AS (SELECT l_orderkey AS token_id, l_suppkey AS g, max(l_extendedprice) AS act FROM lineitem GROUP BY l_orderkey, l_suppkey)",
    "ev": """ev AS (SELECT event_id AS token_id, user_id AS unit, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS pos,
  event_type AS g, value AS act, ts FROM events)""",
    "tokens": r"""words AS (SELECT doc_id AS unit, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
tokens AS (SELECT unit, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos, unnest(w) AS token FROM words)""",
}
ENCODED = ("acts", "atoms", "proj", "norms", "firings")


def with_(*names: str) -> str:
    """A WITH clause of the named bindings, without its final select."""
    return "WITH " + ",\n".join(SQL[n] for n in names)
