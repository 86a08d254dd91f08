"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

A text becomes about twenty statistics (letter classes, word lengths, repetition, ...).
Standardised, they are mapped by random Fourier features, whose inner products approximate
a Gaussian kernel.  Each task adds up its rows' part of the normal equations, Spark adds
those up, and the driver solves one small system.  The labelled rows stand in two folds;
each fold is scored with the other's solution, and the share of label 1 among scores of
one bin is made monotone by pooling adjacent violators.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptspark.runtime import others, stored

FOURIER = 256
SEED = 11
WIDTH = 1.0
RIDGE = 1e-3
#: Labelled rows that are fitted on at most (a hash sample of them).
MAX_TRAINING = 200_000
BIN = 0.002
NAMES = (
    "log_bytes", "log_words", "upper", "lower", "digit", "space", "newline", "exclaim", "bar", "symbol", "stop", "non_ascii", "entropy",
    "word_len", "word_len_std", "distinct", "top_word", "doubled", "upper_words", "alpha_words", "lines", "distinct_lines", "packed",
)
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_SYMBOL, _STOP = list(b"#$%&*@^~<>{}[]\\=+_/"), list(b".,;:?")


def statistics(text: str) -> list[float]:
    """The statistics of a text, in the order of ``NAMES``; zeros for an empty one."""
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    words = text.split()
    if not n:
        return [0.0] * len(NAMES)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    some = hist[hist > 0]
    m = max(1, len(words))
    lens = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    seen = Counter(words)
    lines = text.split("\n")
    return [
        np.log1p(n), np.log1p(len(words)), hist[_UPPER].sum(), hist[_LOWER].sum(), hist[_DIGIT].sum(), hist[32], hist[10], hist[33], hist[124], hist[_SYMBOL].sum(), hist[_STOP].sum(),
        hist[128:].sum(), -(some * np.log2(some)).sum(), np.log1p(lens.mean()), np.log1p(lens.std()), len(seen) / m, max(seen.values(), default=0) / m, sum(map(eq, words, words[1:])) / m,
        sum(map(str.isupper, words)) / m, sum(map(str.isalpha, words)) / m, np.log1p(len(lines)), len(set(lines)) / len(lines), len(zlib.compress(raw, 1)) / (n + 20),
    ]


def with_statistics(docs: DataFrame, text="text") -> DataFrame:
    """The columns of ``docs`` but the text, and ``stats``, an array of doubles."""

    @F.pandas_udf("array<double>")
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([statistics(t) for t in s])

    return docs.select(*others(docs, text, "stats"), stats(F.coalesce(F.col(text), F.lit(""))).alias("stats"))


@dataclass
class Model:
    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray


def _fourier(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Random features, the standardised statistics themselves, and 1."""
    z = np.clip((x - mean) / std, -8, 8)
    rng = np.random.default_rng(SEED)
    w = rng.normal(0, WIDTH / np.sqrt(z.shape[1]), (z.shape[1], FOURIER))
    phase = rng.uniform(0, 2 * np.pi, FOURIER)
    return np.hstack([np.sqrt(2 / FOURIER) * np.cos(z @ w + phase), z / np.sqrt(z.shape[1]), np.ones((len(z), 1))])


def pool(score: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit by pooling adjacent violators: knots and values of the pools."""
    pools: list[list[float]] = []
    for s, k, m in zip(score, ones, n):
        pools.append([s * m, k, m])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            a = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], a)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(rows: DataFrame, label="label", max_training=MAX_TRAINING) -> Model | None:
    """Fit on (key, stats, label 0/1); None without rows of both labels."""
    rows = rows.where(F.col(label).isin(0, 1))
    n = rows.count()
    if n > max_training:
        rows = rows.where(F.shiftrightunsigned(F.xxhash64("key", F.lit("take")), 1) <= F.lit((2**63 - 1) * max_training // n))
    rows = rows.select("key", "stats", F.col(label).cast("double").alias("y"), F.pmod(F.xxhash64("key"), F.lit(2)).cast("int").alias("fold"))
    rows = stored(rows.repartition(16, "key").drop("key"), "quality-training")
    at = F.posexplode("stats").alias("i", "x")
    moments = rows.select(at).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()
    both = rows.agg(F.count_distinct("y").alias("k")).first()["k"]
    if both < 2:
        return None
    mean, std = np.array([r["m"] for r in moments]), np.maximum([r["s"] for r in moments], 1e-6)

    def part(batches):
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            z = np.hstack([_fourier(np.vstack(pdf["stats"]), mean, std), pdf[["y"]].to_numpy()])
            for f in (0, 1):
                own = z[(pdf["fold"] == f).to_numpy()]
                total[f] = total.get(f, 0) + own.T @ own
        for f, a in total.items():
            yield pd.DataFrame({"fold": f, "i": np.arange(len(a)), "row": list(a)})

    parts = rows.mapInPandas(part, "fold int, i int, row array<double>")
    whole = parts.select("fold", "i", F.posexplode("row").alias("j", "x")).groupBy("fold", "i", "j").agg(F.sum("x").alias("x"))
    size = FOURIER + len(NAMES) + 2
    gram = np.zeros((2, size, size))
    for r in whole.collect():  # 2 * size * size numbers, whatever the input
        gram[r["fold"], r["i"], r["j"]] = r["x"]

    def solve(g):
        a = g[:-1, :-1] + RIDGE * max(g[-2, -2], 1.0) * np.eye(size - 1)
        return np.linalg.solve(a, g[:-1, -1])

    folds = [solve(gram[1]), solve(gram[0])]

    def cross(batches):
        for pdf in batches:
            z = _fourier(np.vstack(pdf["stats"]), mean, std)
            s = np.where(pdf["fold"] == 0, z @ folds[0], z @ folds[1])
            yield pd.DataFrame({"bin": np.round(np.clip(s, -1, 2) / BIN).astype(int), "y": pdf["y"]})

    bins = rows.mapInPandas(cross, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("ones"), F.count("*").alias("n")).orderBy("bin").toPandas()
    knots, values = pool(bins["bin"].to_numpy() * BIN, bins["ones"].to_numpy(), bins["n"].to_numpy())
    return Model(mean, std, solve(gram.sum(axis=0)), knots, values)


def _apply(stats, model: Model | None) -> np.ndarray:
    if model is None or not len(stats):
        return np.full(len(stats), 0.5)
    raw = _fourier(np.vstack(stats), model.mean, model.std) @ model.weights
    return np.clip(np.interp(raw, model.knots, model.values), 0.0, 1.0)


def score(rows: DataFrame, model: Model | None) -> DataFrame:
    """Replace ``stats`` by ``score``, 0 to 1; 0.5 without a model."""

    @F.pandas_udf("double")
    def of(s: pd.Series) -> pd.Series:
        return pd.Series(_apply(s, model))

    return rows.select(*others(rows, "stats", "score"), of("stats").alias("score"))


def score_texts(docs: DataFrame, model: Model | None, text="text") -> DataFrame:
    """Add ``score`` (replaced) beside all columns, from the texts themselves."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(_apply([statistics(t) for t in s], model))

    return docs.select(*others(docs, "score"), of(F.coalesce(F.col(text), F.lit(""))).alias("score"))


def fold_of(key: str, n: int) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def learn(docs: DataFrame, labels: DataFrame, key="doc_id", text="text", teaching: Column | None = None) -> tuple[DataFrame, Model | None]:
    """(statistics of all rows as (key, stats), model) from ``labels`` of (key, label 0/1).

    ``teaching`` restricts the rows that are learned from.  Of several labels of one key the
    more frequent counts and a tie teaches nothing; null labels and null keys are left out.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = stored(with_statistics(rows, "text"), "quality-statistics")
    teach = labels.select("key", "label").where("label in (0, 1) and key is not null").groupBy("key").agg(F.avg("label").alias("a"))
    teach = teach.where("a <> 0.5").select("key", (F.col("a") > 0.5).cast("int").alias("label"))
    known = rows if teaching is None else rows.where(teaching)
    return rows, fit(known.join(teach, "key"))


def classify(docs: DataFrame, labels: DataFrame, key="doc_id", text="text", teaching: Column | None = None) -> DataFrame:
    """(key, score) for every row of ``docs``.

    Null and empty texts have zero statistics and are scored like others; a very long text is
    read whole, alone in its turn.  Repeated rows get equal scores.  Without labels of both
    kinds every score is 0.5.  An empty table gives an empty one.  Only key and score come
    back, so other columns' names don't matter.
    """
    return score(*learn(docs, labels, key, text, teaching))


def op3_quality(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("key"), F.col("quality").alias("label"))
    scored = classify(docs.select("doc_id", "text"), labels, teaching=fold_of("key", 3) != 1)
    held = F.coalesce(fold_of("key", 3) == 1, F.lit(False))
    return scored.select(F.col("key").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
