"""Language identification with hyperdimensional profiles.

Every letter has a random +-1 vector.  The vector of an n-gram binds (multiplies) its
letters' vectors after permuting (rotating) each by its place; a document bundles (adds)
its trigram vectors; a language's prototype bundles the unit-length documents of that
language.  A document gets the language of the prototype with the largest cosine.

Letters are case-folded; runs of anything but letters count as one blank.  a to z have
symbols of their own, every other letter one of 101 by its code point.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptspark.runtime import others

DIM = 1024
SEED = 7
SYMBOLS = 128
#: Documents that the prototypes are fitted on at most (a hash sample of the labelled rows).
MAX_TRAINING = 20000
UNKNOWN = "und"
#: Characters, texts and distinct trigrams that are counted at once.
CHARS_AT_ONCE = 400_000
ROWS_AT_ONCE = 1000
COLUMNS_AT_ONCE = 4096


def _symbol(cp: int) -> int:
    c = chr(cp)
    if not c.isalpha():
        return 0
    c = c.lower()[0]
    return ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) * 40503 % 65536 % 101


@lru_cache(1)
def _table() -> np.ndarray:
    return np.array([0 if 0xD800 <= i < 0xE000 else _symbol(i) for i in range(0x10000)], dtype=np.int32)


@lru_cache(4)
def letter_vectors(dim: int = DIM, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.int8), size=(SYMBOLS, dim))


def trigram_vectors(codes: np.ndarray, dim: int, seed: int) -> np.ndarray:
    v = letter_vectors(dim, seed)
    a, b, c = codes // (SYMBOLS * SYMBOLS), codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
    return (np.roll(v, 2, axis=1)[a] * np.roll(v, 1, axis=1)[b] * v[c]).astype(np.float32)


def _symbols(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(cp) and cp.max() > 0xFFFF:
        found, where = np.unique(cp, return_inverse=True)
        return np.array([_symbol(int(x)) for x in found], dtype=np.int32)[where]
    return _table()[cp]


def _trigrams(text: str, at_once: int) -> Iterator[np.ndarray]:
    """Codes of a text's trigrams, in parts of about ``at_once`` characters."""
    text = f" {text} "
    last = np.zeros(0, dtype=np.int32)
    for at in range(0, len(text), at_once):
        s = np.concatenate([last, _symbols(text[at : at + at_once])])
        s = s[(s != 0) | np.concatenate(([True], s[:-1] != 0))]
        if len(s) > 2:
            yield (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
        last = s[-2:]


def bundles(texts: list[str], dim: int = DIM, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The bundled vectors of some texts, and which of them have a letter.

    Trigrams are counted for at most ``ROWS_AT_ONCE`` texts, ``CHARS_AT_ONCE`` characters and
    ``COLUMNS_AT_ONCE`` distinct trigrams at a time, whatever the texts' lengths.
    """
    out = np.zeros((len(texts), dim), dtype=np.float32)
    lettered = np.zeros(len(texts), dtype=bool)
    codes: list[np.ndarray] = []
    rows: list[int] = []

    def add():
        if not codes:
            return
        low, n = rows[0], rows[-1] - rows[0] + 1
        seen, where = np.unique(np.concatenate(codes), return_inverse=True)
        row = np.repeat(np.array(rows) - low, [len(c) for c in codes])
        for c in range(0, len(seen), COLUMNS_AT_ONCE):
            vectors = trigram_vectors(seen[c : c + COLUMNS_AT_ONCE], dim, seed)
            own = (where >= c) & (where < c + len(vectors)) if len(seen) > COLUMNS_AT_ONCE else slice(None)
            counts = np.bincount(row[own] * len(vectors) + where[own] - c, minlength=n * len(vectors))
            out[low : low + n] += counts.reshape(n, -1).astype(np.float32) @ vectors
        codes.clear()
        rows.clear()

    chars = 0
    for i, text in enumerate(texts):
        for c in _trigrams(text, CHARS_AT_ONCE):
            if codes and (chars + len(c) > CHARS_AT_ONCE or i - rows[0] >= ROWS_AT_ONCE):
                add()
                chars = 0
            # A text's trigrams always hold its letters; only blanks give the code 0.
            lettered[i] |= bool(c.any())
            codes.append(c)
            rows.append(i)
            chars += len(c)
    add()
    return out, lettered


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def fold_of(key: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids have no fold."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def fit(docs: DataFrame, text="text", lang="lang", key="doc_id", dim=DIM, seed=SEED, max_training=MAX_TRAINING) -> dict[str, list[float]]:
    """Prototypes of the languages in ``docs``, from at most about ``max_training`` rows.

    Rows without text or language are left out.  Each task adds up its own documents, the
    sums are added by Spark, and one vector per language comes to the driver.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    n = rows.count()
    if n > max_training:
        rows = rows.where(F.shiftrightunsigned(F.xxhash64("key"), 1) <= F.lit((2**63 - 1) * max_training // n))

    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            x, lettered = bundles(list(pdf["text"]), dim, seed)
            x = _unit(x)
            for name in pdf["lang"].unique():
                total[name] = total.get(name, 0) + x[(pdf["lang"] == name).to_numpy() & lettered].sum(axis=0, dtype=np.float64)
        for name, v in total.items():
            yield pd.DataFrame({"lang": [name], "v": [v]})

    parts = rows.select("lang", "text").mapInPandas(sums, "lang string, v array<double>")
    whole = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    out: dict[str, list[float]] = {}
    for r in whole.orderBy("lang", "i").collect():
        out.setdefault(r["lang"], []).append(r["x"])
    return {k: v for k, v in out.items() if any(v)}


def predict(docs: DataFrame, prototypes: dict[str, list[float]], text="text", dim=DIM, seed=SEED) -> DataFrame:
    """Add lang_pred and score (the cosine with the prototype, 0 where negative).

    A null text, a text without letters, or a model without languages gives ``und`` and 0.
    Equal cosines go to the language that sorts first.  Texts are taken one by one: repeated
    rows agree, and of a very long text only a part is worked on at a time.  An empty table
    gives an empty one.  Columns of these names are replaced.
    """
    names = sorted(prototypes)
    unit = _unit(np.array([prototypes[k] for k in names], dtype=np.float32)) if names else np.zeros((0, dim), dtype=np.float32)

    @F.pandas_udf("lang_pred string, score double")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            texts = [t if isinstance(t, str) else "" for t in s]
            x, lettered = bundles(texts, dim, seed)
            if not names:
                lettered[:] = False
                yield pd.DataFrame({"lang_pred": [UNKNOWN] * len(s), "score": np.zeros(len(s))})
                continue
            cos = (_unit(x) @ unit.T).astype(np.float64)
            top = cos.argmax(axis=1)
            score = np.where(lettered, np.clip(cos[np.arange(len(s)), top], 0.0, 1.0), 0.0)
            yield pd.DataFrame({"lang_pred": [names[t] if ok else UNKNOWN for t, ok in zip(top, lettered)], "score": score})

    found = docs.select(*others(docs, "lang_pred", "score", "__found"), best(F.col(text)).alias("__found"))
    return found.select(*others(found, "__found"), F.col("__found.lang_pred").alias("lang_pred"), F.col("__found.score").alias("score"))


def op10_language_id(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False))
    model = fit(docs.where(fold_of("doc_id", 5) != 0))
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
