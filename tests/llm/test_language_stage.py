"""The language stage drops what is in no learned language, and nothing that is."""

from __future__ import annotations

import random

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
LATIN = "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {
    "latin": LATIN,
    "base64": LATIN + LATIN.upper() + "0123456789+/",
    "cyrillic": "".join(map(chr, range(0x430, 0x450))),
    "greek": "".join(map(chr, range(0x3B1, 0x3CA))),
    "cjk": "".join(map(chr, range(0x4E00, 0x5E00))),
}


def test_noise_and_unlearned_scripts_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(11)
    rows = []
    for name, letters in ALPHABETS.items():
        for size in [100] * 40 + [4000] * 40:
            text = "".join(rng.choice(letters) if rng.random() < 0.84 else " " for _ in range(size))
            rows.append((-1 - len(rows), text, None, name, size))
    noise = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    noise = noise.select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])
    kept = [r[0] for r in pipeline.language_id(spark, docs.unionByName(noise), SF).select("doc_id").collect()]
    assert [x for x in kept if x < 0] == []
    assert sorted(kept) == sorted(r[0] for r in docs.select("doc_id").collect())
