"""Every stage against what it must keep, and the whole run against its stages done by hand."""

from __future__ import annotations

import hashlib

import pytest

import corpus_pipeline as pipeline
from conceptspark.llm import bpe
from conceptspark.runtime import stored
from tests.llm import util

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_filters_keep_clean_documents(spark, stages):
    docs, known, good = (s.toPandas() for s in stages[:3])
    assert list(known.columns) == list(good.columns) == list(docs.columns)
    assert set(known["doc_id"]) == set(docs["doc_id"])
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    kept = set(good["doc_id"])
    assert sum(i in kept for i in labels[labels == 1].index) / (labels == 1).sum() > 0.98
    assert sum(i in kept for i in labels[labels == 0].index) / (labels == 0).sum() < 0.05


def test_mix_and_tokens(spark, stages):
    one, mixed, coded = (s.toPandas() for s in stages[3:])
    words = one.set_index("doc_id")["text"].map(lambda t: len(t.split()))
    n = mixed.groupby("doc_id").size()
    assert n.max() <= 3 and set(n.index) <= set(words.index)
    enc = bpe.encoder(bpe.RANKS, bpe.PATTERN)
    texts = dict(zip(mixed["doc_id"], mixed["text"]))
    assert len(coded) == len(mixed)
    for d, k, h in zip(coded["doc_id"], coded["n_tokens"], coded["decoded_sha256"]):
        assert k == len(enc.encode_ordinary(texts[d])) and h == hashlib.sha256(texts[d].encode()).hexdigest()


def test_run_is_its_stages(spark, stages):
    key = lambda r: (r["doc_id"], r["n_tokens"], r["ids_sha256"])
    assert sorted(map(key, pipeline.run(spark, SF).collect())) == sorted(map(key, stages[-1].collect()))


NAMES = "doc_id long, text string, lang string, source string, n_chars long, score double, size double, taken string, target double, source_size long, mix_key string, lang_pred string, `a.b` int, __n double, __row string, __doc int, doc string, copy int"


@pytest.mark.parametrize("name,stage", pipeline.STAGES[:-1])
def test_stages_leave_columns_alone(spark, name, stage):
    """Awkward rows with clashing names: what a stage keeps, it keeps whole; an empty table stays empty."""
    rows = [(i, t, l, s, n, 9.5 + k, 9.5, f"taken{k}", -1.0, 7, "key", "xx", k, 2.5, "row", k, "doc", 5) for k, (i, t, l, s, n, *_) in enumerate(util.awkward())]
    docs = spark.createDataFrame(rows, NAMES).repartition(3)
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    kept = out.collect()
    assert {tuple(r) for r in kept} <= set(rows)
    if name == "mix_sources":
        # Without words a document stays once; with words at most three times.
        assert [sum(tuple(k) == r for k in kept) for r in rows if not (r[1] or "").split()] == [1, 1, 1]
        assert max(sum(tuple(k) == r for k in kept) for r in rows) <= 3
    if name == "near_dedup":
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 1), (False, 3), (False, 6), (False, 7), (False, 8), (False, 9), (True, 0)]
    assert stage(spark, docs.where("doc_id > 100"), SF).count() == 0
