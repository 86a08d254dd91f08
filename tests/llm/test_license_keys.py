"""A key phrase in place is a licence, whatever words lead to it."""

from __future__ import annotations

from conceptspark.llm import licenses

from .util import SCHEMA

CASES = [
    ("This work is under a CC BY-NC 4.0 license", "cc-by,cc-by-nc", 1.0),
    ("The MIT License (MIT)", "mit", 3 / 5),
    ("GNU GENERAL PUBLIC LICENSE Version 3", "gpl,gpl-3.0", 1.0),
    ("Apache License Version 2.0", "apache-2.0", 5 / 8),
    ("Mozilla Public License, v. 2.0", "mpl-2.0", 6 / 17),
    ("Mozilla Public License", "", 0.0),
    ("Apache Version 2.0 License", "", 0.0),
]


def test_key_phrase_decides(spark):
    docs = spark.createDataFrame([(i, t, *[None] * 8) for i, (t, _, _) in enumerate(CASES)], SCHEMA)
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in licenses.scan(docs).collect()}
    assert got == {i: (labels, round(score, 9)) for i, (_, labels, score) in enumerate(CASES)}
