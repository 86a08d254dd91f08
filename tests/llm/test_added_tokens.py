"""Ids are the library's with its defaults, in texts that hold added tokens too."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from conceptspark.llm import pfor

from .util import SCHEMA

TEXTS = ["a<|endoftext|>b", "<|endoftext|>", "one two <|endoftext|> three", "<|endoftext|><|endoftext|>x", "日本½<|endoftext|>", "<|endoftext|", "plain words only", ""]


def test_added_tokens_are_one_id(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert tok.encode(TEXTS[0], add_special_tokens=False).ids == [64, 50256, 65]
    docs = spark.createDataFrame([(i, t, *[None] * 8) for i, t in enumerate(TEXTS)], SCHEMA)
    got = sorted(pfor.read(pfor.write(docs, partitions=2)).collect(), key=lambda r: int(r["key"]))
    at = 0
    for r, t in zip(got, TEXTS, strict=True):
        ids = [*tok.encode(t, add_special_tokens=False).ids, pfor.END_ID]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())), t
        at += len(ids)
