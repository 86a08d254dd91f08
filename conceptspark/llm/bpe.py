"""Byte-level BPE encoding and decoding with overlapping chunks.

Texts are cut into chunks that overlap.  Every chunk is pre-tokenised on its own.  Two
neighbours agree from the first place in their overlap where both have a pre-token boundary:
the pattern looks only ahead, so from a common boundary on both split the same.  The
stretches between such places are encoded on their own and put together again in order.
Decoding concatenates the raw bytes of the ids.

Where two neighbours share no boundary (a pre-token longer than the overlap) the chunks
are joined: the stretch runs on to the next agreed place, so the ids stay exact.

All texts go this way.  The chunks of a text of up to ``SPREAD`` code points are worked
through by the task that reads it; those of a longer one are dealt out over all tasks.

The pattern is the public one of the rank files; merges within a pre-token are tiktoken's.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptspark.runtime import others, stored

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: The characters of Unicode's White_Space property.
SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Code points of a chunk's core, and of the overlap on its right.
CHUNK = 4096
OVERLAP = 256
#: Code points of a text from which on its chunks are dealt out over tasks.
SPREAD = 32768
#: Code points at a chunk's end where a boundary may be an effect of the cut.
UNSURE = 4


@lru_cache(4)
def encoder(ranks: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@lru_cache(4)
def splitter(pattern: str):
    """The pattern for the regex module, with white space as tiktoken's Rust regex has it."""
    spelled = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
    return regex.compile(spelled)


def boundaries(text: str, pattern: str = PATTERN) -> list[int]:
    """Starts of the pre-tokens of ``text``."""
    return [m.start() for m in splitter(pattern).finditer(text)]


def chunks(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(start, text) of overlapping chunks; the last one ends with the text."""
    start = 0
    while True:
        yield start, text[start : start + chunk + overlap]
        if start + chunk + overlap >= len(text):
            return
        start += chunk


def edges(text: str, at: int, pattern: str, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """The boundaries of the chunk ``text``, which starts at ``at``, in its overlaps with its left and its right neighbour."""
    # A cut inside a contraction ('l|l) makes a false boundary in a chunk's last places.
    b = [x for x in boundaries(text, pattern) if x < len(text) - UNSURE]
    return [at + x for x in b if x < overlap], [at + x for x in b if x >= chunk]


def encode_stretch(text: str, start: int, end: int, enc: tiktoken.Encoding, pattern: str) -> list[int]:
    """Ids of ``text[start:end]``, between two boundaries."""
    # How trailing white space splits depends on what follows, so it is split in its place.
    head = text[start:end].rstrip(SPACES) if end < len(text) else text[start:]
    ids = enc.encode_ordinary(head)
    if start + len(head) < end:
        for m in splitter(pattern).finditer(text, start + len(head)):
            if m.start() >= end:
                break
            ids += enc.encode_ordinary(m[0])
    return ids


def encode_text(text: str, enc: tiktoken.Encoding, pattern: str = PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of a text: its chunks' boundaries, the places where neighbours agree, the stretches between them."""
    cut = list(chunks(text, chunk, overlap))
    sides = [edges(c, at, pattern, chunk, overlap) for at, c in cut] if len(cut) > 1 else []
    agreed = (min(set(a[1]).intersection(b[0]), default=None) for a, b in zip(sides, sides[1:]))
    places = [0, *(x for x in agreed if x is not None), len(text)]
    out: list[int] = []
    for a, b in zip(places, places[1:]):
        # What follows a stretch is needed only as far as the pattern looks ahead: to the end of a run of white space.
        out += encode_stretch(text[a : b + overlap], 0, b - a, enc, pattern) if text[b : b + overlap].strip(SPACES) else encode_stretch(text, a, b, enc, pattern)
    return out


def _digest(ids: list[int], enc: tiktoken.Encoding) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest()


def _in_place(texts, ranks, pattern, chunk, overlap):
    enc = encoder(ranks, pattern)
    rows = [_digest(encode_text(t, enc, pattern, chunk, overlap), enc) for t in texts]
    return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])


def stitched_chunks(docs: DataFrame, key: str, text: str, ranks=RANKS, pattern=PATTERN, chunk=CHUNK, overlap=OVERLAP) -> DataFrame:
    """(key, start, ids, bytes) of the encoded stretches of every text.

    Chunks are dealt out over all tasks.  A chunk learns its right neighbour's boundaries in
    their overlap from a small table of boundaries, never from another chunk's text, except
    where the two share none.
    """

    def cut(batches):
        for pdf in batches:
            rows = [(k, i, s, len(t), c) for k, t in zip(pdf["key"], pdf["text"]) for i, (s, c) in enumerate(chunks(t, chunk, overlap))]
            yield pd.DataFrame(rows, columns=["key", "i", "start", "length", "chunk"])

    pieces = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(cut, "key string, i int, start long, length long, chunk string")
    pieces = pieces.repartition(F.col("key"), F.col("i"))

    @F.pandas_udf("heads array<long>, tails array<long>")
    def edges_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, begins in batches:
            yield pd.DataFrame([edges(t, at, pattern, chunk, overlap) for t, at in zip(texts, begins)], columns=["heads", "tails"])

    known = pieces.withColumn("e", edges_of("chunk", "start"))
    known = stored(known.select("key", "i", "start", "chunk", "e.heads", "e.tails"), "bpe-chunks")
    order = W.partitionBy("key").orderBy("i")
    small = known.select("key", "i", "tails", F.lead("heads").over(order).alias("next_heads"))
    # The first boundary that both sides have; null at the end of a text or where there is none.
    small = small.select("key", "i", F.array_min(F.array_intersect("tails", "next_heads")).alias("sync"), F.col("next_heads").isNull().alias("last"))
    small = small.withColumn("from", F.when(F.col("i") == 0, F.lit(0).cast("long")).otherwise(F.lag("sync").over(order)))
    # Chunks that could not be told apart form one run; nearly all runs hold one chunk.
    small = small.withColumn("run", F.sum(F.col("from").isNotNull().cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    split = known.select("key", "i", "start", "chunk").join(small, ["key", "i"])

    def encode(k, pdf):
        pdf = pdf.sort_values("i")
        enc = encoder(ranks, pattern)
        first, end = pdf.iloc[0], pdf.iloc[-1]
        start = int(first["start"])
        whole = "".join([*(c[:chunk] for c in pdf["chunk"].iloc[:-1]), end["chunk"]])
        upto = len(whole) if end["last"] else int(end["sync"]) - start
        ids = encode_stretch(whole, int(first["from"]) - start, upto, enc, pattern)
        return pd.DataFrame({"key": [k[0]], "start": [int(first["from"])], "n": [len(ids)], "ids": [" ".join(map(str, ids))], "raw": [enc.decode_bytes(ids)]})

    return split.groupBy("key", "run").applyInPandas(encode, "key string, start long, n long, ids string, raw binary")


def encode(docs: DataFrame, key="doc_id", text="text", ranks=RANKS, pattern=PATTERN, chunk=CHUNK, overlap=OVERLAP, spread=SPREAD) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of every text, beside the other columns but ``text``.

    A null text counts as empty: 0 tokens and the digests of nothing.  Rows may repeat an
    id; each row gets its own result.  An empty table gives an empty result.  Columns of
    these names are replaced.  Texts of more than ``spread`` code points are dealt out in chunks.
    """
    made = ("n_tokens", "ids_sha256", "decoded_sha256")
    rows = docs.select(*others(docs, *made, text, "__text"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    long = F.length("__text") > spread

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def in_place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield _in_place(s, ranks, pattern, chunk, overlap)

    fields = [F.col(f"__r.{n}").alias(n) for n in made]
    one = rows.where(~long).withColumn("__r", in_place("__text"))
    one = one.select(*others(one, "__text", "__r"), *fields)

    # Long texts are rare; equal ones share a key, so a repeated row costs no second encoding.
    many = rows.where(long).withColumn("__key", F.sha2(F.col("__text").cast("binary"), 256))
    texts = many.select("__key", "__text").groupBy("__key").agg(F.first("__text").alias("__text"))
    parts = stitched_chunks(texts, "__key", "__text", ranks, pattern, chunk, overlap)
    whole = parts.groupBy("key").agg(F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("start", "ids", "raw"))).alias("p"))
    ids = F.array_join(F.filter(F.transform("p", lambda x: x["ids"]), lambda x: x != ""), " ")
    raw = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["raw"])), ""))
    whole = whole.select(F.col("key").alias("__k"), "n_tokens", F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(raw, 256).alias("decoded_sha256"))
    rest = many.drop("__text").join(whole, F.col("__key") == F.col("__k"), "left")
    return one.unionByName(rest.select(*others(rest, "__key", "__k", *made), *made))


def op5_bpe(spark, sf_dir) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
