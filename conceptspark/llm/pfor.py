"""Token ids in patched frame-of-reference files.

Ids are cut into blocks of 1024.  A block subtracts its minimum, packs what is left at the
width that its 90th percentile needs, and lists the larger ones apart (place, high bits).
The low bits of an exception stay in its packed slot, so patching only adds high bits.

A file is a row of binary segments: each holds one or more documents' ids, its own block
directory, and the document lengths; segments are sorted by document id over all files.
Layout of a segment, all little-endian:

    magic 'PFR1' | n_ids u32 | n_blocks u32 | block size u32
    directory, one entry a block: offset u32 | minimum u32 | count u16 | width u8 | - u8 | exceptions u16
    blocks: packed low bits (the last block filled up) | exception places u16[] | exception high parts u32[]
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptspark.llm.arrow import slices
from conceptspark.runtime import stored

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
BLOCK = 1024
PERCENTILE = 90
SEGMENT_IDS = 1 << 18
#: Keys of the sample that the bounds of a range are taken from, about, for each range.
KEYS_PER_RANGE = 50
#: Pieces of a generation that a worker remembers (two are kept), and bytes of text encoded at once.
CACHE_PIECES = 500_000
TEXT_AT_ONCE = 4_000_000
#: The public pattern in terms of ``re``; letters are \w without digits and underscore.
PIECES = re.compile(r" ?[^\W\d_]+| ?\d+|'(?:[stmd]|re|ve|ll)| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
#: Characters outside the blocks where that holds (superscripts, fractions, separators, ...).
UNCOMMON = re.compile("[^\t\n\r -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u0391-\u03a9\u03b1-\u03c9\u0400-\u045f\u0620-\u064a\u2010-\u2027\u20ac\u3001\u3002\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")
#: Units that don't stand on their own, by the white space among common characters.
LOOSE = "^$|^[\t\n\r\xa0]|[\t\n\r\xa0]$"
_HEAD = np.dtype([("offset", "<u4"), ("minimum", "<u4"), ("count", "<u2"), ("width", "u1"), ("pad", "u1"), ("exceptions", "<u2")])


def _pack(x: np.ndarray, width: int) -> np.ndarray:
    """Low ``width`` bits of every number of (blocks, n), n a multiple of 64, as bytes per block.

    64 numbers fill ``width`` words of 64 bits; the j-th numbers of all groups move together.
    """
    lanes = (x & np.uint32((1 << width) - 1)).astype(np.uint64).reshape(-1, 64).T.copy()
    out = np.zeros((width, lanes.shape[1]), dtype=np.uint64)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        out[word] |= lanes[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).astype("<u8").view(np.uint8).reshape(len(x), -1)


@lru_cache(64)
def _places(width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets and shifts of ``n`` numbers packed at ``width`` bits."""
    at = np.arange(n, dtype=np.int64) * width
    return at >> 3, (at & 7).astype(np.uint64)


def _unpack(raw: np.ndarray, begin: np.ndarray, width: int, n: int) -> np.ndarray:
    """The numbers of blocks that begin at the bytes ``begin``, packed at ``width`` bits."""
    offsets, shifts = _places(width, n)
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    return ((words[begin[:, None] + offsets] >> shifts) & np.uint64((1 << width) - 1)).astype(np.uint32)


def encode_segment(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    """Blocks of one width are packed together; the last block is filled up with its minimum."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    n_blocks = -(-len(ids) // block)
    heads = np.zeros(n_blocks, dtype=_HEAD)
    heads["count"] = np.minimum(block, len(ids) - block * np.arange(n_blocks))
    full = np.concatenate([ids, np.full(n_blocks * block - len(ids), ids[(n_blocks - 1) * block :].min() if n_blocks else 0, dtype=np.uint32)]).reshape(n_blocks, block)
    heads["minimum"] = full.min(axis=1)
    x = full - heads["minimum"][:, None]
    at = (block - 1) * percentile // 100
    ranked = np.partition(x, at, axis=1)[:, at] if n_blocks else np.zeros(0, dtype=np.uint32)
    heads["width"] = np.where(ranked > 0, np.floor(np.log2(np.maximum(ranked, 1))) + 1, 0)
    width = heads["width"].astype(np.uint64)[:, None]
    high = (x.astype(np.uint64) >> width).astype("<u4")
    row, place = np.nonzero(high)
    heads["exceptions"] = np.bincount(row, minlength=n_blocks)
    packed: list[bytes] = [b""] * n_blocks
    for w in np.unique(heads["width"]):
        own = np.flatnonzero(heads["width"] == w)
        for b, data in zip(own, _pack(x[own], int(w))):
            packed[b] = data.tobytes()
    ends = np.cumsum(heads["exceptions"], dtype=np.int64)
    places, tops = place.astype("<u2"), high[row, place]
    body = [p + places[e - n : e].tobytes() + tops[e - n : e].tobytes() for p, e, n in zip(packed, ends, heads["exceptions"].astype(np.int64))]
    sizes = np.array([len(x) for x in body], dtype=np.int64)
    heads["offset"] = np.cumsum(sizes) - sizes
    return b"PFR1" + np.array([len(ids), n_blocks, block], dtype="<u4").tobytes() + heads.tobytes() + b"".join(body)


def decode_segment(data: bytes, first: int = 0, upto: int | None = None) -> np.ndarray:
    """Ids first .. upto - 1 of a segment; only the blocks that hold them are unpacked."""
    if data[:4] != b"PFR1":
        raise ValueError("not a segment")
    n, n_blocks, block = (int(v) for v in np.frombuffer(data, "<u4", 3, 4))
    upto = n if upto is None else min(upto, n)
    if first >= upto:
        return np.zeros(0, dtype=np.uint32)
    b0, b1 = first // block, (upto - 1) // block
    heads = np.frombuffer(data, _HEAD, n_blocks, 16)[b0 : b1 + 1]
    begin = 16 + n_blocks * _HEAD.itemsize + heads["offset"].astype(np.int64)
    raw = np.frombuffer(data + bytes(8), np.uint8)  # the last words may reach past the end
    out = np.zeros((len(heads), block), dtype=np.uint32)
    for w in np.unique(heads["width"]):
        own = np.flatnonzero(heads["width"] == w)
        if w:
            out[own] = _unpack(raw, begin[own], int(w), block)
    for i in np.flatnonzero(heads["exceptions"]):
        k, w = int(heads["exceptions"][i]), int(heads["width"][i])
        at = int(begin[i]) + block * w // 8
        out[i, np.frombuffer(data, "<u2", k, at)] |= (np.frombuffer(data, "<u4", k, at + 2 * k).astype(np.uint64) << np.uint64(w)).astype(np.uint32)
    out += heads["minimum"][:, None]
    return out.ravel()[first - b0 * block : upto - b0 * block]


@lru_cache(1)
def _byte_chars() -> dict[int, int]:
    """The printable character that stands for each byte in the tokenizer's vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class _Remembered(dict):
    """What a worker remembers of ``make``, in two generations.

    A full young one becomes the old one, and what is met again moves back, so frequent
    entries stay and memory is bounded.
    """

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, x):
        found = self.old.get(x)
        if found is None:
            found = self.make(x)
        if len(self) >= CACHE_PIECES:
            self.old = dict(self)
            self.clear()
        self[x] = found
        return found


class Encoder:
    """Ids of texts by the tokenizers library, whose pieces' ids are remembered.

    The library splits a text into pieces by the public pattern and gives each, its bytes
    spelled as printable characters, to its merge model; a text's ids are its pieces' ids in
    order.  A blank between two characters that are no white space always begins a piece, so
    a text parted at its blanks is a row of units that split on their own.  In texts of
    common characters, for which Python's ``re`` and the pattern's classes agree, units are
    split here and only pieces not met before go to the library's model.  Any other text goes
    to the library as a whole, and so does a text that holds an added token
    (``<|endoftext|>``), which is one id and no piece.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.pieces = _Remembered(self._piece)

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            spelled = piece.replace(" ", "\u0120")
        else:
            spelled = piece.encode().decode("latin-1").translate(_byte_chars())
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _ids(self, pieces: list[str]) -> pa.Array:
        """Ids of each piece, as bytes; each distinct one is looked up once."""
        seen = pa.array(pieces, pa.large_string()).dictionary_encode()
        known = list(map(self.pieces.__getitem__, seen.dictionary.to_pylist()))
        return pa.array(known, pa.large_binary()).take(seen.indices)

    def _runs(self, pieces: list[str], begin: np.ndarray) -> pa.Array:
        """Ids of runs of pieces; a run ends where the next begins, the last one with the pieces."""
        if not len(begin):
            return pa.array([], pa.large_binary())
        ids = self._ids(pieces)
        ends = np.append(begin, len(pieces))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(_offsets(ids)[ends].tobytes()), ids.buffers()[2]])

    def _each(self, texts: list[str]) -> pa.Array:
        """Ids of texts of common characters, split by the pattern as they are."""
        split = list(map(PIECES.findall, texts))
        sizes = np.array(list(map(len, split)), dtype=np.int64)
        return self._runs([p for s in split for p in s], np.cumsum(sizes) - sizes)

    def _common(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of common characters: each distinct unit among them is split once."""
        parted = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        begin = parted.offsets.to_numpy()
        first = begin[:-1]
        heads = parted.values.take(pa.array(first)).to_pylist()
        seen = parted.values.dictionary_encode()
        at = seen.indices.to_numpy(zero_copy_only=False).copy()
        # An empty unit, or one that begins or ends with white space, doesn't stand on its own.
        loose = pc.match_substring_regex(seen.dictionary, LOOSE).to_numpy(zero_copy_only=False)
        astray = loose[at]
        astray[first] = [not h or h[-1].isspace() for h in heads]
        alone = np.logical_or.reduceat(astray, first)
        sound = seen.dictionary.filter(pa.array(~loose)).to_pylist()
        pieces = PIECES.findall(" " + " ".join(sound)) if sound else []
        units = self._runs(pieces, np.flatnonzero([p[0] == " " for p in pieces]))
        place = np.cumsum(~loose) - 1
        at = place[at]
        at[first] = len(sound) + np.arange(len(first))
        flat = pa.concat_arrays([units, self._each(heads)]).take(pa.array(np.maximum(at, 0)))
        ends = _offsets(flat)[begin]
        data = memoryview(flat.buffers()[2] or b"")
        again = iter(self._each([t for t, x in zip(texts, alone) if x]).to_pylist())
        return [next(again) if x else bytes(data[a:b]) for x, a, b in zip(alone, ends, ends[1:])]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        whole = {i for i, t in enumerate(texts) if UNCOMMON.search(t) or any(a in t for a in self.added)}
        found = self.tokenizer.encode_batch_fast([texts[i] for i in sorted(whole)], add_special_tokens=False)
        out = [array("I", e.ids).tobytes() for e in found]
        rest = [i for i in range(len(texts)) if i not in whole]
        made = dict(zip([*sorted(whole), *rest], [*out, *(self._common([texts[i] for i in rest]) if rest else [])]))
        return [made[i] for i in range(len(texts))]


def _offsets(x: pa.Array) -> np.ndarray:
    return np.frombuffer(x.buffers()[1], "<i8", len(x) + 1, x.offset * 8)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def range_bounds(docs: DataFrame, key: str, n: int) -> list:
    """At most ``n - 1`` keys that part the rows into ranges of about equal numbers, from a bounded sample of the keys."""
    total, most = max(1, docs.count()), KEYS_PER_RANGE * n
    keys = docs.select(F.col(key).alias("k")).where("k is not null")
    some = keys.where(F.shiftrightunsigned(F.xxhash64("k"), 1) <= F.lit((2**63 - 1) * min(most, total) // total)).distinct()
    found = [r["k"] for r in some.orderBy("k").limit(2 * most).collect()]
    return sorted({found[len(found) * i // n] for i in range(1, n)}) if found else []


def write(docs: DataFrame, key="doc_id", text="text", tokenizer=TOKENIZER, end_id=END_ID, segment_ids=SEGMENT_IDS, partitions: int | None = None) -> DataFrame:
    """Write every text's ids in ascending order of ``key``; returns the table of segments.

    Texts are encoded where they are read; what is range-sorted are their ids, by bounds that
    come from the keys alone.  A segment row: file (number of the range of keys), segment,
    keys, lengths, data.  Equal keys stand side by side in no set order; a null key comes
    first.  A null or empty text holds the end id alone.  Every segment has at most about
    ``segment_ids`` ids, unless one document is longer.  An empty table gives no segments.
    Other columns, whatever their names, are left out.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(docs, key, n)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("file", T.IntegerType()), rows.schema["key"], T.StructField("ids", T.BinaryType())])

    def encode(batches):
        enc, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            for lo, hi in slices(pc.binary_length(b["text"]).to_pylist(), TEXT_AT_ONCE):
                keys = b["key"].slice(lo, hi - lo)
                files = [0 if k is None else bisect_right(bounds, k) for k in keys.to_pylist()]
                ids = [_narrow(x + end) for x in enc(b["text"].slice(lo, hi - lo).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), keys, pa.array(ids, pa.binary())], names=schema.names)

    def pack(batches):
        file, number = None, 0
        keys, parts, size = [], [], 0
        for pdf in batches:
            for f, k, ids in zip(pdf["file"], pdf["key"], pdf["ids"]):
                if keys and (f != file or size >= segment_ids):
                    yield _segment(file, number, keys, parts)
                    keys, parts, size, number = [], [], 0, number + 1
                if f != file:
                    file, number = f, 0
                parts.append(_wide(ids))
                keys.append(k)
                size += len(parts[-1])
        if keys:
            yield _segment(file, number, keys, parts)

    coded = rows.mapInArrow(encode, schema).repartitionById(n, F.col("file")).sortWithinPartitions("file", F.col("key").asc_nulls_first())
    coded = coded.select("file", F.col("key").cast("string").alias("key"), "ids")
    return stored(coded.mapInPandas(pack, "file int, segment int, keys array<string>, lengths array<int>, data binary"), "pfor")


def _narrow(ids: bytes) -> bytes:
    """Ids for storage: a byte that tells their width, then 2 bytes each where they fit, else 4."""
    x = np.frombuffer(ids, "<u4")
    return b"\2" + x.astype("<u2").tobytes() if int(x.max()) < 1 << 16 else b"\4" + ids


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype("<u4")


def _segment(file, number, keys, parts):
    return pd.DataFrame({"file": [file], "segment": [number], "keys": [keys], "lengths": [list(map(len, parts))], "data": [encode_segment(np.concatenate(parts))]})


def read(segments: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document in the files.

    Starts are prefix sums: of ids over segments (a window within each file, and one over
    the files' totals), of lengths within a segment.
    """
    inside = W.partitionBy("file").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    small = segments.select("file", "segment", size.alias("n"))
    files = small.groupBy("file").agg(F.sum("n").alias("n"))
    # One row per file: as many as there are partitions, whatever the number of documents.
    over = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    files = files.select(F.col("file"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("file_start"))
    starts = small.withColumn("segment_start", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(files, "file")
    starts = starts.select("file", "segment", (F.col("file_start") + F.col("segment_start")).alias("base"))

    def unpack(batches):
        for pdf in batches:
            for f, s, keys, lengths, data in zip(pdf["file"], pdf["segment"], pdf["keys"], pdf["lengths"], pdf["data"]):
                ids = decode_segment(data).astype("<u4")
                ends = np.cumsum(lengths, dtype=np.int64)
                begins = ends - np.asarray(lengths)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends)]
                yield pd.DataFrame({"file": f, "segment": s, "key": keys, "at": begins, "n_tokens": ends - begins, "ids_crc32": crc})

    docs = segments.mapInPandas(unpack, "file int, segment int, key string, at long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["file", "segment"]).select("key", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_files(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read(write(docs)).select(F.col("key").cast("long").alias("doc_id"), "start", "n_tokens", "ids_crc32")
