"""FLAC columns: lossless 8-bit mono streams, their frames, and seekable PCM blocks.

The decoder finds frames by their sync code, header checksum and running number, verifies
every frame's CRC-16 and the stream's MD5, and decodes the frames of a whole batch of rows
in step: one vector operation handles the n-th residual (or sample) of all frames, so the
cost of Python is shared by thousands of frames.  Rice residuals, fixed and general linear
predictors, constant and verbatim subframes are read.

The encoder writes fixed-size blocks with a fixed predictor (order 0 to 4) or a quantised
linear predictor of order 4, whichever leaves the smaller residual, and four Rice
partitions.  It takes payloads whose length is a positive multiple of 64.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptspark.llm.arrow import with_columns
from conceptspark.runtime import others, stored

UNIT = 64
BLOCK = 1024
RATE = 8000
#: Samples that are encoded or decoded in step at most (more where one stream is longer).
AT_ONCE = 1_000_000
LPC_ORDER, LPC_BITS, PARTITION_ORDER = 4, 12, 2
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
BLOCKS = "array<struct<block:int,sample_offset:long,media_offset:long,pcm:binary>>"


@lru_cache(1)
def _crc_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-8 (0x07) by byte, CRC-16 (0x8005) by byte and by pair of bytes."""
    t8, t16 = np.arange(256, dtype=np.uint16), np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t8 = np.where(t8 & 0x80, (t8 << 1) ^ 0x07, t8 << 1) & 0xFF
        t16 = np.where(t16 & 0x8000, (t16 << 1) ^ 0x8005, t16 << 1) & 0xFFFF
    pair = np.arange(65536, dtype=np.uint32)
    step = ((t16[pair >> 8] << 8) & 0xFFFF) ^ t16[(t16[pair >> 8] >> 8) ^ (pair & 0xFF)]
    return t8.astype(np.uint8), t16.astype(np.uint16), step.astype(np.uint16)


def crc8(data: bytes) -> int:
    table, c = _crc_tables()[0], 0
    for b in data:
        c = int(table[c ^ b])
    return c


def crc16(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of many stretches of a buffer, two bytes of each in a step."""
    _, one, two = _crc_tables()
    words = np.ndarray((len(buf) - 1,), ">u2", buf, strides=(1,))
    order = np.argsort(-size, kind="stable")
    at, n = start[order], size[order]
    crc = np.zeros(len(at), dtype=np.uint16)
    live = np.searchsorted(-(n // 2), -np.arange(1, (n[0] // 2 if len(n) else 0) + 1), side="right")
    for i, m in enumerate(live):
        crc[:m] = two[crc[:m] ^ words[at[:m] + 2 * i]]
    odd = np.flatnonzero(n & 1)
    last = buf[at[odd] + n[odd] - 1]
    crc[odd] = (crc[odd] << 8) ^ one[(crc[odd] >> 8) ^ last]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _utf8(n: int) -> bytes:
    """The frame number in the extended UTF-8 of frame headers."""
    if n < 0x80:
        return bytes([n])
    tail = []
    size = 2
    while n >= 1 << (5 * size + 1 if size > 1 else 7):
        size += 1
    for _ in range(size - 1):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF00 >> size) & 0xFF | n, *reversed(tail)])


@lru_cache(65536)
def _frame_header(number: int, block: int) -> bytes:
    h = b"\xff\xf8\x70\x02" + _utf8(number) + (block - 1).to_bytes(2, "big")
    return h + bytes([crc8(h)])


def _stream_header(block: int, total: int, md5: bytes) -> bytes:
    info = block.to_bytes(2, "big") * 2 + bytes(6) + (RATE << 44 | 7 << 36 | total).to_bytes(8, "big") + md5
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info


def pad(payload: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of ``UNIT``."""
    return payload + bytes(-len(payload) % UNIT or (0 if payload else UNIT))


def _lpc(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictors (frames, order) and shifts, by least squares on autocorrelations."""
    f = x.astype(np.float64)
    r = np.stack([(f[:, : f.shape[1] - k] * f[:, k:]).sum(axis=1) for k in range(LPC_ORDER + 1)], axis=1)
    at = np.abs(np.subtract.outer(np.arange(LPC_ORDER), np.arange(LPC_ORDER)))
    a = r[:, at] + (1e-6 * r[:, :1, None] + 1e-3) * np.eye(LPC_ORDER)
    c = np.linalg.solve(a, r[:, 1:, None])[:, :, 0]
    top = np.maximum(np.abs(c).max(axis=1), 1e-9)
    shift = np.clip(LPC_BITS - 1 - np.ceil(np.log2(top) + 1e-9), 0, 15).astype(np.int64)
    limit = (1 << (LPC_BITS - 1)) - 1
    return np.clip(np.round(c * (1 << shift)[:, None]), -limit - 1, limit).astype(np.int32), shift.astype(np.int32)


def _residuals(x: np.ndarray, coef: np.ndarray, shift: np.ndarray) -> np.ndarray:
    order = coef.shape[1]
    p = sum(coef[:, j : j + 1] * x[:, order - 1 - j : x.shape[1] - 1 - j] for j in range(order))
    return x[:, order:] - (p >> shift[:, None]) if order else x


def _subframes(x: np.ndarray) -> list[bytes]:
    """The subframes of frames of one block size; rows of ``x`` are their samples."""
    n, size = x.shape
    x = x.astype(np.int32)
    coef, shift = _lpc(x)
    kinds = [x]
    for _ in FIXED[1:]:
        kinds.append(np.diff(kinds[-1], axis=1))  # a fixed predictor's residual is a difference
    kinds.append(_residuals(x, coef, shift))
    cost = np.stack([np.abs(r).sum(axis=1) for r in kinds], axis=1)
    best = cost.argmin(axis=1)
    out: list[bytes] = [b""] * n
    for kind, res in enumerate(kinds):
        own = np.flatnonzero(best == kind)
        if not len(own):
            continue
        order = LPC_ORDER if kind == len(FIXED) else kind
        r = res[own]
        u = (r << 1) ^ (r >> 31)
        parts = 1 << PARTITION_ORDER
        per = size // parts
        bounds = [0, *(per * i - order for i in range(1, parts)), size - order]
        values, bits = [], []

        def put(v, b):
            values.append(np.asarray(v).reshape(len(own), -1))
            bits.append(np.broadcast_to(np.asarray(b), values[-1].shape))

        head = (32 + order - 1) << 1 if kind == len(FIXED) else (8 + order) << 1
        put(np.full(len(own), head), 8)
        if order:
            put(x[own, :order] & 0xFF, 8)
        if kind == len(FIXED):
            put(np.full(len(own), LPC_BITS - 1), 4)
            put(shift[own], 5)
            put(coef[own] & ((1 << LPC_BITS) - 1), LPC_BITS)
        put(np.full(len(own), PARTITION_ORDER), 6)
        for a, b in zip(bounds, bounds[1:]):
            part = u[:, a:b]
            # The best parameter is near log2 of the mean; its two lower neighbours are weighed too.
            top = np.log2(np.maximum(part.mean(axis=1), 1.0)).astype(np.int32)[:, None]
            tries = [np.clip(top - i, 0, 14) for i in range(3)]
            cost = np.hstack([(part >> k).sum(axis=1, keepdims=True) + (b - a) * (k + 1) for k in tries])
            k = np.take_along_axis(np.hstack(tries), cost.argmin(axis=1)[:, None], axis=1)
            put(k, 4)
            put((1 << k) | (part & ((1 << k) - 1)), (part >> k) + 1 + k)
        v, nb = np.hstack(values), np.hstack(bits)
        total = nb.sum(axis=1, dtype=np.int64)
        words = (total + 31) // 32
        first = np.cumsum(words) - words
        last = (np.cumsum(nb, axis=1, dtype=np.int64) + first[:, None] * 32 - 1).ravel()
        wide = v.ravel().astype(np.int64) << (31 - (last & 31))
        n_words = int(words.sum()) + 1
        low = np.bincount(last >> 5, wide & 0xFFFFFFFF, n_words)
        high = np.bincount(np.maximum((last >> 5) - 1, 0), wide >> 32, n_words)
        data = (low + high).astype(np.uint64).astype(">u4").tobytes()
        for i, (w, t) in enumerate(zip(first * 4, (total + 7) // 8)):
            out[own[i]] = data[w : w + t]
    return out


def _encode_batch(payloads: list[bytes], block: int) -> list[bytes]:
    frames: dict[int, list[tuple[int, int]]] = {}
    for i, p in enumerate(payloads):
        for k, at in enumerate(range(0, len(p), block)):
            frames.setdefault(min(block, len(p) - at), []).append((i, k))
    made: list[list[bytes]] = [[b""] * -(-len(p) // block) for p in payloads]
    for size, own in frames.items():
        x = np.frombuffer(b"".join(payloads[i][k * block : k * block + size] for i, k in own), np.uint8).reshape(-1, size)
        for (i, k), sub in zip(own, _subframes(x.astype(np.int16) - 128)):
            made[i][k] = _frame_header(k, size) + sub
    flat = [f for fs in made for f in fs]
    sizes = np.array([len(f) for f in flat])
    crc = crc16(np.frombuffer(b"".join(flat) + b"\0", np.uint8), np.cumsum(sizes) - sizes, sizes)
    out, c = [], 0
    for p, fs in zip(payloads, made):
        signed = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        body = b"".join(f + int(x).to_bytes(2, "big") for f, x in zip(fs, crc[c : c + len(fs)]))
        c += len(fs)
        out.append(_stream_header(min(block, max(16, len(p))), len(p), hashlib.md5(signed).digest()) + body)
    return out


def _in_batches(items: list[bytes], factor: int = 1) -> Iterator[list[bytes]]:
    group, n = [], 0
    for x in items:
        if group and n + len(x) * factor > AT_ONCE:
            yield group
            group, n = [], 0
        group.append(x)
        n += len(x) * factor
    if group:
        yield group


def encode(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """FLAC streams of padded payloads; byte b is stored as sample b - 128."""
    return [m for g in _in_batches(payloads) for m in _encode_batch(g, block)]


def _header(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(frame number, block size, length of the header) if a sound frame header stands at ``at``."""
    h = data[at : at + 16]
    if len(h) < 6 or h[0] != 0xFF or h[1] & 0xFE != 0xF8 or h[3] & 1:
        return None
    code, rate, first = h[2] >> 4, h[2] & 15, h[4]
    size = 1 if first < 0x80 else 8 - (first ^ 0xFF).bit_length()
    if size == 0 or size > 7 or (first >= 0x80 and size < 2) or code == 0 or rate == 15:
        return None
    number = first & (0x7F >> size if size > 1 else 0x7F)
    for b in h[5 : 4 + size]:
        number = number << 6 | b & 0x3F
    n = 4 + size
    extra = {6: 1, 7: 2}.get(code, 0)
    if code == 1:
        block = 192
    elif code <= 5:
        block = 576 << (code - 2)
    elif extra:
        block = int.from_bytes(h[n : n + extra], "big") + 1
    else:
        block = 256 << (code - 8)
    n += extra + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if n >= len(h) or crc8(h[:n]) != h[n]:
        return None
    return number, block, n + 1


def _crc16_from(crc: int, data: bytes) -> int:
    one = _crc_tables()[1]
    for b in data:
        crc = (crc << 8 & 0xFF00) ^ int(one[crc >> 8 ^ b])
    return crc


def _frames(data: bytes, careful: bool = False) -> tuple[int, bytes, list[tuple[int, int, int, int]]]:
    """(samples, md5, frames) of a stream; a frame is (start, length, header length, block size).

    Coded samples may look like a frame header.  One with another number is passed over; with
    ``careful``, so is one before which the current frame's CRC-16 does not hold.
    """
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info = 4, b""
    while True:
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        if kind & 0x7F == 0:
            info = data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind & 0x80:
            break
    packed = int.from_bytes(info[10:18], "big")
    if packed >> 41 & 7 or (packed >> 36 & 31) != 7:
        raise ValueError("only 8-bit mono streams are read")
    total = packed & ((1 << 36) - 1)
    found: list[tuple[int, int, int]] = []
    seen, crc = at, 0  # the CRC-16 of the current frame up to ``seen``
    while 0 <= at < len(data):
        h = _header(data, at)
        sound = h is not None and h[0] == len(found)
        if sound and careful and found:
            crc, seen = _crc16_from(crc, data[seen : at - 2]), max(seen, at - 2)
            sound = crc == int.from_bytes(data[at - 2 : at], "big")
        if sound:
            found.append((at, h[2], h[1]))
            seen, crc = at, 0
            at += h[2] - 1
        elif not found:
            raise ValueError("no frame where the first should start")
        at = data.find(b"\xff\xf8", at + 1)
    ends = [*(f[0] for f in found[1:]), len(data)]
    return total, info[18:34], [(s, e - s, h, b) for (s, h, b), e in zip(found, ends)]


class _Bits:
    """Reads of up to 56 bits at many bit positions of a buffer."""

    def __init__(self, buf: np.ndarray):
        self.words = np.ndarray((len(buf) - 7,), ">u8", buf, strides=(1,))
        self.buf = buf

    def window(self, pos: np.ndarray) -> np.ndarray:
        return self.words[pos >> 3].astype(np.uint64) << (pos & 7).astype(np.uint64)

    def get(self, pos: np.ndarray, n) -> np.ndarray:
        n = np.broadcast_to(np.asarray(n, dtype=np.int64), pos.shape)
        return ((self.window(pos) >> np.uint64(1)) >> (63 - n).astype(np.uint64)).astype(np.int64)

    def signed(self, pos: np.ndarray, n) -> np.ndarray:
        x = self.get(pos, n)
        return x - ((x >> (np.asarray(n) - 1) & 1) << np.asarray(n))

    def zeros(self, pos: int) -> int:
        """Zeros before the next one, however many."""
        q = 0
        while not self.buf[(pos + q) >> 3] >> (7 - ((pos + q) & 7)) & 1:
            q += 1
        return q


@lru_cache(1)
def _leading() -> np.ndarray:
    return np.array([16 - int(i).bit_length() for i in range(65536)], dtype=np.int64)


def _rice(bits: _Bits, pos: np.ndarray, count: np.ndarray, first: np.ndarray, per: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Residuals (step, frame) of frames sorted by falling ``count``."""
    out = np.zeros((int(count[0]), len(pos)), dtype=np.int64)
    live = np.searchsorted(-count, -np.arange(1, int(count[0]) + 1), side="right")
    lead = _leading()
    k = np.zeros(len(pos), dtype=np.int64)
    due = np.zeros(len(pos), dtype=np.int64)
    raw = np.full(len(pos), -1, dtype=np.int64)  # bits of a residual in an escaped partition
    nxt = first.copy()
    turns = {0, *np.unique(np.concatenate([f + np.arange(c // p + 1) * p for f, c, p in {*zip(first.tolist(), count.tolist(), per.tolist())}])).tolist()}
    one, top = np.uint64(1), np.uint64(48)
    for j, m in enumerate(live):
        p = pos[:m]
        if j in turns:
            new = np.flatnonzero(due[:m] == j)
            k[new] = bits.get(p[new], width[new])
            p[new] += width[new]
            plain = k[new] == (1 << width[new]) - 1
            raw[new] = np.where(plain, bits.get(p[new], 5), -1)
            k[new[plain]] = 0
            p[new[plain]] += 5
            due[new] = nxt[new]
            nxt[new] += per[new]
        # Views between signed and unsigned cost nothing; all values here are below 2^63.
        w = bits.words[p >> 3].astype(np.uint64) << (p & 7).view(np.uint64)
        q = lead[(w >> top).view(np.int64)]
        km = k[:m]
        q1 = q + 1
        low = (((w << q1.view(np.uint64)) >> one) >> (63 - km).view(np.uint64)).view(np.int64)
        if q.max() == 16:
            far = np.flatnonzero((q == 16) & (raw[:m] < 0))
            q[far] = [bits.zeros(int(x)) for x in p[far]]
            q1 = q + 1
            low[far] = bits.get(p[far] + q1[far], km[far])
        np.bitwise_or(q << km, low, out=out[j, :m])
        q1 += km
        plain = np.flatnonzero(raw[:m] >= 0)
        if len(plain):
            n = raw[plain]
            x = np.where(n > 0, bits.signed(p[plain], np.maximum(n, 1)), 0)
            out[j, plain] = (x << 1) ^ (x >> 63)
            q1[plain] = n
        p += q1
    return (out >> 1) ^ -(out & 1)


def _decode_frames(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Samples of frames whose subframes start at byte ``start``."""
    bits = _Bits(buf)
    pos = start * 8
    head = bits.get(pos, 8)
    kind = head >> 1 & 63
    if (head & 0x81).any() or ((kind > 1) & (kind < 8)).any() or ((kind > 12) & (kind < 32)).any():
        raise ValueError("reserved subframe or wasted bits")
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(start)
    for i in np.flatnonzero(kind == 0):
        out[i] = np.full(size[i], bits.signed(pos[i : i + 1] + 8, 8)[0])
    for i in np.flatnonzero(kind == 1):
        out[i] = buf[start[i] + 1 : start[i] + 1 + size[i]].view(np.int8).astype(np.int64)
    own = np.flatnonzero(kind >= 8)
    if not len(own):
        return out
    lpc = kind[own] >= 32
    order = np.where(lpc, kind[own] - 31, kind[own] - 8)
    own = own[np.argsort(order - size[own], kind="stable")]
    lpc = kind[own] >= 32
    order = np.where(lpc, kind[own] - 31, kind[own] - 8)
    n, p, most = size[own], pos[own] + 8, int(order.max())
    x = np.zeros((int(n.max()), len(own)), dtype=np.int64)
    for j in range(most):
        on = np.flatnonzero(order > j)
        x[j, on] = bits.signed(p[on] + 8 * j, 8)
    p = p + 8 * order
    coef = np.zeros((most, len(own)), dtype=np.int64)
    shift = np.zeros(len(own), dtype=np.int64)
    for o, c in enumerate(FIXED):
        on = np.flatnonzero(~lpc & (order == o))
        if len(on):
            coef[:o, on] = np.array(c, dtype=np.int64)[:, None]
    on = np.flatnonzero(lpc)
    if len(on):
        precision = bits.get(p[on], 4) + 1
        shift[on] = bits.get(p[on] + 4, 5)
        for j in range(int(order[on].max())):
            has = order[on] > j
            coef[j, on[has]] = bits.signed(p[on[has]] + 9 + j * precision[has], precision[has])
        p[on] += 9 + order[on] * precision
    width = 4 + bits.get(p, 2)
    parts = bits.get(p + 2, 4)
    per = n >> parts
    res = _rice(bits, p + 6, n - order, per - order, per, width)
    for o in np.unique(order):
        cols = np.flatnonzero(order == o)
        x[o:, cols] += res[: len(x) - o, cols] if len(res) >= len(x) - o else np.pad(res[:, cols], ((0, len(x) - o - len(res)), (0, 0)))
    if most:
        term = np.empty(len(own), dtype=np.int64)
        for t in range(1, len(x)):
            past = coef[0] * x[t - 1]
            for j in range(1, min(most, t)):
                np.multiply(coef[j], x[t - 1 - j], out=term)
                past += term
            past >>= shift
            if t < most:
                past *= order <= t
            x[t] += past
    for c, i in enumerate(own):
        out[i] = x[: n[c], c]
    return out


def _decode_batch(streams: list[bytes], careful: set[int] = frozenset()) -> list[list[tuple[int, int, int, bytes]]]:
    parsed = [_frames(s, i in careful) for i, s in enumerate(streams)]
    base = np.cumsum([0, *(len(s) for s in streams)])
    buf = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    flat = [(b + s, n, h, size) for b, (_, _, fs) in zip(base, parsed) for s, n, h, size in fs]
    if flat:
        start, length, head, size = (np.array(c, dtype=np.int64) for c in zip(*flat))
        kept = buf[start + length - 2].astype(np.int64) << 8 | buf[start + length - 1]
        broken = np.flatnonzero(crc16(buf, start, length - 2) != kept)
        if len(broken) and not careful:
            # Streams whose coded samples look like the next frame's header are parsed again.
            again = set(np.searchsorted(base, start[broken], side="right") - 1)
            return _decode_batch(streams, again)
        if len(broken):
            raise ValueError("a frame's checksum does not hold")
        samples = _decode_frames(buf, start + head, size)
    out, c = [], 0
    for total, md5, fs in parsed:
        blocks, offset, digest = [], 0, hashlib.md5()
        for k, (s, _, _, n) in enumerate(fs):
            x = samples[c].astype(np.int8)
            c += 1
            digest.update(x.tobytes())
            blocks.append((k, offset, s, (x.view(np.uint8) ^ 0x80).tobytes()))
            offset += n
        if offset != total or (any(md5) and digest.digest() != md5):
            raise ValueError("the stream does not hold what its header says")
        out.append(blocks)
    return out


def decode(streams: list[bytes]) -> list[list[tuple[int, int, int, bytes]]]:
    """PCM blocks of every stream: (block, sample offset, byte offset of the frame, unsigned 8-bit samples)."""
    return [b for g in _in_batches(streams, 2) for b in _decode_batch(g)]


def with_media(docs: DataFrame, text="text", block=BLOCK) -> DataFrame:
    """Replace ``text`` by ``n_bytes`` and ``media``, the FLAC stream of its padded UTF-8 bytes.

    A null or empty text gives 64 samples of byte 0.  Texts are taken one by one, so repeated
    rows agree; a very long one is coded alone.  An empty table gives an empty one.  Columns
    named n_bytes or media are replaced, all others stay.
    """

    def flac(raw: list[bytes]) -> list[pa.Array]:
        return [pa.array([len(b) for b in raw], pa.int64()), pa.array(encode([pad(b) for b in raw], block), pa.binary())]

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]
    return with_columns(docs, F.coalesce(F.col(text), F.lit("")).cast("binary"), flac, fields, (text,))


def with_blocks(rows: DataFrame, media="media") -> DataFrame:
    """Add ``blocks``: the decoded PCM blocks of the stream, in order."""

    def pcm(streams: list[bytes]) -> list[pa.Array]:
        found = [[{"block": k, "sample_offset": o, "media_offset": m, "pcm": p} for k, o, m, p in b] for b in decode(streams)]
        return [pa.array(found, pa.list_(pa.struct([("block", pa.int32()), ("sample_offset", pa.int64()), ("media_offset", pa.int64()), ("pcm", pa.binary())])))]

    return with_columns(rows, media, pcm, T.StructType.fromDDL(f"blocks {BLOCKS}").fields)


def pcm_table(rows: DataFrame, key="doc_id", media="media") -> DataFrame:
    """(key, block, sample_offset, media_offset, pcm), one row per block."""
    blocks = with_blocks(rows.select(F.col(key), F.col(media)), media)
    return blocks.select(F.col(key), F.explode("blocks").alias("b")).select(F.col(key), "b.*")


def seek(table: DataFrame, first: int, n: int) -> DataFrame:
    """The rows of a ``pcm_table`` that hold any of samples first .. first + n - 1."""
    return table.where((F.col("sample_offset") < first + n) & (F.col("sample_offset") + F.octet_length("pcm") > first))


def digests(blocks: list[bytes]) -> tuple[int, str, int, str]:
    """(bytes, sha256, crc32 of the last 64, feature) of the samples of blocks read back.

    The feature holds mean and deviation of the samples, the mean step between neighbours
    and the share of steps that cross the mean.
    """
    data = b"".join(blocks)
    x = np.frombuffer(data, np.uint8).astype(np.float64) - 128
    above = x > x.mean()
    feature = f"mean={x.mean():.4f};std={x.std():.4f};step={np.abs(np.diff(x)).mean():.4f};cross={(above[1:] != above[:-1]).mean():.4f}"
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), feature


def with_digests(rows: DataFrame, blocks="blocks") -> DataFrame:
    """Replace the PCM blocks of ``with_blocks`` by their ``digests``; columns of these names are replaced."""

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")
    def read_back(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([digests(b) for b in s], columns=["payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    made = ("payload_bytes", "payload_sha256", "tail_crc32", "feature")
    pcm = F.transform(blocks, lambda b: b["pcm"])
    found = rows.select(*others(rows, *made, blocks, "__d"), read_back(pcm).alias("__d"))
    return found.select(*others(found, "__d"), *(F.col(f"__d.{c}").alias(c) for c in made))


def op4_flac(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = with_media(docs).select("doc_id", "n_bytes", "media", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    # The streams are decoded with their checks, the PCM blocks written, and the features read from those.
    pcm = stored(with_blocks(rows).drop("media"), "pcm", compression="zstd")
    return with_digests(pcm).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
