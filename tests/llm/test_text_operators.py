"""Brute force, round trips and awkward tables for the operators on documents."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from conceptspark.llm import bpe, flac, langid, licenses, mixing, pfor, quality, simhash
from tests.llm.util import SCHEMA, awkward, awkward_docs, empty_docs


def test_every_operator_takes_empty_tables(spark):
    docs = empty_docs(spark)
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.first_of_each(docs).count() == 0
    assert bpe.encode(docs).count() == 0
    assert mixing.mix(docs).count() == 0
    assert pfor.read(pfor.write(docs)).count() == 0
    assert licenses.scan(docs).count() == 0
    assert langid.fit(docs) == {} and langid.predict(docs, {}).count() == 0
    labels = docs.selectExpr("doc_id as key", "rank as label")
    assert quality.classify(docs, labels).count() == 0
    assert flac.with_digests(flac.with_blocks(flac.with_media(docs))).count() == 0


# SimHash


def _fp(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    h = [xxhash.xxh64(b" ".join(words[i : i + 4]), seed=42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(fps, radius=4):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_simhash_awkward(spark):
    rows = awkward()
    got = simhash.near_duplicates(awkward_docs(spark)).collect()
    assert len(got) == len(rows)
    want = {r[0]: _fp(r[1]) for r in rows}
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in got} == want
    comp = {r["doc_id"]: r["component_id"] for r in got}
    assert comp[2] == 1 and comp[3] == comp[4] == comp[5] == 3 and comp[8] == 8
    kept = simhash.first_of_each(awkward_docs(spark))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == sorted({c for c in comp.values() if c})
    assert kept.columns == awkward_docs(spark).columns


def _fingerprints(seed, n=600):
    rng = np.random.default_rng(seed)
    near = rng.integers(0, 1 << 63, 20).astype(np.uint64)
    out = list(rng.integers(0, 1 << 63, n // 3).astype(np.uint64))
    for _ in range(n - len(out)):
        x = near[rng.integers(0, len(near))]
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            x ^= np.uint64(1) << np.uint64(b)
        out.append(x)
    return sorted({int(x) for x in out})


@pytest.mark.parametrize("seed,partitions", [(0, 3), (1, 2), (2, 4), (3, 5)])
def test_links_keep_all_components(spark, seed, partitions):
    """Dense clusters, uncorrelated rest; any partition count finds every component."""
    fps = _fingerprints(seed, 300 if partitions == 2 else 600)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.links(nodes, 4, partitions)
    for r in edges.collect():
        assert bin((r["a"] ^ r["b"]) % (1 << 64)).count("1") <= 4
    found = {r["node"] % (1 << 64): r["component"] for r in simhash.components(edges).collect()}
    label = _components(fps)
    groups = {}
    for x, g in zip(fps, label):
        groups.setdefault(g, []).append(x)
    for g in groups.values():
        if len(g) == 1:
            assert g[0] not in found
        else:
            assert len({found[x] for x in g}) == 1
    assert len({found[g[0]] for g in groups.values() if len(g) > 1}) == sum(len(g) > 1 for g in groups.values())


def test_thresholds_add_up():
    for m in (1, 2, 3, 4, 5):
        costs = [[0.0, *(10.0 ** (t + i % 2) for t in range(5))] for i in range(m)]
        assert sum(simhash.allocate(costs, 4)[1]) == 4 - m + 1
    assert len(simhash.plan(np.array(_fingerprints(0), dtype=np.uint64), 10**6)[0]) == 3 and len(simhash.plan(np.array(_fingerprints(0), dtype=np.uint64), 10**10)[0]) == 2
    groups = simhash.group_bits(np.array(_fingerprints(0), dtype=np.uint64))
    assert sorted(b for g in groups for b in g) == list(range(64))


def test_long_chains_settle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 300)], "a long, b long")
    found = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    assert {found[i] for i in range(101)} == {0} and found[500] == found[300] == 300


# BPE


def _digests(ids, text):
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_bpe_stitching_is_exact(spark):
    rng = random.Random(5)
    enc = bpe.encoder(bpe.RANKS, bpe.PATTERN)
    alphabet = ["'ll", "'s", "'re", " ", "  ", "   \n", "\n", "abc", "Éé", "12", "!!", "…", "日本", "\t", "x", "\x1c", "\x1f\x1d", " \xa0", " ", "🙂"]
    texts = [None, "", "a" * 300, " " * 300, "word " * 80] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 300))) for _ in range(200)]
    texts += texts[10:14]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode(docs, chunk=64, overlap=16, spread=100).collect():
        t = texts[r["doc_id"]] or ""
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == _digests(enc.encode_ordinary(t), t)
    for t in texts:
        for chunk, overlap in ((64, 16), (16, 16), (200, 8)):
            assert bpe.encode_text(t or "", enc, chunk=chunk, overlap=overlap) == enc.encode_ordinary(t or ""), (t, chunk)


def test_bpe_awkward(spark):
    enc = bpe.encoder(bpe.RANKS, bpe.PATTERN)
    got = bpe.encode(awkward_docs(spark)).collect()
    assert len(got) == len(awkward())
    want = {r[0]: _digests(enc.encode_ordinary(r[1] or ""), r[1] or "") for r in awkward()}
    for r in got:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want[r["doc_id"]]


# Token files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=3000), st.integers(0, 3000), st.integers(0, 3000))
def test_pfor_round_trip(ids, a, b):
    x = np.array(ids, dtype=np.uint32)
    data = pfor.encode_segment(x)
    assert (pfor.decode_segment(data) == x).all() and len(pfor.decode_segment(data)) == len(x)
    lo, hi = min(a, b), max(a, b)
    assert list(pfor.decode_segment(data, lo, hi)) == ids[lo:hi]


@lru_cache(1)
def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


PIECES = ["'s", "'ll", "'re", "'", " ", "  ", "a", "É", "1", "²", "_", " _", "\n", "\t", "日", "!", "\x1c", "\x85", " ", "½", "Ⅷ", "\xa0", "ß", "١", "ñ", "…", "я", "한", "🙂", "<|endoftext|>"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=40).map("".join), min_size=1, max_size=20))
def test_remembered_pieces_encode_as_the_library_does(texts):
    plain = _library()
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert pfor.encoder(pfor.TOKENIZER)(texts) == want


def test_token_files_awkward(spark):
    tok = _library()
    segments = pfor.write(awkward_docs(spark), segment_ids=64, partitions=3)
    got = sorted(pfor.read(segments).collect(), key=lambda r: r["start"])
    rows = sorted(awkward(), key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for r, (key, text, *_) in zip(got, rows, strict=True):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        assert r["key"] == (None if key is None else str(key)) and r["start"] == at and r["n_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)
    assert segments.count() > 3


# Mixing


def _targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**{s: 3.0 * sizes[s] for s in capped}, **share}
        for s in over:
            capped[s] = True
            left -= 3 * sizes[s]


def test_mix_awkward(spark):
    docs = awkward_docs(spark)
    got = mixing.mix(docs, rows_per_range=1).collect()
    words = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in awkward()}
    assert len(got) == len(awkward()) and all(r["size"] == words[r["doc_id"]] for r in got)
    sizes = {}
    for r in awkward():
        sizes[r[3]] = sizes.get(r[3], 0) + words[r[0]]
    want = _targets(sizes)
    taken = {}
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= 1
    again = mixing.mix(docs.repartition(7), rows_per_range=1).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


@pytest.mark.parametrize("seed", range(4))
def test_mix_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 10, 100, 5000]) for i in range(9)} | {None: 50}
    rows = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    want = _targets(sizes)
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_repeated_documents_come_whole(spark):
    docs = awkward_docs(spark)
    out = mixing.repeat_documents(docs)
    texts = {r[1] for r in awkward()}
    assert out.columns == docs.columns and {r["text"] for r in out.collect()} <= texts


# Licences


def _scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    starts, found = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        hits = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        starts += hits
        found |= {label} if hits else set()
    more = set()
    for label, notice, key in licenses.TEMPLATES:
        notice, key = notice.split(), key.split()
        at = next(i for i in range(len(notice)) if notice[i : i + len(key)] == key)
        for i in range(len(words)):
            if words[i : i + len(key)] == key:
                same = sum(0 <= i - at + j < len(words) and words[i - at + j] == w for j, w in enumerate(notice))
                more |= {label} if same / len(notice) >= licenses.MIN_COVERAGE else set()
    base = sorted(found)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *more}))


def test_license_scan(spark):
    texts = [
        "Licensed under CC BY-NC 4.0.", "cc\tBY cc by x", "accby", "CC-BY", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "mit der license im Wald", "é general PUBLIC license",
        "This work is licensed under the GNU General Public License, version 3. All rights reserved. ALL RIGHTS RESERVED", "all rights\x00reserved", "all rightsreserved", "GNU lesser general public license", "İ all rights reserved",
        "general public", "license " * 500, "x " * 9 + licenses.NOTICES[1][2] + " y", "// " + licenses.NOTICES[4][2].replace("\n", "\n// "), licenses.NOTICES[0][2][60:], "general " * 300 + "general public license", "the mit license the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software",
    ]
    docs = awkward() + [(100 + i, t, *[None] * 8) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, SCHEMA)
    got = licenses.scan(frame).collect()
    assert len(got) == len(docs)
    want = {d[0]: _scan(d[1]) for d in docs}
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) == want[r["doc_id"]], r["doc_id"]
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    by = {r["doc_id"]: r for r in got}
    whole = {texts.index(t): x for t, x in zip(texts, texts) if "merge, publish" in t}
    assert all(by[100 + i]["labels"] == "mit" and by[100 + i]["score"] == 1.0 for i in whole) and whole
    plan = licenses.scan(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Language


def test_language_awkward(spark):
    docs = awkward_docs(spark)
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert {got[i]["lang_pred"] for i in (3, 4, 5, 7)} == {"und"} and {got[i]["score"] for i in (3, 4, 5, 7)} == {0.0}
    assert got[1]["lang_pred"] == "en" and got[6]["lang_pred"] == "de" and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[1]["n_words"] == 9


def test_language_held_out(spark, sf):
    got = langid.op10_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95


def test_bundles_by_definition():
    v = langid.letter_vectors()
    got, lettered = langid.bundles(["ab", "1"])
    s = [0, 1, 2, 0]
    want = sum(np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in zip(s, s[1:], s[2:]))
    np.testing.assert_array_equal(got[0], want)
    assert list(lettered) == [True, False]


def _bundle(text):
    """The definition, letter by letter."""
    v, s = langid.letter_vectors().astype(np.int64), [0]
    for c in text:
        k = langid._symbol(ord(c))
        if k or s[-1]:
            s.append(k)
    if s[-1]:
        s.append(0)
    total = np.zeros(langid.DIM, dtype=np.int64)
    for (a, b, c), n in Counter(zip(s, s[1:], s[2:])).items():
        total += n * np.roll(v[a], 2) * np.roll(v[b], 1) * v[c]
    return total


def test_bundles_in_parts(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc é  .1日🙂") for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    want = np.array([_bundle(t) for t in texts])
    for chars, rows, columns in ((400_000, 1000, 4096), (7, 3, 5), (40, 1000, 4096)):
        monkeypatch.setattr(langid, "CHARS_AT_ONCE", chars)
        monkeypatch.setattr(langid, "ROWS_AT_ONCE", rows)
        monkeypatch.setattr(langid, "COLUMNS_AT_ONCE", columns)
        got, lettered = langid.bundles(texts)
        np.testing.assert_array_equal(got, want)
        assert list(lettered) == [any(c.isalpha() for c in t) for t in texts]


def test_many_short_texts_are_bounded():
    import tracemalloc

    rng = random.Random(1)
    letters = [chr(c) for c in range(0x61, 0x2AF) if chr(c).isalpha()]
    texts = ["".join(rng.choice(letters) for _ in range(38)) for _ in range(3000)]
    tracemalloc.start()
    langid.bundles(texts)
    assert tracemalloc.get_traced_memory()[1] < 300_000_000
    tracemalloc.stop()


def test_language_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    fold = docs["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5)
    vectors = np.array([_bundle(t) for t in docs["text"]], dtype=np.float64)
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    names = sorted(docs["lang"].dropna().unique())
    protos = np.array([unit[((fold != 0) & (docs["lang"] == n)).to_numpy()].sum(axis=0) for n in names])
    cos = unit @ (protos / np.linalg.norm(protos, axis=1, keepdims=True)).T
    got = {r["doc_id"]: r for r in langid.op10_language_id(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, t, f, c in zip(docs["doc_id"], docs["text"], fold, cos):
        letters = any(x.isalpha() for x in t)
        assert got[i]["held_out"] == (f == 0)
        assert got[i]["lang_pred"] == (names[int(c.argmax())] if letters else "und")
        assert got[i]["score"] == pytest.approx(float(np.clip(c.max(), 0, 1)) if letters else 0.0, abs=1e-5)


# Quality


def test_quality_labels_by_majority(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (1 + i % 7), *[None] * 8) for i in range(40)], SCHEMA)
    rows = [(i, i % 2) for i in range(40)] + [(0, 0), (0, 1), (1, 0), (2, None), (3, 7)]
    labels = spark.createDataFrame(rows, "key long, label int")
    plain = spark.createDataFrame([(i, i % 2) for i in range(40) if i != 1], "key long, label int")
    of = lambda x: {r["key"]: r["score"] for r in quality.classify(docs, x).collect()}
    assert of(labels) == pytest.approx(of(plain))


def test_quality_awkward(spark):
    docs = awkward_docs(spark)
    labels = spark.createDataFrame([(1, 1), (2, 1), (7, 0), (7, 0), (8, 0), (6, None), (3, 1), (3, 0)], "key long, label int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(awkward()) and all(0 <= r["score"] <= 1 for r in got)
    one_kind = quality.classify(docs, labels.where("label = 1")).collect()
    assert {r["score"] for r in one_kind} == {0.5}


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op3_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 80 and np.mean([r["quality"] == r["predicted"] for r in got]) > 0.95


def test_pooling_is_monotone():
    rng = np.random.default_rng(0)
    n = rng.integers(1, 9, 50)
    k = np.minimum(rng.integers(0, 9, 50), n)
    knots, values = quality.pool(np.arange(50.0), k.astype(float), n.astype(float))
    assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all()


# FLAC


def test_flac_awkward(spark):
    got = flac.with_digests(flac.with_blocks(flac.with_media(awkward_docs(spark)))).collect()
    assert len(got) == len(awkward())
    want = {r[0]: (r[1] or "").encode() for r in awkward()}
    for r in got:
        raw = want[r["doc_id"]]
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        x = [b - 128 for b in p]
        mean = sum(x) / len(x)
        std = (sum((v - mean) ** 2 for v in x) / len(x)) ** 0.5
        step = sum(abs(b - a) for a, b in zip(x, x[1:])) / (len(x) - 1)
        cross = sum((a > mean) != (b > mean) for a, b in zip(x, x[1:])) / (len(x) - 1)
        feature = dict(f.split("=") for f in r["feature"].split(";"))
        assert [float(feature[k]) for k in ("mean", "std", "step", "cross")] == pytest.approx([mean, std, step, cross], abs=6e-5)
    table = flac.pcm_table(flac.with_media(awkward_docs(spark).where("doc_id = 8")))
    rows = flac.seek(table, 5000, 100).collect()
    at = {r["sample_offset"]: r["pcm"] for r in rows}
    assert list(at) == [4096] and at[4096][5000 - 4096 :][:100] == want[8][5000:5100]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=5000), max_size=6), st.sampled_from([64, 256, 1024]))
def test_flac_round_trip(raws, block):
    p = [flac.pad(r) for r in raws]
    assert [b"".join(b[3] for b in s) for s in flac.decode(flac.encode(p, block))] == p


def test_flac_extremes_and_damage():
    rng = np.random.default_rng(0)
    raws = [b"\0\xff" * 3000, b"x" * 200000, rng.integers(0, 256, 9000, dtype=np.uint8).tobytes(), (b"a" * 63 + b"\xff") * 50, bytes(range(256)) * 30]
    p = [flac.pad(r) for r in raws]
    media = flac.encode(p)
    assert [b"".join(b[3] for b in s) for s in flac.decode(media)] == p
    for at in (60, 500, len(media[2]) - 1):
        bad = bytearray(media[2])
        bad[at] ^= 1
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])


def test_flac_constant_and_verbatim():
    def frame(sub, n, number=0):
        f = flac._frame_header(number, n) + sub
        return f + int(flac.crc16(np.frombuffer(f + b"\0", np.uint8), np.array([0]), np.array([len(f)]))[0]).to_bytes(2, "big")

    samples = bytes(range(32))
    body = frame(b"\x00\x05", 64) + frame(b"\x02" + samples, 32, 1)
    pcm = b"\x05" * 64 + samples
    media = flac._stream_header(64, 96, hashlib.md5(pcm).digest()) + body
    blocks = flac.decode([media])[0]
    assert b"".join(b[3] for b in blocks) == bytes(x ^ 0x80 for x in pcm) and [b[1] for b in blocks] == [0, 64]


def _frame(sub, n, number):
    f = flac._frame_header(number, n) + sub
    return f + int(flac.crc16(np.frombuffer(f + b"\0", np.uint8), np.array([0]), np.array([len(f)]))[0]).to_bytes(2, "big")


@pytest.mark.parametrize("looks_like", [7, 1])
def test_flac_passes_over_what_looks_like_a_header(looks_like):
    samples = (flac._frame_header(looks_like, 64) + bytes(64))[:64]  # verbatim samples that begin like a frame
    media = flac._stream_header(64, 128, bytes(16)) + _frame(b"\x02" + samples, 64, 0) + _frame(b"\x00\x05", 64, 1)
    other = flac.encode([flac.pad(b"another stream of the batch" * 99)])[0]
    got = flac.decode([other, media, other])
    assert b"".join(b[3] for b in got[1]) == bytes(x ^ 0x80 for x in samples + b"\x05" * 64)
    assert b"".join(b[3] for b in got[2]) == flac.pad(b"another stream of the batch" * 99)


def test_flac_escaped_partitions():
    """Two Rice partitions: one escaped with 5-bit residuals, one escaped with none; and a coded one behind."""
    rng = random.Random(2)
    values = [rng.randrange(-16, 16) for _ in range(16)]
    bits = "0" + f"{8:06b}" + "0" + "00" + f"{2:04b}"  # fixed predictor of order 0, four partitions
    bits += "1111" + f"{5:05b}" + "".join(f"{v & 31:05b}" for v in values)
    bits += "1111" + f"{0:05b}"
    rest = [3, -2, 0, 1] * 8
    for part in (rest[:16], rest[16:]):
        bits += f"{1:04b}"
        for v in part:
            u = 2 * v if v >= 0 else -2 * v - 1
            bits += "0" * (u >> 1) + "1" + str(u & 1)
    bits += "0" * (-len(bits) % 8)
    sub = int(bits, 2).to_bytes(len(bits) // 8, "big")
    media = flac._stream_header(64, 64, bytes(16)) + _frame(sub, 64, 0)
    want = [*values, *[0] * 16, *rest]
    assert b"".join(b[3] for b in flac.decode([media])[0]) == bytes((v & 0xFF) ^ 0x80 for v in want)
