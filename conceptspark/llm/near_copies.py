"""Near copies by the Jaccard similarity of word shingles, verified exactly.

Candidates come from the generalised pigeonhole search of ``simhash`` over fingerprints of the
shingle sets, which finds every pair within its radius.  At a similarity of 0.8 about ten bits
differ, more than a radius can be that is searched in less than a square, so MinHash bands add
the pairs beyond it: two texts of similarity 0.8 share none of 32 bands of 5 values with a
chance of 3e-6.  Texts with one shingle set are one node.  A bucket, or a fingerprint, links
its nodes to its smallest one, which is as many rows as it has nodes, and the components of
all these links say which texts may be near copies of each other.

Within such a group every node is compared with the group's smallest first.  Those that are
its near copies are settled, which in a group of copies of one text is nearly all; the others
meet each other and the settled ones in cells of two blocks, dealt out over tasks.  A block
holds about ``BLOCK_VALUES`` shingles, so no task holds a group, and a cell gives a forest of
its links, not all pairs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptspark.llm import simhash
from conceptspark.runtime import others, stored

SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 32, 5
#: Shingles whose MinHash values are worked out at once.
BLOCK = 1 << 11
#: Shingles of a block of nodes that a cell compares with another.
BLOCK_VALUES = 1 << 18
#: Copies of a group's smallest set, so that a large group is compared with it in many tasks.
SALTS = 16


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; a text of fewer words is one shingle, none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    return np.unique(np.array([digest(b" ".join(words[i : i + shingle]), 42) for i in range(n)], dtype=np.uint64))


@lru_cache(1)
def _mixers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    k = BANDS * BAND_ROWS
    return rng.integers(0, 1 << 32, k, dtype=np.uint32)[:, None], rng.integers(0, 1 << 31, k, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)


def signature(own: np.ndarray) -> tuple[int, list[int]]:
    """The set's hash, and the hash of each band of its MinHash values."""
    add, times = _mixers()
    least = np.full(BANDS * BAND_ROWS, 0xFFFFFFFF, dtype=np.uint32)
    high, low = (own >> np.uint64(32)).astype(np.uint32), own.astype(np.uint32)
    for at in range(0, len(own), BLOCK):
        x = (high[at : at + BLOCK] ^ add) * times
        x ^= x >> np.uint32(15)
        x += low[at : at + BLOCK]
        x *= times
        np.minimum(least, x.min(axis=1), out=least)
    digest = xxhash.xxh64_intdigest
    bands = [digest(least[i * BAND_ROWS : (i + 1) * BAND_ROWS].tobytes(), i) for i in range(BANDS)]
    return digest(own.tobytes(), 7), bands


def groups(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """For every set the place of the first set that it reaches over pairs of at least ``similarity``."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    label = np.arange(len(sets))
    if len(sets) < 2:
        return label
    seen, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    mark = np.zeros(len(seen), dtype=bool)
    left = np.arange(len(sets))
    while len(left):
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = left[np.minimum(sizes[left], sizes[at]) >= similarity * np.maximum(sizes[left], sizes[at])]
            if not len(near):
                continue
            own = flat[begin[at] : begin[at] + sizes[at]]
            mark[own] = True
            both = np.array([np.count_nonzero(mark[flat[begin[i] : begin[i] + sizes[i]]]) for i in near])
            mark[own] = False
            hit = near[both >= similarity * (sizes[near] + sizes[at] - both)]
            label[hit] = root
            queue.extend(hit)
            left = left[~np.isin(left, hit)]
    return label


def first_hits(sets: list[np.ndarray], others: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """For every set the place of the first of ``others`` that is near it, or -1."""
    if not sets or not others:
        return np.full(len(sets), -1)
    sizes = np.array([len(s) for s in others], dtype=np.int64)
    seen, flat = np.unique(np.concatenate(others), return_inverse=True)
    owner = np.repeat(np.arange(len(others)), sizes)
    out = []
    for s in sets:
        mark = np.zeros(len(seen), dtype=bool)
        at = np.searchsorted(seen, s)
        at = at[at < len(seen)]
        mark[at[seen[at] == s[: len(at)]]] = True
        both = np.bincount(owner[mark[flat]], minlength=len(others))
        hit = np.flatnonzero(both >= similarity * (sizes + len(s) - both))
        out.append(hit[0] if len(hit) else -1)
    return np.array(out)


def links(sets: DataFrame, similarity: float = SIMILARITY, block_values: int = BLOCK_VALUES) -> DataFrame:
    """Links (a, b) among the nodes of each group that have the same components as all pairs of ``similarity`` or more.

    ``sets`` has fp, g (the group: its smallest fp) and shingles, a sorted array of distinct hashes.
    """
    def salted(rows):
        return rows.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))

    def every_salt(rows):
        return rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))

    least = every_salt(sets.where("fp = g").select("g", F.col("shingles").alias("least")))
    n, m, both = F.size("shingles"), F.size("least"), F.size(F.array_intersect("shingles", "least"))
    judged = salted(sets.where("fp <> g")).join(least, ["g", "salt"])
    judged = stored(judged.select("fp", "g", n.alias("n"), m.alias("m"), (both >= similarity * (n + m - both)).alias("settled")), "settled")
    found = judged.where("settled").select(F.col("g").alias("a"), F.col("fp").alias("b"))
    if not judged.where("not settled").limit(1).count():
        return found

    # One narrow row for every group with open nodes; the sets meet it by group and salt, never by group alone.
    blocks = judged.groupBy("g").agg(
        F.ceil((F.sum(F.when(F.col("settled"), F.col("n")).otherwise(0)) + F.max("m")) / block_values).cast("int").alias("n_settled"),
        F.ceil(F.sum(F.when(F.col("settled"), 0).otherwise(F.col("n"))) / block_values).cast("int").alias("n_open"))
    parts = salted(sets).join(every_salt(blocks.where("n_open > 0")), ["g", "salt"])
    parts = parts.join(judged.select("fp", "settled"), "fp", "left").withColumn("settled", F.coalesce("settled", F.lit(True)))
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("settled"), F.greatest("n_settled", F.lit(1))).otherwise(F.greatest("n_open", F.lit(1)))).cast("int")
    every = F.sequence(F.lit(0), F.greatest("n_open", F.lit(1)) - 1)
    cell = lambda i, j, kind: F.struct(i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"))
    with_open = F.transform(every, lambda j: cell(F.least("own", j), F.greatest("own", j), 0))
    with_settled = F.transform(F.sequence(F.lit(0), F.greatest("n_settled", F.lit(1)) - 1), lambda j: cell(F.col("own"), j, 1))
    cells = F.when(F.col("settled"), F.transform(every, lambda i: cell(i, F.col("own"), 1))).otherwise(F.concat(with_open, with_settled))
    dealt = parts.withColumn("own", own).select("fp", "g", "shingles", "settled", F.explode(cells).alias("cell"))
    dealt = dealt.select("g", "cell.i", "cell.j", "cell.kind", "settled", "fp", "shingles").repartition("g", "i", "j", "kind").sortWithinPartitions("g", "i", "j", "kind", "fp")

    def compare(held):
        rows = [r for x in held for r in x.itertuples(index=False)]
        sets_of = lambda some: [np.asarray(r.shingles).view(np.uint64) for r in some]
        if rows[0].kind == 0:
            label = groups(sets_of(rows), similarity)
            pairs = [(rows[k].fp, r.fp) for r, k in zip(rows, label) if rows[k].fp != r.fp]
        else:
            mine, theirs = [r for r in rows if not r.settled], [r for r in rows if r.settled]
            hits = first_hits(sets_of(mine), sets_of(theirs), similarity)
            pairs = [(theirs[h].fp, r.fp) for r, h in zip(mine, hits) if h >= 0]
        return pd.DataFrame(pairs, columns=["a", "b"]).astype("int64")

    def meet(batches):
        held, last = [], None
        for pdf in batches:
            for key, part in pdf.groupby(["g", "i", "j", "kind"], sort=True):
                if held and key != last:
                    yield compare(held)
                    held = []
                held.append(part)
                last = key
        if held:
            yield compare(held)

    return found.unionByName(dealt.mapInPandas(meet, "a long, b long"))


def candidates(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) whose components hold all pairs of nodes (fp, sim, bands) that may be near: of
    fingerprints within the radius of the pigeonhole search, or with a band in common."""
    alike = stored(nodes.groupBy("sim").agg(F.min("fp").alias("least")), "alike")
    same = nodes.join(alike, "sim").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    near = simhash.links(alike.select(F.col("sim").alias("fp")))
    near = near.join(alike.select(F.col("sim").alias("a"), F.col("least").alias("x")), "a").join(alike.select(F.col("sim").alias("b"), F.col("least").alias("y")), "b")
    inside = nodes.select("fp", F.explode("bands").alias("band"))
    least = inside.groupBy("band").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("band", "a")
    banded = inside.join(least, "band").where("fp <> a").select("a", F.col("fp").alias("b"))
    return same.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b"))).unionByName(banded).distinct()


def first_of_each(docs: DataFrame, key="doc_id", text="text", shingle=SHINGLE, similarity=SIMILARITY, block_values=BLOCK_VALUES) -> DataFrame:
    """One document of every group of near copies: the row with the group's smallest key.

    A group is what is reachable over pairs with a Jaccard similarity of ``similarity`` or
    more.  Null and empty texts are one group.  Null keys come last, of equal keys the row with
    the smallest hash comes first.  Rows that repeat key and text are one row.  An empty table
    gives an empty one.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")

    @F.pandas_udf("fp long, sim long, bands array<long>")
    def signed(s: pd.Series) -> pd.DataFrame:
        sets = [shingles(b, shingle) for b in s]
        found = [signature(own) for own in sets]
        fps = pd.Series([f for f, _ in found], dtype="uint64").astype("int64")
        sims = pd.Series([simhash.majority(own) for own in sets], dtype="uint64").astype("int64")
        return pd.DataFrame({"fp": fps, "sim": sims, "bands": [np.array(b, dtype=np.uint64).view(np.int64) for _, b in found]})

    @F.pandas_udf("array<long>")
    def shingled(s: pd.Series) -> pd.Series:
        return pd.Series([shingles(b, shingle).view(np.int64) for b in s])

    # One hash of key and text, so that a row is found again without its text.
    row = F.xxhash64(F.col(key), F.col(text))
    first = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), row.alias("row"))
    rows = docs.select(first.alias("first"), signed(raw).alias("s"))
    rows = stored(rows.select("first", "s.fp", "s.sim", "s.bands"), "signatures")
    nodes = stored(rows.groupBy("fp").agg(F.min("first").alias("first"), F.min("sim").alias("sim"), F.min("bands").alias("bands")), "nodes")
    maybe = simhash.components(candidates(nodes)).select(F.col("node").alias("fp"), F.col("component").alias("g"))

    one = W.partitionBy("__row").orderBy("__row")
    asked = nodes.join(maybe, "fp").select("fp", "g", F.col("first.row").alias("__row"))
    texts = docs.select(row.alias("__row"), raw.alias("__raw")).join(asked, "__row").withColumn("__n", F.row_number().over(one)).where("__n = 1")
    sets = stored(texts.select("fp", "g", shingled("__raw").alias("shingles")), "shingles")
    copies = simhash.components(links(sets, similarity, block_values))
    known = nodes.select("fp", "first").join(copies, F.col("fp") == F.col("node"), "left").select(F.coalesce("component", "fp").alias("component"), "first")
    keep = stored(known.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias("__row")), "kept")
    # All columns travel as one, so that none can clash with those of the work.
    found = docs.select(F.struct(*others(docs)).alias("__doc"), row.alias("__row")).join(keep, "__row", "left_semi")
    return found.withColumn("__n", F.row_number().over(one)).where("__n = 1").select("__doc.*")
