"""SimHash near-duplicates with the generalised pigeonhole principle.

64-bit fingerprints link where they differ in at most ``radius`` bits.  The bits are
grouped into partitions; with thresholds t_i (each -1 or more) that add up to
``radius - partitions + 1``, any linked pair lies within t_i in some partition i.  Bits that
agree more often than chance stand in one partition, and a dynamic programme chooses the
thresholds of least estimated candidates and probes.  The estimates come from a bounded
sample; they steer cost only, any choice finds every link.

Equal fingerprints are one node.  A node is indexed under its partition values and probes
all values within t_i; rows meet by sorting on the value, in streams, so that no group is
held as a whole list of pairs.  Inside a group of more than ``SMALL_RUN`` rows a spanning
forest of the true links is returned instead of all of them, which keeps components and
never makes the square of a group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptspark.runtime import others, stored

RADIUS = 4
#: Partition counts to choose from by estimated cost: 3 up to some 10^7 distinct fingerprints, 2 beyond.
PARTITIONS = (2, 3)
SHINGLE = 4
SAMPLE = 4096
SMALL_RUN = 24
BLOCK = 1 << 14


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is 1 where over half of the shingles' hashes have it; 0 without words.

    ``bytes.lower`` changes A-Z alone and ``bytes.split`` parts at 0x20 and 0x09-0x0D.
    """
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(b" ".join(words[i : i + shingle]), 42) for i in range(n)], dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """A bit is 1 where over half of the hashes have it; 0 without hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), BLOCK):
        ones += np.unpackbits(h[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text="text", shingle=SHINGLE) -> DataFrame:
    """Add the 64-bit fingerprint as a long in column ``fp`` (replaced), without ``text``.

    Null and empty texts have fingerprint 0.
    """

    @F.pandas_udf("long")
    def fp(s: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(b or b"", shingle) for b in s], dtype="uint64").astype("int64")

    return docs.select(*others(docs, text, "fp"), fp(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("fp"))


def group_bits(sample: np.ndarray, partitions: int = 3) -> list[list[int]]:
    """Partition the 64 bits: each partition grows by the bit most correlated with it."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    if len(bits) < 2:
        return [list(map(int, x)) for x in np.array_split(np.arange(64), partitions)]
    bits -= bits.mean(axis=0)
    norm = np.sqrt((bits * bits).sum(axis=0))
    corr = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-9)
    np.fill_diagonal(corr, 0)
    free, out = set(range(64)), []
    for i in range(partitions):
        size = 64 // partitions + (i < 64 % partitions)
        rest = sorted(free)
        first = rest[int(corr[np.ix_(rest, rest)].sum(axis=1).argmax())]
        group = [first]
        free.discard(first)
        while len(group) < size:
            rest = sorted(free)
            nxt = rest[int(corr[np.ix_(rest, group)].sum(axis=1).argmax())]
            group.append(nxt)
            free.discard(nxt)
        out.append(sorted(group))
    return out


def allocate(costs: list[list[float]], radius: int = RADIUS) -> tuple[float, list[int]]:
    """Least total cost and its thresholds; ``costs[i][t + 1]`` is that of threshold t in partition i."""
    m = len(costs)
    total = radius - m + 1
    best = {0: (0.0, [])}  # sum of (t + 1) so far
    for c in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, chosen) in best.items():
            for t in range(-1, len(c) - 1):
                k = s + t + 1
                if k <= total + m and (k not in step or cost + c[t + 1] < step[k][0]):
                    step[k] = (cost + c[t + 1], [*chosen, t])
        best = step
    return best[total + m]


def plan(sample: np.ndarray, n: int, partitions=PARTITIONS, radius: int = RADIUS) -> tuple[list[list[int]], list[int]]:
    """Bit groups and thresholds for ``n`` distinct fingerprints, judged by a sample of them."""
    counts = (partitions,) if isinstance(partitions, int) else partitions
    # How many partitions is judged by even bits: clusters of near copies cost the same under any.
    m = min(counts, key=lambda k: (allocate(_costs(sample[:0], n, k, radius)[1], radius)[0], k))
    groups, costs = _costs(sample, n, m, radius)
    return groups, allocate(costs, radius)[1]


def _costs(sample: np.ndarray, n: int, partitions: int, radius: int) -> tuple[list[list[int]], list[list[float]]]:
    groups = group_bits(sample, partitions)
    rng = np.random.default_rng(0)
    costs = []
    for g in groups:
        mask = np.uint64(sum(1 << b for b in g))
        near = np.zeros(radius + 1)
        pairs = 0
        if len(sample) > 1:
            a, b = rng.integers(0, len(sample), 1_000_000), rng.integers(0, len(sample), 1_000_000)
            d = np.bitwise_count((sample[a] ^ sample[b]) & mask)[a != b]
            pairs = len(d)
            near = np.cumsum(np.bincount(d, minlength=65)[: radius + 1]).astype(float)
        balls = np.cumsum([_choose(len(g), t) for t in range(radius + 1)]).astype(float)
        # At least what even bits would give: a sample holds few pairs as near as that.
        expected = np.maximum(near / max(pairs, 1), balls / 2.0 ** len(g)) * n * n / 2
        costs.append([0.0, *(expected + n * balls)])
    return groups, costs


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def _flips(group: list[int], t: int) -> list[int]:
    masks = [sum(1 << b for b in c) for r in range(t + 1) for c in combinations(group, r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(fp: np.ndarray, radius: int):
    """Edges of a spanning forest of the links among ``fp`` (distinct)."""
    left = np.arange(len(fp))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = np.bitwise_count(fp[left] ^ fp[at]) <= radius
            for x in left[hit]:
                yield at, x
            queue.extend(left[hit])
            left = left[~hit]
        if len(left) == 0:
            return


def _links(part: np.ndarray, value: np.ndarray, probe: np.ndarray, fp: np.ndarray, radius: int):
    """Links inside runs of equal (part, value); rows are sorted by them, indexed rows first."""
    new = np.concatenate(([True], (part[1:] != part[:-1]) | (value[1:] != value[:-1])))
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(part)))
    a, b = [], []
    run = np.repeat(np.arange(len(begin)), size)
    small = (size <= SMALL_RUN)[run]
    for lag in range(1, min(SMALL_RUN, len(part) - 1) + 1):
        i = np.flatnonzero(small[:-lag] & ~probe[:-lag] & (run[:-lag] == run[lag:]))
        if not len(i):
            break
        i = i[(fp[i] != fp[i + lag]) & (np.bitwise_count(fp[i] ^ fp[i + lag]) <= radius)]
        a.append(fp[i])
        b.append(fp[i + lag])
    for r in np.flatnonzero(size > SMALL_RUN):
        s = slice(begin[r], begin[r] + size[r])
        if probe[s].all():
            continue
        own = np.unique(fp[s])
        pairs = np.array(list(_forest(own, radius)), dtype=np.int64).reshape(-1, 2)
        a.append(own[pairs[:, 0]])
        b.append(own[pairs[:, 1]])
    if not a:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(a), np.concatenate(b)


def links(nodes: DataFrame, radius=RADIUS, partitions=PARTITIONS, sample=SAMPLE) -> DataFrame:
    """Links (a, b) among distinct fingerprints: all of them, or a forest with the same components.

    ``nodes`` has one column ``fp``.
    """
    n = max(1, nodes.count())  # probes have a cost in an empty table too
    share = min(1.0, 1.5 * sample / max(1, n))
    some = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(1_000_003)) <= int(1_000_003 * share))
    rows = some.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()
    groups, thresholds = plan(np.array([r["fp"] for r in rows], dtype=np.int64).view(np.uint64), n, partitions, radius)
    sides = []
    for i, (g, t) in enumerate(zip(groups, thresholds)):
        if t < 0:
            continue
        mask = sum(1 << b for b in g)
        mask = mask - (1 << 64) if mask >> 63 else mask
        flips = _flips(g, t)
        value = F.col("fp").bitwiseAND(F.lit(mask).cast("long"))
        flip = F.explode(F.array(*[F.lit(x).cast("long") for x in flips])) if len(flips) > 1 else F.lit(0).cast("long")
        own = nodes.select("fp", F.lit(i).cast("byte").alias("part"), value.alias("own"), flip.alias("flip"))
        sides.append(own.select("part", F.col("own").bitwiseXOR(F.col("flip")).alias("value"), (F.col("flip") != 0).alias("probe"), "fp"))
    rows = sides[0]
    for s in sides[1:]:
        rows = rows.unionByName(s)
    rows = rows.repartition(F.col("part"), F.col("value")).sortWithinPartitions("part", "value", "probe", "fp")

    def meet(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf])
            last = (pdf["part"] == pdf["part"].iloc[-1]) & (pdf["value"] == pdf["value"].iloc[-1])
            rest = pdf[last]
            yield found(pdf[~last])
        if rest is not None:
            yield found(rest)

    def found(pdf):
        if not len(pdf):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        a, b = _links(*(pdf[c].to_numpy() for c in ("part", "value", "probe")), pdf["fp"].to_numpy().view(np.uint64), radius)
        a, b = a.view(np.int64), b.view(np.int64)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return rows.mapInPandas(meet, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    Rounds of large-star and small-star: each writes its edges to the shared folder, and
    stops when every edge points at its component's smallest node.
    """
    star = stored(edges.select("a", "b"), "links")
    while True:
        # Large star: each node links its larger neighbours to its smallest.
        both = star.select(F.col("a").alias("u"), F.col("b").alias("v")).union(star.select(F.col("b"), F.col("a")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: each node links its smaller neighbours, and itself, to the smallest of them.
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a <> b").distinct()
        new = stored(small, "links")
        # Done when each node hangs on one root and no root hangs on another.
        roots = new.select(F.col("a").alias("b")).distinct().join(new.select("b"), "b", "left_semi").limit(1).count()
        more = new.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        star = new
        if not roots and not more:
            return star.select(F.col("b").alias("node"), F.col("a").alias("component")).union(star.select(F.col("a"), F.col("a"))).distinct()


def near_duplicates(docs: DataFrame, key="doc_id", text="text", radius=RADIUS, partitions=PARTITIONS, shingle=SHINGLE) -> DataFrame:
    """(key, fp, component_id) for every row: the smallest key reachable over links.

    Texts without words have fingerprint 0 and link like any other.  Rows that repeat come
    back as often.  Null keys take part; a component of null keys alone has a null id.
    """
    rows = stored(fingerprints(docs.select(F.col(key), F.col(text)), text, shingle), "fingerprints")
    own = rows.groupBy("fp").agg(F.min(key).alias("least"))
    own = stored(own, "nodes")
    linked = components(links(own.select("fp"), radius, partitions))
    known = own.join(linked, own["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(ids, "component").select("fp", "component_id")
    return rows.join(known, "fp").select(F.col(key), "fp", "component_id")


def first_of_each(docs: DataFrame, key="doc_id", text="text", **options) -> DataFrame:
    """One document of every component: a row with the component's smallest key.

    Among rows that repeat that key one is kept, the smallest text.
    """
    found = near_duplicates(docs, key, text, **options)
    keep = found.where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("__keep")).distinct()
    kept = docs.join(keep, F.col(key).eqNullSafe(F.col("__keep")), "left_semi")
    one = W.partitionBy(key).orderBy(text)
    return kept.withColumn("__n", F.row_number().over(one)).where("__n = 1").select(*others(docs))


def op2_simhash(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
