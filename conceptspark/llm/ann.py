"""Nearest neighbours by collision-counting hashing.

Every vector is projected on ``projections`` random directions; each direction is one
sorted array of a block.  A query opens a window around its own projection in every array.
The windows widen together (virtual rehashing: the width grows, nothing is hashed anew):
each step walks outward from the old windows' edges and counts one collision for every row
it passes, so only rows inside windows are touched, each once per array.  A row whose count
reaches the threshold is verified by its exact cosine.

A query stops by distance and k.  The projections of two unit vectors at distance d differ
by a normal variable of deviation d, so at half-width w a row as near as the k-th verified
one collides in Binomial(projections, 2 Phi(w / d) - 1) arrays; the search ends at the first
width at which this reaches the threshold with the asked confidence.

Rows are dealt out to blocks by a hash, each row to one block, and every query goes to every
block once.  A task builds a block's arrays when the block's rows have come, then takes its
queries in batches, so it holds one block and one batch.  The k best per block are merged by
a window per query.  Every row is indexed.  Equal vectors are one entry with its k + 1
smallest ids, which is all that a list of k can show, so a vector that fills a third of the
table costs no more than any other.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptspark.runtime import stored

PROJECTIONS = 128
#: Windows, as a share of the projections, that a vector must lie in.
THRESHOLD = 0.7
#: Half-width of the first windows, and by how much they grow at most in a step.
FIRST_WIDTH = 0.25
RATIO = 1.25
#: Chance that a row as near as the k-th is verified before the search stops, by the model above.
CONFIDENCE = 0.9
#: Rows of a block, and queries that one task takes through it (more are dealt to copies of it).
ROW_BLOCK, QUERY_BLOCK = 16384, 65536
SEED = 5


def _cosine(rows: np.ndarray, norms: np.ndarray, q: np.ndarray, q_norm: float) -> np.ndarray:
    """Row by row, so that a pair's cosine never depends on what stands beside it."""
    return (rows * q).sum(axis=1) / (norms * q_norm)


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two that bring their largest components near 1: no square overflows, no cosine changes."""
    vectors = vectors.astype(np.float64)
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def stop_ratio(projections: int, threshold: float, confidence: float) -> float:
    """Half-width over distance at which a row at that distance has collided often enough."""
    need, z = math.ceil(threshold * projections), NormalDist().inv_cdf(confidence)
    low, high = 0.0, 1.0
    for _ in range(60):
        p = (low + high) / 2
        sure = projections * p - z * math.sqrt(projections * p * (1 - p)) >= need
        low, high = (low, p) if sure else (p, high)
    return NormalDist().inv_cdf(min((1 + high) / 2, 1 - 1e-15))


class BlockIndex:
    """Sorted projections of a block of vectors."""

    def __init__(self, vectors: np.ndarray, projections=PROJECTIONS, seed=SEED):
        self.vectors = _scaled(vectors)
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.directions = np.random.default_rng(seed).standard_normal((vectors.shape[1], projections))
        h = (self.vectors / self.norms[:, None]) @ self.directions
        self.order = np.ascontiguousarray(np.argsort(h, axis=0, kind="stable").T.astype(np.int32))
        # The arrays stand end to end, shifted apart, so that one search serves all of them.
        self.shift = 1000.0 * np.arange(projections)
        self.sorted = (np.take_along_axis(h.T, self.order, axis=1) + self.shift[:, None]).ravel()
        self.begin = len(h) * np.arange(projections)

    def search(self, queries: np.ndarray, k: int, threshold=THRESHOLD, width=FIRST_WIDTH, ratio=RATIO, confidence=CONFIDENCE):
        """For each query the verified rows and their cosines."""
        queries = _scaled(queries)
        q_norm = np.sqrt((queries * queries).sum(axis=1))
        h = (queries / q_norm[:, None]) @ self.directions
        m, n = self.order.shape
        need, enough = max(1, math.ceil(threshold * m)), stop_ratio(m, threshold, confidence)
        flat, out = self.order.ravel(), []
        for q, centre in enumerate(h + self.shift):
            low = high = self.sorted.searchsorted(centre)
            low = high = np.clip(low, self.begin, self.begin + n)
            counts = np.zeros(n, dtype=np.int64)
            done = np.zeros(n, dtype=bool)
            rows, cosines, w = [], [], width
            while True:
                a = np.maximum(self.sorted.searchsorted(centre - w), self.begin)
                b = np.minimum(self.sorted.searchsorted(centre + w, side="right"), self.begin + n)
                passed = [flat[x:y] for x, y in zip(a.tolist(), low.tolist())] + [flat[x:y] for x, y in zip(high.tolist(), b.tolist())]
                low, high = a, b
                counts += np.bincount(np.concatenate(passed), minlength=n)
                new = np.flatnonzero((counts >= need) & ~done)
                if len(new):
                    done[new] = True
                    rows.append(new)
                    cosines.append(_cosine(self.vectors[new], self.norms[new], queries[q], q_norm[q]))
                found = np.concatenate(cosines) if cosines else np.zeros(0)
                if len(found) == n:
                    break
                if len(found) >= k:
                    kth = np.partition(found, len(found) - k)[len(found) - k]
                    far = enough * math.sqrt(max(0.0, 2 - 2 * kth))
                    if w >= far:
                        break
                    w = min(w * ratio, far)
                else:
                    w *= ratio
            out.append((np.concatenate(rows), found))
        return out


def usable(vec):
    """Vectors that take part: not null or empty, finite, and not zero."""
    inf = F.lit(float("inf")).cast("double")
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < inf))
    return vec.isNotNull() & (F.size(vec) > 0) & sound & F.exists(vec, lambda x: x != 0)


def search(rows: DataFrame, queries: DataFrame, k=5, key="vec_id", vec="embedding", row_block=ROW_BLOCK, query_block=QUERY_BLOCK, **options) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query, itself left out.

    Vectors that are null, empty, zero or not finite take no part on either side; vectors
    of different lengths never meet.  Equal scores rank by smaller id.  A query with fewer
    than k candidates gets all of them; an empty table gives no rows.  Rows that repeat an
    id count as one row if they repeat the vector too.  Other columns are left out, whatever
    their names.
    """
    own = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vec).alias("vec")).where(usable(F.col("vec"))).where("vec_id is not null").distinct()
    first = W.partitionBy("vec").orderBy("vec_id")
    few = own.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    entries = stored(few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "ann-rows")
    asked = queries.select(F.col(key).cast("long").alias("query_id"), F.col(vec).alias("vec")).where(usable(F.col("vec"))).where("query_id is not null").distinct()
    asked = stored(asked, "ann-queries")
    n_blocks = max(1, math.ceil(entries.count() / row_block))
    copies = max(1, math.ceil(asked.count() / query_block))

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = entries.select(F.pmod(F.xxhash64("vec"), F.lit(n_blocks)).cast("int").alias("b"), every(copies).alias("c"), F.lit(False).alias("asks"), F.lit(0).cast("long").alias("query_id"), "ids", "vec")
    right = asked.select(every(n_blocks).alias("b"), F.pmod(F.xxhash64("query_id"), F.lit(copies)).cast("int").alias("c"), F.lit(True).alias("asks"), "query_id", F.lit(None).cast("array<long>").alias("ids"), "vec")
    both = left.unionByName(right).withColumn("d", F.size("vec"))
    # Rows of a block come before its queries.  Ids are never null, so that pandas keeps them whole.
    both = both.repartition(n_blocks * copies, "b", "c", "d").sortWithinPartitions("b", "c", "d", "asks", "query_id")

    def answers(index, ids, ask):
        out = []
        # One more than k: the query's own vector may be among them.
        for query, (hit, cos) in zip(ask["query_id"], index.search(np.vstack(ask["vec"]), k + 1, **options)):
            top = np.sort(cos)[::-1][: k + 1][-1]
            mine = [(-c, int(i)) for r, c in zip(hit, cos) if c >= top for i in ids[r] if i != query]
            out += [(int(query), i, -c) for c, i in sorted(mine)[:k]]
        return out

    def meet(batches):
        held, group, index, ids = [], None, None, []
        for pdf in batches:
            out = []
            for g, part in pdf.groupby(["b", "c", "d"], sort=True):
                if g != group:
                    held, group, index = [], g, None
                data, ask = part[~part["asks"]], part[part["asks"]]
                if len(data):
                    held.append(data[["ids", "vec"]])
                if len(ask) and index is None and held:
                    whole = pd.concat(held)
                    index, ids, held = BlockIndex(np.vstack(whole["vec"])), list(whole["ids"]), []
                if len(ask) and index is not None:
                    out += answers(index, ids, ask)
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    near = both.mapInPandas(meet, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_neighbours(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, rows.where("vec_id % 50 = 0"))
