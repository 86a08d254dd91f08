"""Classical scaling of all concepts by chordal distance, without a table of distances.

The squared chordal distance of two blocks is k - <Pi, Pj>, where P = Q^T Q projects on a
block's span.  The double-centred matrix of all distances is therefore half the Gram matrix
of the projectors less their mean, and its eigenvectors follow from d x d matrices V: a
concept stands at <Pi - mean, V> / sqrt 2.  One product is one narrow pass over the blocks,
whose tasks add up d x d sums, so the work grows with the number of blocks, not with its
square, and what reaches the driver depends on d alone (some hundred d x d matrices; two dozen from d = 4000 on).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptspark.operators.geometry import bases
from conceptspark.runtime import stored

#: Columns of the search space before it is cut back (three blocks where d is large), the
#: numbers it may then hold, and rows of a sum that travel together.
SPACE, NUMBERS, PANEL = 48, 200_000_000, 64


class Projectors:
    """The projectors of a dictionary's blocks, as an operator on d x d matrices."""

    def __init__(self, atoms: DataFrame):
        rows = bases(atoms).groupBy("g").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("j", "q"))), lambda s: s["q"])).alias("q"), F.count("*").alias("k"))
        self.rows = stored(rows, "layout-bases")
        one = self.rows.agg(F.count("*").alias("n"), F.sum("k").alias("k"), F.max(F.size("q") / F.col("k")).cast("int").alias("d")).first()
        self.n, self.width, self.d = one["n"], one["k"] or 0, one["d"] or 0
        self.mean = np.zeros((self.d, self.d))
        if self.n:
            self.mean = self._sums(lambda q: np.ones((len(q), 1)), 1)[0] / self.n

    def _sums(self, weights, m: int) -> np.ndarray:
        """Sums of w P over all blocks for each of the ``m`` weights of a batch of blocks."""
        d = self.d

        def part(batches):
            total = np.zeros((m, d, d))
            for pdf in batches:
                if len(pdf):
                    q = np.vstack(pdf["q"]).reshape(len(pdf), -1, d)
                    flat, w = q.reshape(-1, d), weights(q)
                    for c in range(m):
                        total[c] += (q * w[:, c, None, None]).reshape(-1, d).T @ flat
            for c in range(m):
                for at in range(0, d, PANEL):
                    yield pd.DataFrame({"c": [c], "at": [at], "s": [total[c, at : at + PANEL].ravel()]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"c": [pdf["c"].iloc[0]], "at": [pdf["at"].iloc[0]], "s": [sum(pdf["s"])]})

        schema = "c int, at int, s array<double>"
        out = np.zeros((m, d, d))
        for r in self.rows.select("q").mapInPandas(part, schema).groupBy("c", "at").applyInPandas(add, schema).collect():  # m * d * d numbers
            panel = np.asarray(r["s"]).reshape(-1, d)
            out[r["c"], r["at"] : r["at"] + len(panel)] = panel
        return out

    def _inner(self, v: np.ndarray):
        """A function giving <P - mean, V> for each block of a batch and each of the matrices ``v``."""
        shift = np.einsum("de,mde->m", self.mean, v)

        def of(q):
            flat = q.reshape(-1, q.shape[2])
            return np.stack([((flat @ s) * flat).sum(axis=1).reshape(len(q), -1).sum(axis=1) for s in v], axis=1) - shift

        return of

    def apply(self, v: np.ndarray) -> np.ndarray:
        """Half the scatter of the centred projectors times columns of d * d numbers."""
        m = v.shape[1]
        return self._sums(self._inner(v.T.reshape(m, self.d, self.d)), m).reshape(m, -1).T / 2

    def total(self) -> float:
        """Sum of all eigenvalues of the double-centred matrix."""
        return (self.width - self.n * float((self.mean**2).sum())) / 2

    def leading(self, n: int, tol: float = 1e-9, rounds: int = 400, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
        """Up to ``n`` largest eigenvalues, their matrices as columns, and the residual over the largest.

        A search space grows by the residuals of its best vectors, one pass over the blocks
        a round, and is cut back to those when it is wide.  It stops below ``tol``, when no
        direction is left, or after ``rounds``.
        """
        size, m = self.d * self.d, n + 2
        rng = np.random.default_rng(seed)
        w = rng.standard_normal((m, self.d, self.d))
        w = (w + w.transpose(0, 2, 1)).reshape(m, size).T
        space, image = np.zeros((size, 0)), np.zeros((size, 0))
        floor = 1e-12 * max(self.total(), 1e-300)
        while True:
            new = w
            for _ in range(2):
                new = new - space @ (space.T @ new)
                u, s, _ = np.linalg.svd(new, full_matrices=False)
                new = u[:, s > 1e-10 * max(s[0], 1e-300)] if len(s) else u
            space, image = np.hstack([space, new]), np.hstack([image, self.apply(new)])
            values, turn = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
            values, turn = values[::-1][:m], turn[:, ::-1][:, :m]
            v, av = space @ turn, image @ turn
            w = av - v * values
            size_of = np.linalg.norm(w, axis=0)
            left = float(size_of[:n].max(initial=0.0) / max(values[0], floor))
            rounds -= 1
            w = w[:, size_of > max(floor, 1e-13 * values[0])]
            if left <= tol or rounds <= 0 or not w.shape[1]:
                keep = values[:n] > floor
                return values[:n][keep], v[:, :n][:, keep], left
            if space.shape[1] + m > max(3 * m, min(SPACE, NUMBERS // max(size, 1))):
                space, image = v, av

    def places(self, v: np.ndarray) -> DataFrame:
        """(g, x): every block's coordinates along the columns of ``v``, in one narrow pass."""
        d, m = self.d, v.shape[1]
        inner = self._inner(v.T.reshape(m, d, d))

        def of(batches):
            for pdf in batches:
                if len(pdf):
                    yield pd.DataFrame({"g": pdf["g"], "x": list(inner(np.vstack(pdf["q"]).reshape(len(pdf), -1, d)) / np.sqrt(2))})

        return self.rows.select("g", "q").mapInPandas(of, "g int, x array<double>")


def classical_mds(atoms: DataFrame, method: str = "pca") -> DataFrame:
    """(g, x, y) of every block of (g, j, dec): classical scaling of the chordal distances.

    A coordinate beyond the distances' own dimensions is 0.  An axis' sign is free; it is
    chosen so that the largest number of its matrix is positive.
    """
    if method != "pca":
        raise ValueError(f"unknown layout {method!r}")
    p = Projectors(atoms)
    if not p.n:
        return p.rows.select("g", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    v = p.leading(2)[1]
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1, 1) if v.shape[1] else v
    if not v.shape[1]:
        return p.rows.select("g", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    at = lambda i: F.coalesce(F.get("x", F.lit(i)), F.lit(0.0))
    return p.places(v).select("g", at(0).alias("x"), at(1).alias("y"))


def embedding_quality(atoms: DataFrame) -> tuple[float, int]:
    """(share of the spectrum in two dimensions, dimensions that hold half of it), over all blocks.

    The spectrum's sum is known without it, so only as many eigenvalues are worked out as
    hold half.  Blocks that all agree have no spectrum: (0, number of blocks).
    """
    p = Projectors(atoms)
    total = p.total()
    if p.n < 2 or total <= 1e-12:
        return 0.0, p.n
    n = 2
    while True:
        values = p.leading(n, tol=1e-7)[0]
        held = np.cumsum(values) / total
        if held[-1] >= 0.5 or len(values) < n:
            return float(values[:2].sum() / total), int(np.searchsorted(held, 0.5) + 1)
        n *= 2
