"""Encoding activation rows into sparse firings of a block dictionary, and back.

The hot path is one narrow ``mapInArrow`` stage: a batch of rows times the encoder matrix,
block norms, a gate, and only the firing blocks come out.  The dictionary travels to the
tasks once; its size is checked.  ``projections`` is the same in DataFrame functions, kept
to hold the Arrow form against.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIRES = 1e-6
#: Numbers of a dictionary that may travel to the driver and the tasks.
MAX_NUMBERS = 200_000_000
FIRINGS = "token_id long, unit string, pos int, g int, act double, code array<double>"


@dataclass
class Dictionary:
    """Decoder and encoder of ``n_groups`` blocks of ``group_size`` atoms in ``d`` dimensions."""

    dec: np.ndarray
    enc: np.ndarray
    bias: np.ndarray
    gamma: np.ndarray = field(default_factory=lambda: np.ones(0))

    @classmethod
    def of(cls, atoms: DataFrame) -> "Dictionary":
        """From a table (g, j, dec[, enc, bias]); without ``enc`` the encoder is the decoder."""
        n = atoms.agg(F.sum(F.size("dec"))).first()[0] or 0
        if n > MAX_NUMBERS:
            raise ValueError(f"a dictionary of {n} numbers is too large to travel")
        rows = atoms.orderBy("g", "j").collect()
        dec = np.array([r["dec"] for r in rows], dtype=np.float64)
        groups = len({r["g"] for r in rows})
        if not groups or len(rows) % groups:
            raise ValueError("every block needs the same number of atoms")
        dec = dec.reshape(groups, len(rows) // groups, -1)
        has = atoms.columns
        enc = np.array([r["enc"] for r in rows]).reshape(dec.shape) if "enc" in has else dec
        bias = np.array([r["bias"] for r in rows]).reshape(dec.shape[:2]) if "bias" in has else np.zeros(dec.shape[:2])
        return cls(dec, enc, bias, np.ones(groups))

    @property
    def n_groups(self) -> int:
        return self.dec.shape[0]

    @property
    def group_size(self) -> int:
        return self.dec.shape[1]

    def orthonormal(self) -> "Dictionary":
        """Each block replaced by an orthonormal basis of its span (tied frames)."""
        q = np.linalg.qr(self.dec.transpose(0, 2, 1))[0].transpose(0, 2, 1)
        return Dictionary(q, q * self.gamma[:, None, None], np.zeros_like(self.bias), self.gamma)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Pre-activations (rows, groups, group size)."""
        a = x @ self.enc.reshape(-1, self.enc.shape[2]).T
        return a.reshape(len(x), self.n_groups, self.group_size) + self.bias

    def decode(self, z: np.ndarray) -> np.ndarray:
        return z.reshape(len(z), -1) @ self.dec.reshape(-1, self.dec.shape[2])


class Gate(Protocol):
    """Turns pre-activations into gated codes."""

    def __call__(self, a: np.ndarray, norms: np.ndarray) -> np.ndarray: ...


@dataclass
class TopK:
    """Keep the ``l0`` blocks of largest norm; ties go to the smaller block."""

    l0: int

    def __call__(self, a, norms):
        if self.l0 >= norms.shape[1]:
            return a
        # A stable sort of the few columns decides ties by block number.
        order = np.argsort(-norms, axis=1, kind="stable")[:, : self.l0]
        mask = np.zeros(norms.shape, dtype=bool)
        np.put_along_axis(mask, order, True, axis=1)
        return a * mask[:, :, None]


@dataclass
class Threshold:
    """Keep a block where norm / norm_scale > theta of the block."""

    theta: np.ndarray
    norm_scale: float = 1.0

    def __call__(self, a, norms):
        return a * (norms / self.norm_scale > self.theta)[:, :, None]


@dataclass
class Soft:
    """Shrink every block's norm by theta, to 0 at least; norms are floored at 1e-8."""

    theta: np.ndarray

    def __call__(self, a, norms):
        return a * np.maximum(1 - self.theta / np.maximum(norms, 1e-8), 0)[:, :, None]


def _rows(batch: pa.RecordBatch, x: str = "x") -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(x))
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))


def firings(acts: DataFrame, model: Dictionary, gate: Gate) -> DataFrame:
    """(token_id, unit, pos, g, act, code) of the blocks that fire; rows in, nothing shuffled."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            a = model.project(_rows(b))
            z = gate(a, np.sqrt((a * a).sum(axis=2)))
            act = np.sqrt((z * z).sum(axis=2))
            row, g = np.nonzero(act > FIRES)
            code = z[row, g]
            offsets = pa.array(np.arange(len(row) + 1, dtype=np.int32) * model.group_size)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i).take(take) for i in range(3)), pa.array(g, pa.int32()), pa.array(act[row, g]), pa.ListArray.from_arrays(offsets, pa.array(code.ravel()))],
                names=["token_id", "unit", "pos", "g", "act", "code"])

    return acts.select(F.col("token_id").cast("long"), F.col("unit").cast("string"), F.col("pos").cast("int"), "x").mapInArrow(run, FIRINGS)


class Progress:
    """What a pass of ``firings`` went through; its numbers are there once an action has run.

    They are counted on the way (``DataFrame.observe``), so they cost no second pass.
    """

    def __init__(self):
        self.rows, self.fired = Observation(), Observation()

    def get(self) -> dict[str, float]:
        """n_rows, n_firings, sum_act, max_act and mean_l0; waits for the first action to end."""
        out = {**self.rows.get, **self.fired.get}
        return {**out, "sum_act": out["sum_act"] or 0.0, "mean_l0": out["n_firings"] / max(out["n_rows"], 1)}


def firings_with_progress(acts: DataFrame, model: Dictionary, gate: Gate, report: Callable[[str, dict], None] | None = None) -> tuple[DataFrame, Progress]:
    """``firings`` and its ``Progress``.  Retried or speculative tasks count once.

    ``report`` is called with a name and the numbers when the first action ends.
    """
    progress = Progress()
    rows = acts.observe(progress.rows, F.count(F.lit(1)).alias("n_rows"))
    out = firings(rows, model, gate).observe(progress.fired, F.count(F.lit(1)).alias("n_firings"), F.sum("act").alias("sum_act"), F.max("act").alias("max_act"))
    if report is not None:
        threading.Thread(target=lambda: report("encode", progress.get()), daemon=True).start()
    return out, progress


def reconstruct(acts: DataFrame, model: Dictionary, gate: Gate) -> DataFrame:
    """(token_id, x, x_hat) in one narrow stage."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _rows(b)
            a = model.project(x)
            out = model.decode(gate(a, np.sqrt((a * a).sum(axis=2))))
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=["token_id", "x", "x_hat"])

    return acts.select(F.col("token_id").cast("long"), F.col("x").cast("array<double>")).mapInArrow(run, "token_id long, x array<double>, x_hat array<double>")


def dot(a, b):
    """Inner product of two array columns, in DataFrame functions."""
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def projections(acts: DataFrame, atoms: DataFrame) -> DataFrame:
    """(token_id, unit, pos, g, act, code) of all blocks, in DataFrame functions; small dictionaries only (checked)."""
    if (atoms.agg(F.sum(F.size("dec"))).first()[0] or 0) > MAX_NUMBERS // 100:
        raise ValueError("use firings() for a dictionary of this size")
    blocks = atoms.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "dec"))), lambda s: s["dec"]).alias("block"))
    rows = acts.crossJoin(F.broadcast(blocks))
    rows = rows.withColumn("code", F.transform("block", lambda d: dot(F.col("x"), d)))
    act = F.sqrt(F.aggregate("code", F.lit(0.0), lambda s, v: s + v * v))
    return rows.select("token_id", "unit", "pos", "g", act.alias("act"), "code")


#: Numbers that a task decodes at once.
DECODE_NUMBERS = 2_000_000


def decode_table(firings_: DataFrame, atoms: DataFrame) -> DataFrame:
    """(token_id, dim, value): sums of codes times atoms.

    A token's codes are brought together, as many as fire, and multiplied where they lie; what
    is shuffled are codes, never products.  A dictionary too large to travel, or of uneven
    blocks, is met by joins.
    """
    try:
        model = Dictionary.of(atoms)
    except ValueError:
        return _decode_joined(firings_, atoms)
    known = np.array([r["g"] for r in atoms.select("g").distinct().orderBy("g").collect()])
    codes = firings_.groupBy("token_id").agg(F.sort_array(F.collect_list(F.struct("g", F.col("code").cast("array<double>").alias("code")))).alias("codes"))
    k, d = model.group_size, model.dec.shape[2]
    at_once = max(1, DECODE_NUMBERS // (k * d))

    def run(batches):
        for b in batches:
            sizes = pc.list_value_length(b["codes"]).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            flat = b["codes"].flatten()
            g, code = flat.field("g").to_numpy(zero_copy_only=False), flat.field("code").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            place = np.minimum(np.searchsorted(known, g), len(known) - 1)
            there = known[place] == g  # codes of blocks that the dictionary lacks count for nothing
            first = 0
            while first < b.num_rows:
                begin = ends[first] - sizes[first]
                upto = max(first + 1, int(np.searchsorted(ends, begin + at_once, side="right")))
                part = slice(begin, ends[upto - 1])
                owner = np.repeat(np.arange(upto - first), sizes[first:upto])
                keep = there[part]
                owner = owner[keep]
                if len(owner):
                    products = np.einsum("mk,mkd->md", code[part][keep], model.dec[place[part][keep]])
                    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                    sums = np.add.reduceat(products, starts, axis=0)
                    tokens = b["token_id"].take(pa.array(np.repeat(first + owner[starts], d)))
                    yield pa.RecordBatch.from_arrays([tokens, pa.array(np.tile(np.arange(d, dtype=np.int32), len(starts))), pa.array(sums.ravel())], names=["token_id", "dim", "value"])
                first = upto

    return codes.mapInArrow(run, T.StructType([firings_.schema["token_id"], T.StructField("dim", T.IntegerType()), T.StructField("value", T.DoubleType())]))


def _decode_joined(firings_: DataFrame, atoms: DataFrame) -> DataFrame:
    """``decode_table`` of dictionaries of any size, a row for every product."""
    z = firings_.select("token_id", "g", F.posexplode("code").alias("j", "z"))
    parts = z.join(atoms.select("g", "j", F.posexplode("dec").alias("dim", "d")), ["g", "j"])
    return parts.groupBy("token_id", "dim").agg(F.sum(F.col("z") * F.col("d")).alias("value"))


def unit_blocks(atoms: DataFrame) -> DataFrame:
    """Blocks of Frobenius norm 1 (norms floored at 1e-8)."""
    norm = atoms.groupBy("g").agg(F.greatest(F.sqrt(F.sum(dot(F.col("dec"), F.col("dec")))), F.lit(1e-8)).alias("norm"))
    return atoms.join(norm, "g").select("g", "j", F.transform("dec", lambda v: v / F.col("norm")).alias("dec"))
