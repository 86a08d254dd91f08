"""Learning block dictionaries as Spark jobs.

A step broadcasts the parameters, sums the gradient over its rows per task, adds the tasks'
sums in two levels, and updates on the driver.  Sums and counts travel, never averages, so
a step does not depend on the partitioning.  Parameters pass through the driver: their
number is checked.  ``train_blocks`` keeps them in tables, whatever their number.

Steps follow each other, so their number grows with the rows.  Where a step takes a task no
longer than a job takes to start, a job does a few of them in a row in one task, which holds
their batches alone; the parameters go on from job to job.

Gradients are written out by hand.  With e = x_hat - target and S = 2 e / (rows * d):
dD = z^T S and da = (S D^T) masked by the gate; dW = x^T da, db = sum da.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptspark.operators.normalize import epoch_batches
from conceptspark.runtime import shared_folder

MAX_NUMBERS = 20_000_000
LEVEL = 8
#: Steps of an epoch in one folder, which a job may do in a row.
PART_STEPS = 16
#: Rows times parameters up to which a step is left to one task, and the numbers of the rows it holds.
TASK_WORK, TASK_NUMBERS = 1 << 26, 8_000_000
Params = dict[str, np.ndarray]


def _norms(a: np.ndarray) -> np.ndarray:
    return np.sqrt((a * a).sum(axis=2))


def _topk(n: np.ndarray, l0: int) -> np.ndarray:
    mask = np.zeros(n.shape, dtype=bool)
    np.put_along_axis(mask, np.argsort(-n, axis=1, kind="stable")[:, :l0], True, axis=1)
    return mask


@dataclass
class BlockModel:
    """A block dictionary.  kind: free (own encoder), tied (orthonormal frames), threshold, soft."""

    kind: str
    groups: int
    size: int
    d: int
    l0: int = 16
    coef: float = 1e-2
    gain: float = 10.0
    bandwidth: float = 0.1
    alpha: float = 0.0
    k_aux: int = 0
    dead_after: int = 1_000_000
    params: Params = field(default_factory=dict)
    norm_scale: float = 1.0

    def init(self, seed: int = 0) -> "BlockModel":
        rng = np.random.default_rng(seed)
        dec = rng.standard_normal((self.groups, self.size, self.d))
        if self.kind == "tied":
            self.params = {"B": dec.transpose(0, 2, 1).copy(), "gamma": np.ones(self.groups)}
            return self
        dec /= np.sqrt((dec * dec).sum(axis=(1, 2), keepdims=True))
        self.params = {"D": dec, "W": dec.copy(), "b": np.zeros((self.groups, self.size))}
        if self.kind == "threshold":
            self.params["raw"] = np.zeros(self.groups)
        if self.kind == "soft":
            self.params["log_theta"] = np.full(self.groups, -2.0)
        if sum(p.size for p in self.params.values()) > MAX_NUMBERS:
            raise ValueError("too many parameters to pass through the driver")
        return self

    def theta(self) -> np.ndarray:
        return np.log1p(np.exp(self.gain * self.params["raw"]))

    def thresholds(self) -> np.ndarray:
        """What each block's norm is held against: 0 for kinds that choose by rank."""
        if self.kind == "soft":
            return np.exp(self.params["log_theta"])
        return self.theta() if self.kind == "threshold" else np.zeros(self.groups)

    def preact(self, x: np.ndarray) -> np.ndarray:
        p = self.params
        if self.kind == "tied":
            q = np.linalg.qr(p["B"])[0]
            return np.einsum("nd,gdk->ngk", x, q, optimize=True) * p["gamma"][None, :, None]
        return np.einsum("nd,gkd->ngk", x, p["W"], optimize=True) + p["b"]

    def gate(self, a: np.ndarray) -> np.ndarray:
        n = _norms(a)
        return n / max(self.norm_scale, 1e-6) > self.theta() if self.kind == "threshold" else _topk(n, self.l0)

    def encode(self, x: np.ndarray) -> np.ndarray:
        a = self.preact(x)
        if self.kind == "soft":
            t = np.exp(self.params["log_theta"])
            return a * np.maximum(1 - t / np.maximum(_norms(a), 1e-8), 0)[:, :, None]
        return a * self.gate(a)[:, :, None]

    def atoms(self) -> np.ndarray:
        return np.linalg.qr(self.params["B"])[0].transpose(0, 2, 1) if self.kind == "tied" else self.params["D"]

    def decode(self, z: np.ndarray) -> np.ndarray:
        return np.einsum("ngk,gkd->nd", z, self.atoms(), optimize=True)

    def passes(self, a: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Which blocks are left with a code."""
        return n > np.exp(self.params["log_theta"]) if self.kind == "soft" else self.gate(a)

    def code(self, a: np.ndarray, on: np.ndarray) -> np.ndarray:
        if self.kind == "soft":
            t = np.exp(self.params["log_theta"])
            return a * np.maximum(1 - t / np.maximum(_norms(a), 1e-8), 0)[:, :, None]
        return a * on[:, :, None]

    def loss_and_grad(self, x: np.ndarray, target: np.ndarray, total: int, dead: np.ndarray | None = None) -> tuple[dict[str, float], Params]:
        """Sums over these rows of a step's loss and gradient, for a step of ``total`` rows."""
        a = self.preact(x)
        n = _norms(a)
        on = self.passes(a, n)
        e = self.decode(self.code(a, on)) - target
        pick = e2 = None
        if self.alpha and self.kind != "tied" and dead is not None and dead.any():
            quiet = np.where(dead, n, -np.inf)
            pick = _topk(quiet, min(self.k_aux or self.l0, int(dead.sum()))) & dead
            e2 = self.decode(a * pick[:, :, None]) + e  # the residual is a constant of this term
        info, grad = self.grad_of(x, a, on, e, total, pick, e2)
        info["recon"] = float((e * e).sum()) / (total * self.d)
        if e2 is not None:
            info["aux"] = self.alpha * float((e2 * e2).sum()) / (total * self.d)
        return info, grad

    def grad_of(self, x: np.ndarray, a: np.ndarray, on: np.ndarray, e: np.ndarray, total: int, pick: np.ndarray | None = None, e2: np.ndarray | None = None) -> tuple[dict[str, float], Params]:
        """(L0 and penalty, gradient) of these rows, given the error ``e`` of the whole dictionary.

        All is a sum over blocks or belongs to one, so a chunk of the blocks has its part from
        its own parameters, ``a`` and ``on``.  ``pick`` are revived blocks, ``e2`` their error.
        """
        if self.kind == "tied":
            return self._tied(x, a, on, e, total)
        p, n, z = self.params, _norms(a), self.code(a, on)
        s = 2 * e / (total * self.d)
        up = np.einsum("nd,gkd->ngk", s, p["D"])
        zn = _norms(z)
        info = {"l0": float((zn > 1e-6).sum()) / total, "penalty": 0.0}
        grad = {"D": np.einsum("ngk,nd->gkd", z, s)}
        if self.kind == "soft":
            t, r = np.exp(p["log_theta"]), np.maximum(n, 1e-8)
            info["penalty"] = self.coef * float(zn.sum()) / total
            up = up + (self.coef / total) * z / np.maximum(zn, 1e-12)[:, :, None]
            inner = (up * a).sum(axis=2)
            da = on[:, :, None] * ((1 - t / r)[:, :, None] * up + (t / r**3 * inner)[:, :, None] * a)
            grad["log_theta"] = (-(inner / r) * on).sum(axis=0) * t
        else:
            da = up * on[:, :, None]
        if self.kind == "threshold":
            info["penalty"] = self.coef * float(on.sum()) / total
            h = (up * a).sum(axis=2) + self.coef / total
            k = self.window(n) / (np.pi * self.bandwidth)
            grad["raw"] = -(h * k).sum(axis=0) * self.gain / (1 + np.exp(-self.gain * p["raw"]))
        if pick is not None and e2 is not None:
            s2 = 2 * self.alpha * e2 / (total * self.d)
            grad["D"] += np.einsum("ngk,nd->gkd", a * pick[:, :, None], s2)
            da = da + np.einsum("nd,gkd->ngk", s2, p["D"]) * pick[:, :, None]
        grad["W"], grad["b"] = np.einsum("ngk,nd->gkd", da, x), da.sum(axis=0)
        return info, grad

    def window(self, n: np.ndarray) -> np.ndarray:
        """Kernel mass of norms about the thresholds, over its peak."""
        u = (n / max(self.norm_scale, 1e-6) - self.theta()) / self.bandwidth
        return 1 / (1 + u * u)

    def _tied(self, x, a, on, e, total):
        p = self.params
        q, r = np.linalg.qr(p["B"])
        z = a * on[:, :, None]
        s = 2 * e / (total * self.d)
        raw = np.einsum("nd,gdk->ngk", x, q, optimize=True)
        dz = np.einsum("nd,gdk->ngk", s, q, optimize=True) * on[:, :, None]
        dq = np.einsum("nd,ngk->gdk", s, z, optimize=True) + np.einsum("nd,ngk->gdk", x, dz * p["gamma"][None, :, None], optimize=True)
        m = -np.einsum("gdk,gdl->gkl", dq, q)
        low = np.tril(m)
        sym = low + np.tril(m, -1).transpose(0, 2, 1)
        db = np.einsum("gdk,gkl->gdl", dq + np.einsum("gdk,gkl->gdl", q, sym), np.linalg.inv(r).transpose(0, 2, 1))
        return {"l0": float(on.sum()) / total, "penalty": 0.0}, {"B": db, "gamma": (dz * raw).sum(axis=(0, 2))}

    def renormalise(self) -> None:
        """Decoder blocks back to Frobenius norm 1."""
        if "D" in self.params:
            d = self.params["D"]
            d /= np.maximum(np.sqrt((d * d).sum(axis=(1, 2), keepdims=True)), 1e-8)


@dataclass
class Adam:
    """Vector state of the optimiser, on the driver."""

    rate: float = 4e-4
    b1: float = 0.9
    b2: float = 0.999
    t: int = 0
    m: Params = field(default_factory=dict)
    v: Params = field(default_factory=dict)

    def step(self, params: Params, grad: Params) -> None:
        self.t += 1
        for k, g in grad.items():
            self.m[k] = self.b1 * self.m.get(k, 0) + (1 - self.b1) * g
            self.v[k] = self.b2 * self.v.get(k, 0) + (1 - self.b2) * g * g
            params[k] = params[k] - self.rate * (self.m[k] / (1 - self.b1**self.t)) / (np.sqrt(self.v[k] / (1 - self.b2**self.t)) + 1e-8)


PARTS = ("recon", "l0", "penalty", "aux")


def _sums(model: BlockModel, ids: np.ndarray, x: np.ndarray, total: int, snr: float, std: float, seed: int, dead: np.ndarray | None) -> tuple[dict[str, float], Params, np.ndarray, tuple[float, int]]:
    """(loss parts, gradient, which blocks fired, sum and number of block norms) of some rows of a step of ``total``."""
    noisy = x
    if snr:
        # Noise depends on the row, not on where it is computed.
        noisy = x + snr * std * np.stack([np.random.default_rng([seed, int(t)]).standard_normal(x.shape[1]) for t in ids])
    info, grad = model.loss_and_grad(noisy, x, total, dead)
    a = model.preact(noisy)
    fired = model.gate(a).any(axis=0) if model.kind != "soft" else (_norms(model.encode(noisy)) > 1e-6).any(axis=0)
    return info, grad, fired, (_norms(a).sum(), a.shape[0] * a.shape[1])


def step_sums(rows: DataFrame, model: BlockModel, total: int, snr: float = 0.0, std: float = 1.0, seed: int = 0, dead: np.ndarray | None = None) -> tuple[dict[str, float], Params, np.ndarray, float]:
    """(loss parts, gradient, which blocks fired, mean block norm) of one step over ``rows`` (token_id, x)."""
    names = sorted(model.params)
    shapes = {k: model.params[k].shape for k in names}

    def sums(batches):
        out = np.zeros(len(PARTS) + model.groups + 2 + sum(model.params[k].size for k in names))
        at = len(PARTS) + model.groups
        for pdf in batches:
            if not len(pdf):
                continue
            info, grad, fired, norms = _sums(model, pdf["token_id"], np.vstack(pdf["x"]).astype(np.float64), total, snr, std, seed, dead)
            out[: len(PARTS)] += [info.get(k, 0.0) for k in PARTS]
            out[len(PARTS) : at] += fired
            out[at : at + 2] += norms
            out[at + 2 :] += np.concatenate([grad[k].ravel() for k in names])
        from pyspark import TaskContext

        yield pd.DataFrame({"bucket": [TaskContext.get().partitionId() % LEVEL], "v": [out]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"v": [np.sum(list(pdf["v"]), axis=0)]})

    two = rows.select("token_id", "x").mapInPandas(sums, "bucket int, v array<double>").groupBy("bucket").applyInPandas(add, "v array<double>")
    v = np.sum([r["v"] for r in two.collect()], axis=0)
    info = dict(zip(PARTS, v))
    at = len(PARTS) + model.groups
    grad, i = {}, at + 2
    for k in names:
        grad[k] = v[i : i + int(np.prod(shapes[k]))].reshape(shapes[k])
        i += grad[k].size
    return info, grad, v[len(PARTS) : at] > 0, float(v[at] / max(v[at + 1], 1))


@dataclass
class Training:
    """What goes on from step to step of ``fit``."""

    model: BlockModel
    adam: Adam
    silent: np.ndarray
    batch: int
    snr: float
    std: float
    seed: int
    momentum: float
    steps: int = 0

    def step(self, sums: Callable[[int, np.ndarray | None], tuple[dict[str, float], Params, np.ndarray, float]], control: Callable[[float], float] | None = None) -> dict[str, float]:
        """One step, whose ``sums`` are made from (seed of its noise, dead blocks); its record."""
        model = self.model
        dead = self.silent > model.dead_after if model.alpha else None
        info, grad, fired, scale = sums(self.seed + 7919 * (self.steps + 1), dead)
        if model.kind == "threshold":
            model.norm_scale = scale if not self.steps else max(self.momentum * model.norm_scale + (1 - self.momentum) * scale, 1e-6)
        self.silent = np.where(fired, 0, self.silent + self.batch)
        self.adam.step(model.params, grad)
        model.renormalise()
        if control is not None:
            model.coef = control(info["l0"])
        self.steps += 1
        return {**info, "loss": info["recon"] + info["penalty"] + info["aux"], "dead": int((self.silent > model.dead_after).sum())}

    def at_once(self) -> int:
        """How many steps a task may do in a row: 1 where a step's work is worth a job of its own."""
        if self.batch * sum(p.size for p in self.model.params.values()) > TASK_WORK:
            return 1
        return max(1, min(PART_STEPS, TASK_NUMBERS // (self.batch * self.model.d)))

    def steps_in_a_task(self, rows: DataFrame) -> list[dict[str, float]]:
        """The steps of ``rows`` (step, token_id, x) in their order; a few batches, which one task holds."""
        now = self

        def run(batches):
            given = pd.concat(list(batches)).sort_values(["step", "token_id"], kind="stable")
            log = []
            for _, own in given.groupby("step", sort=True):
                x, ids = np.vstack(own["x"]).astype(np.float64), own["token_id"]

                def sums(seed, dead):
                    info, grad, fired, (norm, n) = _sums(now.model, ids, x, now.batch, now.snr, now.std, seed, dead)
                    return {k: info.get(k, 0.0) for k in PARTS}, grad, fired, float(norm / max(n, 1))

                log.append(now.step(sums))
            yield pd.DataFrame({"done": [pickle.dumps((now, log))]})

        done, log = pickle.loads(rows.select("step", "token_id", "x").coalesce(1).mapInPandas(run, "done binary").first()["done"])
        self.model.params, self.model.norm_scale = done.model.params, done.model.norm_scale
        self.adam, self.silent, self.steps = done.adam, done.silent, done.steps
        return log


def _epoch(acts: DataFrame, batch: int, seed: int, epoch: int) -> Callable[[int, int], DataFrame]:
    """A function that reads the steps first .. upto - 1 of an epoch, which lie in one folder, from that folder alone."""
    path = f"{shared_folder(acts.sparkSession)}/train-epoch-{uuid.uuid4().hex}"
    rows = epoch_batches(acts.select("token_id", "x"), batch, seed, epoch)
    rows = rows.select("token_id", "x", F.col("step").cast("long").alias("step"), F.expr(f"cast(step div {PART_STEPS} as int)").alias("part"))
    rows.write.partitionBy("part").parquet(path)
    schema = rows.drop("part").schema

    def of(first: int, upto: int) -> DataFrame:
        return acts.sparkSession.read.schema(schema).parquet(f"{path}/part={first // PART_STEPS}").where(F.col("step").between(first, upto - 1))

    return of


def fit(acts: DataFrame, model: BlockModel, epochs: int = 1, batch: int = 2048, rate: float = 4e-4, snr: float = 0.1, seed: int = 0, max_steps: int | None = None, control: Callable[[float], float] | None = None, momentum: float = 0.99) -> list[dict[str, float]]:
    """Train in place; returns one record per step.  Fewer rows than a batch are an error."""
    n = acts.count()
    if n < batch:
        raise ValueError(f"{n} rows are less than one batch of {batch}")
    if not model.params:
        model.init(seed)
    std = acts.select(F.explode("x").alias("v")).agg(F.stddev_samp("v")).first()[0]
    run, log = Training(model, Adam(rate), np.zeros(model.groups), batch, snr, std, seed, momentum), []
    # What is fed every step's L0 is asked between steps.
    most = run.at_once() if control is None else 1
    for epoch in range(epochs):
        last = n // batch if max_steps is None else min(n // batch, max_steps - len(log))
        if last <= 0:
            break
        rows = _epoch(acts, batch, seed, epoch)
        first = 0
        while first < last:
            upto = min(last, first + most, (first // PART_STEPS + 1) * PART_STEPS)
            own = rows(first, upto)
            if most > 1:
                made = run.steps_in_a_task(own)
            else:
                made = [run.step(lambda noise, dead: step_sums(own, model, batch, snr, std, noise, dead), control)]
            log += [{**r, "epoch": epoch} for r in made]
            first = upto
    return log


def warm_up(acts: DataFrame, model: BlockModel, target_l0: float) -> None:
    """Start a threshold gate where about ``target_l0`` blocks pass; exact quantile over all norms."""

    def norms(batches):
        for pdf in batches:
            yield pd.DataFrame({"act": _norms(model.preact(np.vstack(pdf["x"]).astype(np.float64))).ravel()})

    from conceptspark.operators.state import theta_init

    one = theta_init(acts.select("x").mapInPandas(norms, "act double"), target_l0, model.groups, model.gain).first()
    model.norm_scale = one["scale"]
    model.params["raw"] = np.full(model.groups, one["raw_theta"])


def evaluate(acts: DataFrame, model: BlockModel) -> dict[str, float]:
    """R2 about the global mean, mean L0 and dead blocks, from sums over all rows."""

    def sums(batches):
        for pdf in batches:
            x = np.vstack(pdf["x"]).astype(np.float64)
            z = model.encode(x)
            on = _norms(z) > 1e-6
            e = model.decode(z) - x
            yield pd.DataFrame({"res": [float((e * e).sum())], "sq": [float((x * x).sum())], "n": [len(x)], "active": [int(on.sum())], "sum": [x.sum(axis=0)], "fired": [on.any(axis=0).astype(int)]})

    parts = acts.select("x").mapInPandas(sums, "res double, sq double, n long, active long, sum array<double>, fired array<int>")
    # Arrays of d and G numbers are added up by Spark; one row comes back.
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"res": [pdf["res"].sum()], "sq": [pdf["sq"].sum()], "n": [pdf["n"].sum()], "active": [pdf["active"].sum()], "sum": [np.sum(list(pdf["sum"]), axis=0)], "fired": [np.max(list(pdf["fired"]), axis=0)]})

    two = parts.withColumn("k", F.spark_partition_id() % LEVEL).groupBy("k").applyInPandas(lambda pdf: add(pdf), "res double, sq double, n long, active long, sum array<double>, fired array<int>")
    r = add(two.toPandas()).iloc[0]
    tot = r["sq"] - float(np.square(r["sum"]).sum()) / r["n"]
    return {"r2": 1 - r["res"] / max(tot, 1e-12), "l0": r["active"] / r["n"], "dead": int((np.asarray(r["fired"]) == 0).sum())}


def model_tables(spark, model: BlockModel) -> tuple[DataFrame, DataFrame]:
    """(atoms, meta) of a model, to be written as a checkpoint."""
    atoms = model.atoms()
    enc = atoms * model.params["gamma"][:, None, None] if model.kind == "tied" else model.params["W"]
    bias = np.zeros(atoms.shape[:2]) if model.kind == "tied" else model.params["b"]
    theta = model.thresholds()
    rows = [(g, j, atoms[g, j].tolist(), enc[g, j].tolist(), float(bias[g, j]), float(theta[g])) for g in range(model.groups) for j in range(model.size)]
    meta = [(model.kind, model.groups, model.size, model.d, model.l0, float(model.norm_scale))]
    return (
        spark.createDataFrame(rows, "g int, j int, dec array<double>, enc array<double>, bias double, theta double"),
        spark.createDataFrame(meta, "kind string, n_groups int, group_size int, d int, l0 int, norm_scale double"))
