"""Learning dictionaries whose parameters are tables, for those too large for the driver.

A row of the state is a block: its parameters and both moments of the optimiser as flat
arrays, and how long it has been silent.  Rows are dealt into chunks of a bounded number of
parameters.  A step is four jobs, none of which gathers parameters or gradients:

1. gates: every chunk meets the batch; a row's candidates (as many as may pass) come out,
2. a row's best blocks over all chunks; chunks decode their own codes, a bucket of rows adds
   up the parts and has the error of the whole dictionary,
3. every chunk meets the errors: gradient, optimiser and norms of its blocks are its own,
4. sums of a few numbers for the record.

Where the dictionary is one chunk, one task has all that a step needs, and a job does up to 15
steps in a row: the state goes from job to job as a table, and a task holds the chunk and
these batches.

Each step's tables cut the lineage of the next.  The state has two places that steps write
in turn; a step counts once its record stands, and records are never overwritten.  A run
that was stopped goes on after its last record, to the same numbers.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conceptspark.operators.normalize import epoch_batches
from conceptspark.operators.state import theta_init
from conceptspark.operators.train import BlockModel, _norms, _topk

#: Parameters of a chunk (64 MB in doubles, and twice that for the moments).
CHUNK_NUMBERS = 8_000_000
#: Rows whose errors are added up together.
BUCKET_ROWS = 128
#: Steps of an epoch in one folder.
PART_STEPS = 16
#: Numbers of the rows of a run of steps that one task holds.
RUN_NUMBERS = 8_000_000
#: A block whose share of the kernel's peak is below this has no gradient for its threshold.
STRANDED = 1e-3

STATE = "chunk int, g int, p array<double>, m array<double>, v array<double>, silent long, l0 double, penalty double, norm_sum double, window double"
GATES = "chunk int, slot int, g int, aux boolean, norm double, code array<double>"
ERRORS = "slot int, xin array<double>, e array<double>, e2 array<double>, err double, aux double"


def shapes(model: BlockModel) -> dict[str, tuple]:
    """Parts of a block's parameters, the decoder first, in the order they are kept in."""
    k, d = model.size, model.d
    if model.kind == "tied":
        return {"B": (d, k), "gamma": ()}
    out = {"D": (k, d), "W": (k, d), "b": (k,)}
    return out | {"threshold": {"raw": ()}, "soft": {"log_theta": ()}}.get(model.kind, {})


def _size(model: BlockModel) -> int:
    return sum(int(np.prod(s)) for s in shapes(model).values())


def _flat(params: dict[str, np.ndarray], model: BlockModel) -> np.ndarray:
    groups = next(iter(params.values())).shape[0]
    return np.concatenate([params[k].reshape(groups, -1) for k in shapes(model)], axis=1)


def _unflat(p: np.ndarray, model: BlockModel) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes(model).items():
        n = int(np.prod(s))
        out[k] = p[:, at : at + n].reshape(len(p), *s)
        at += n
    return out


def _part(model: BlockModel, p: np.ndarray, scale: float = 1.0, coef: float | None = None) -> BlockModel:
    """The model of some blocks alone."""
    return BlockModel(model.kind, len(p), model.size, model.d, model.l0, model.coef if coef is None else coef, model.gain, model.bandwidth,
                      model.alpha, model.k_aux, model.dead_after, _unflat(p, model), scale)


def chunks_of(model: BlockModel) -> tuple[int, int]:
    """(blocks of a chunk, chunks)."""
    per = max(1, CHUNK_NUMBERS // _size(model))
    return per, -(-model.groups // per)


def _row(chunk: int, g: np.ndarray, p: np.ndarray) -> pd.DataFrame:
    zero = [np.zeros(p.shape[1])] * len(p)
    return pd.DataFrame({"chunk": chunk, "g": g, "p": list(p), "m": zero, "v": zero, "silent": 0, "l0": 0.0, "penalty": 0.0, "norm_sum": 0.0, "window": 0.0})


def fresh_state(spark: SparkSession, model: BlockModel, seed: int = 0) -> DataFrame:
    """The state a run starts from; a block's numbers depend on (seed, block) alone.

    Parameters that ``model`` holds already are taken as they are.
    """
    per, n_chunks = chunks_of(model)
    given = _flat(model.params, model) if model.params else None

    def make(batches):
        for pdf in batches:
            for chunk in pdf["id"]:
                g = np.arange(chunk * per, min((chunk + 1) * per, model.groups))
                if given is not None:
                    yield _row(chunk, g, given[g])
                    continue
                dec = np.stack([np.random.default_rng([seed, int(i)]).standard_normal((model.size, model.d)) for i in g])
                if model.kind == "tied":
                    parts = {"B": dec.transpose(0, 2, 1), "gamma": np.ones(len(g))}
                else:
                    dec /= np.sqrt((dec * dec).sum(axis=(1, 2), keepdims=True))
                    parts = {"D": dec, "W": dec, "b": np.zeros(dec.shape[:2]), "raw": np.zeros(len(g)), "log_theta": np.full(len(g), -2.0)}
                yield _row(chunk, g, _flat(parts, model))

    return spark.range(0, n_chunks, 1, n_chunks).mapInPandas(make, STATE)


def _ordered(pdf: pd.DataFrame, by: str) -> pd.DataFrame:
    return pdf.sort_values(by, kind="stable")


def _stack(column) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64)


def noisy(rows: DataFrame, snr: float, std: float, seed: int) -> DataFrame:
    """(slot, x, xin): noise depends on the row, not on where it is computed."""
    if not snr:
        return rows.select("slot", "x", F.col("x").alias("xin"))

    def add(batches):
        for pdf in batches:
            if len(pdf):
                x = _stack(pdf["x"])
                eps = np.stack([np.random.default_rng([seed, int(t)]).standard_normal(x.shape[1]) for t in pdf["token_id"]])
                yield pd.DataFrame({"slot": pdf["slot"], "x": list(x), "xin": list(x + snr * std * eps)})

    return rows.select("slot", "token_id", "x").mapInPandas(add, "slot int, x array<double>, xin array<double>")


def _each_chunk(rows: DataFrame, n_chunks: int) -> DataFrame:
    """The batch once for every chunk: chunks times a batch, whatever the table's size."""
    return rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))


def gates(state: DataFrame, rows: DataFrame, model: BlockModel, scale: float, n_dead: int) -> DataFrame:
    """GATES of a batch (slot, xin): the blocks of every row that pass, and the dead ones to revive."""
    k_aux = min(model.k_aux or model.l0, n_dead) if model.alpha and model.kind != "tied" else 0

    def meet(blocks: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"chunk": [], "slot": [], "g": [], "aux": [], "norm": [], "code": []})
        if not len(blocks) or not len(batch):
            return empty
        blocks, batch = _ordered(blocks, "g"), _ordered(batch, "slot")
        part = _part(model, _stack(blocks["p"]), scale)
        a = part.preact(_stack(batch["xin"]))
        n = _norms(a)
        on = part.passes(a, n)  # of a top-k gate: candidates, the best of this chunk
        g, slot, out = blocks["g"].to_numpy(), batch["slot"].to_numpy(), []
        dead = (blocks["silent"] > model.dead_after).to_numpy()
        pick = _topk(np.where(dead, n, -np.inf), k_aux) & dead if k_aux else np.zeros_like(on)
        for aux, mask, code in ((False, on, part.code(a, on)), (True, pick, a)):
            r, c = np.nonzero(mask)
            out.append(pd.DataFrame({"chunk": blocks["chunk"].iloc[0], "slot": slot[r], "g": g[c], "aux": aux, "norm": n[r, c], "code": list(code[r, c])}))
        return pd.concat(out)

    per_chunk = _each_chunk(rows.select("slot", "xin"), chunks_of(model)[1])
    found = state.select("chunk", "g", "p", "silent").groupBy("chunk").cogroup(per_chunk.groupBy("chunk")).applyInPandas(meet, GATES)
    limit = F.when(F.col("aux"), F.lit(k_aux))
    if model.kind in ("free", "tied"):
        limit = limit.otherwise(F.lit(model.l0))
    elif not k_aux:
        return found
    rank = F.row_number().over(W.partitionBy("slot", "aux").orderBy(F.col("norm").desc(), "g"))
    return found.withColumn("rank", rank).where(limit.isNull() | (F.col("rank") <= limit)).drop("rank")


def errors(state: DataFrame, gated: DataFrame, rows: DataFrame, model: BlockModel, batch: int) -> DataFrame:
    """ERRORS of a batch (slot, x, xin), from the codes that passed."""
    d = model.d

    def decode(blocks: pd.DataFrame, codes: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks) or not len(codes):
            return pd.DataFrame({"slot": [], "aux": [], "part": []})
        blocks = _ordered(blocks, "g")
        dec = _stack(blocks["dec"])
        if model.kind == "tied":
            atoms = np.linalg.qr(dec.reshape(-1, d, model.size))[0].transpose(0, 2, 1)
        else:
            atoms = dec.reshape(-1, model.size, d)
        out = []
        for aux in (False, True):
            own = codes[codes["aux"] == aux]
            if len(own):
                slots, at = np.unique(own["slot"].to_numpy(), return_inverse=True)
                z = np.zeros((len(slots), len(blocks), model.size))
                z[at, np.searchsorted(blocks["g"].to_numpy(), own["g"].to_numpy())] = _stack(own["code"])
                out.append(pd.DataFrame({"slot": slots, "aux": aux, "part": list(np.einsum("ngk,gkd->nd", z, atoms))}))
        return pd.concat(out)

    def add(parts: pd.DataFrame, batch_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(batch_rows):
            return pd.DataFrame({"slot": [], "xin": [], "e": [], "e2": [], "err": [], "aux": []})
        batch_rows = _ordered(batch_rows, "slot")
        slots, sums = batch_rows["slot"].to_numpy(), np.zeros((2, len(batch_rows), d))
        for aux in (False, True):
            own = _ordered(parts[parts["aux"] == aux], "chunk")
            if len(own):
                np.add.at(sums[int(aux)], np.searchsorted(slots, own["slot"].to_numpy()), _stack(own["part"]))
        e = sums[0] - _stack(batch_rows["x"])
        e2 = sums[1] + e
        return pd.DataFrame({"slot": slots, "xin": batch_rows["xin"].to_list(), "e": list(e), "e2": list(e2), "err": (e * e).sum(axis=1), "aux": (e2 * e2).sum(axis=1)})

    n_dec = model.size * d
    blocks = state.select("chunk", "g", F.slice("p", 1, n_dec).alias("dec"))

    def keyed(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return decode(left, right).assign(chunk=key[0])

    parts = blocks.groupBy("chunk").cogroup(gated.select("chunk", "slot", "g", "aux", "code").groupBy("chunk")).applyInPandas(keyed, "slot int, aux boolean, part array<double>, chunk int")
    bucket = (F.col("slot") / BUCKET_ROWS).cast("int").alias("bucket")
    return parts.select("*", bucket).groupBy("bucket").cogroup(rows.select("slot", "x", "xin", bucket).groupBy("bucket")).applyInPandas(add, ERRORS)


@dataclass
class _Chunk:
    """A chunk of the state, its blocks in order."""

    chunk: np.ndarray
    g: np.ndarray
    p: np.ndarray
    m: np.ndarray
    v: np.ndarray
    silent: np.ndarray
    l0: float = 0.0
    penalty: float = 0.0
    norm_sum: np.ndarray | float = 0.0
    window: np.ndarray | float = 0.0

    @classmethod
    def of(cls, blocks: pd.DataFrame) -> "_Chunk":
        return cls(blocks["chunk"].to_numpy(), blocks["g"].to_numpy(), *(_stack(blocks[c]) for c in "pmv"), blocks["silent"].to_numpy())

    def learn(self, part: BlockModel, model: BlockModel, x: np.ndarray, a: np.ndarray, on: np.ndarray, e: np.ndarray, batch: int, t: int, rate: float,
              pick: np.ndarray | None, e2: np.ndarray | None, b1: float = 0.9, b2: float = 0.999) -> None:
        """A step of these blocks, ``part``, given the errors of the whole dictionary."""
        info, grad = part.grad_of(x, a, on, e, batch, pick, e2)
        n = _norms(a)
        fired = (_norms(part.code(a, on)) > 1e-6).any(axis=0) if model.kind == "soft" else on.any(axis=0)
        dp = _flat(grad, model)
        self.m = b1 * self.m + (1 - b1) * dp
        self.v = b2 * self.v + (1 - b2) * dp * dp
        self.norm_sum, self.window = n.sum(axis=0), part.window(n).mean(axis=0) if model.kind == "threshold" else 0.0
        part.params = _unflat(self.p - rate * (self.m / (1 - b1**t)) / (np.sqrt(self.v / (1 - b2**t)) + 1e-8), model)
        part.renormalise()
        self.p, self.silent = _flat(part.params, model), np.where(fired, 0, self.silent + batch)
        self.l0, self.penalty = info["l0"], info["penalty"]

    def table(self) -> pd.DataFrame:
        first = np.arange(len(self.g)) == 0
        return pd.DataFrame({
            "chunk": self.chunk, "g": self.g, "p": list(self.p), "m": list(self.m), "v": list(self.v), "silent": self.silent,
            "l0": np.where(first, self.l0, 0.0), "penalty": np.where(first, self.penalty, 0.0), "norm_sum": self.norm_sum, "window": self.window})


def _moved(scale: float, norm: float, step: int, target_l0: float | None, momentum: float) -> float:
    """The norms' scale of a threshold gate after a step."""
    return norm if step == 0 and target_l0 is None else max(momentum * scale + (1 - momentum) * norm, 1e-6)


def run_of_steps(state: DataFrame, rows: DataFrame, model: BlockModel, done: dict, batch: int, rate: float, snr: float, std: float, seed: int, target_l0: float | None, momentum: float) -> DataFrame:
    """The state after all steps of ``rows``, those after ``done`` in a row, of a dictionary of one chunk; ``log`` of its first row holds their records."""
    first, scale_now, coef, dead_now = done["step"] + 1, done["scale"], done["coef"], done["dead"]

    def run(blocks: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        own, log, scale, n_dead = _Chunk.of(_ordered(blocks, "g")), [], scale_now, dead_now
        for at, (_, rows_) in enumerate(given.groupby("step", sort=True)):
            step, rows_ = first + at, _ordered(rows_, "slot")
            x = _stack(rows_["x"])
            xin = x
            if snr:
                xin = x + snr * std * np.stack([np.random.default_rng([seed + 7919 * (step + 1), int(t)]).standard_normal(x.shape[1]) for t in rows_["token_id"]])
            part = _part(model, own.p, scale, coef)
            a = part.preact(xin)
            n = _norms(a)
            on = part.passes(a, n)
            e = part.decode(part.code(a, on)) - x
            pick = e2 = None
            dead = own.silent > model.dead_after
            k_aux = min(model.k_aux or model.l0, n_dead) if model.alpha and model.kind != "tied" else 0
            if k_aux:
                pick = _topk(np.where(dead, n, -np.inf), k_aux) & dead
                e2 = part.decode(a * pick[:, :, None]) + e
            own.learn(part, model, xin, a, on, e, batch, step + 1, rate, pick, e2)
            recon, aux = float((e * e).sum()) / (batch * model.d), 0.0 if e2 is None else model.alpha * float((e2 * e2).sum()) / (batch * model.d)
            n_dead = int((own.silent > model.dead_after).sum())
            if model.kind == "threshold":
                scale = _moved(scale, float(own.norm_sum.sum()) / (batch * model.groups), step, target_l0, momentum)
            log.append({"step": step, "recon": recon, "l0": own.l0, "penalty": own.penalty, "aux": aux, "loss": recon + own.penalty + aux, "dead": n_dead, "scale": scale, "coef": coef})
        return own.table().assign(log=[json.dumps(log)] + [None] * (len(own.g) - 1))

    here = rows.select(F.lit(0).alias("chunk"), "step", "slot", "token_id", "x")
    old = state.select("chunk", "g", "p", "m", "v", "silent")
    return old.groupBy("chunk").cogroup(here.groupBy("chunk")).applyInPandas(run, STATE + ", log string")


def update(state: DataFrame, gated: DataFrame, errs: DataFrame, model: BlockModel, batch: int, t: int, rate: float, scale: float, coef: float, b1: float = 0.9, b2: float = 0.999) -> DataFrame:
    """The next state; ``t`` counts steps from 1."""
    revive = bool(model.alpha) and model.kind != "tied"

    def learn(blocks: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        own = _Chunk.of(_ordered(blocks, "g"))
        part = _part(model, own.p, scale, coef)
        is_row = given["g"].to_numpy() < 0
        rows, gate = _ordered(given[is_row], "slot"), given[~is_row]
        x, e = _stack(rows["xin"]), _stack(rows["e"])
        a = part.preact(x)
        masks = np.zeros((2, len(x), len(own.g)), dtype=bool)
        masks[gate["aux"].to_numpy().astype(int), np.searchsorted(rows["slot"].to_numpy(), gate["slot"].to_numpy()), np.searchsorted(own.g, gate["g"].to_numpy())] = True
        on, pick = masks
        has_pick = revive and pick.any()
        own.learn(part, model, x, a, on, e, batch, t, rate, pick if has_pick else None, _stack(rows["e2"]) if has_pick else None, b1, b2)
        return own.table()

    rows = _each_chunk(errs.select("slot", "xin", "e", *(["e2"] if revive else [])), chunks_of(model)[1]).withColumns({"g": F.lit(-1), "aux": F.lit(False)})
    both = rows.unionByName(gated.select("chunk", "slot", "g", "aux"), allowMissingColumns=True)
    old = state.select("chunk", "g", "p", "m", "v", "silent")
    return old.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInPandas(learn, STATE)


@dataclass
class Run:
    """The folder of a run: two places for the state, scratch tables, records, the epoch's rows."""

    spark: SparkSession
    path: str

    def records(self) -> list[dict]:
        """Numbers of the steps that are done, in order; the first is that of step -1."""
        try:
            rows = self.spark.read.schema("record string").parquet(f"{self.path}/done").collect()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        return sorted((json.loads(r["record"]) for r in rows), key=lambda r: r["step"])

    def seal(self, *records: dict) -> None:
        """Records of steps that are done in one job, under the last one's number."""
        made = self.spark.createDataFrame([(json.dumps(r),) for r in records], "record string").coalesce(1)
        made.write.mode("overwrite").parquet(f"{self.path}/done/step={records[-1]['step']}")

    def state(self, step: int) -> DataFrame:
        return self.spark.read.schema(STATE).parquet(f"{self.path}/state-{step % 2}")

    def put_state(self, df: DataFrame, step: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/state-{step % 2}")
        return self.state(step)

    def log(self, step: int) -> str:
        """Records of the run of steps that ended with the state of ``step``."""
        return self.spark.read.schema("log string").parquet(f"{self.path}/state-{step % 2}").where("log is not null").first()["log"]

    def scratch(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def epoch(self, acts: DataFrame, batch: int, seed: int, epoch: int) -> DataFrame:
        """An epoch's rows in folders of a few steps each, so that a step reads its own."""
        rows = epoch_batches(acts.select("token_id", "x"), batch, seed, epoch, slot="slot")
        rows = rows.select("token_id", "x", F.col("step").cast("long").alias("step"), "slot", F.expr(f"cast(step div {PART_STEPS} as int)").alias("part"))
        path = f"{self.path}/rows"
        rows.write.mode("overwrite").partitionBy("part").parquet(path)
        return self.spark.read.schema("token_id long, x array<double>, step long, slot int, part int").parquet(path)


def _step_rows(rows: DataFrame, step: int, n: int = 1) -> DataFrame:
    """Rows of ``n`` steps from ``step`` on."""
    last = step + n - 1
    return rows.where(F.col("part").between(step // PART_STEPS, last // PART_STEPS) & F.col("step").between(step, last))


def _at_once(model: BlockModel, batch: int, left: int) -> int:
    """Steps of the next job.  Odd, so that the last one's place is not that of the state it begins with."""
    n = 1 if chunks_of(model)[1] > 1 else max(1, min(left, PART_STEPS, RUN_NUMBERS // (batch * model.d)))
    return n - 1 + n % 2


def _deviation(acts: DataFrame) -> float:
    """Sample standard deviation of all numbers, a row's sums at a time."""
    total = lambda f: F.aggregate("x", F.lit(0.0), f)
    one = acts.agg(F.sum(F.size("x")).alias("n"), F.sum(total(lambda s, v: s + v)).alias("s")).first()
    mean = one["s"] / one["n"]
    square = acts.agg(F.sum(total(lambda s, v: s + (v - mean) * (v - mean)))).first()[0]
    return float(np.sqrt(square / max(one["n"] - 1, 1)))


def report(run: Run, state: DataFrame, rows: DataFrame, model: BlockModel, batch: int, steps: int, scale: float) -> dict[str, float]:
    """R2 about each batch's mean, mean L0 and blocks that never fired, over the first ``steps`` batches without noise."""
    res = tot = active = 0.0
    fired = None
    for step in range(steps):
        clean = noisy(_step_rows(rows, step), 0.0, 0.0, 0)
        gated = run.scratch(gates(state, clean, model, scale, 0), f"report-gates-{step}")
        res += errors(state, gated, clean, model, batch).agg(F.sum("err")).first()[0]
        norm = F.sqrt(F.aggregate("code", F.lit(0.0), lambda s, v: s + v * v))
        on = gated.where(norm > 1e-6).select("g")
        active += on.count()
        fired = on if fired is None else fired.unionByName(on)

        def sums(batches):
            for pdf in batches:
                if len(pdf):
                    x = _stack(pdf["x"])
                    yield pd.DataFrame({"sq": [float((x * x).sum())], "s": [x.sum(axis=0)]})

        parts = clean.select("x").mapInPandas(sums, "sq double, s array<double>").toPandas()
        tot += parts["sq"].sum() - float(np.square(_stack(parts["s"]).sum(axis=0)).sum()) / batch
    return {"r2": float(1 - res / max(tot, 1e-12)), "eval_l0": active / (steps * batch), "unfired": model.groups - fired.distinct().count()}


def train_blocks(acts: DataFrame, model: BlockModel, path: str, epochs: int = 40, batch: int = 2048, rate: float = 4e-4, snr: float = 0.1, seed: int = 0,
                 target_l0: float | None = None, control: Callable[[float], float] | None = None, momentum: float = 0.99, log_every: int = 5, eval_steps: int = 10,
                 max_steps: int | None = None) -> tuple[DataFrame, list[dict]]:
    """Train on ``acts`` (token_id, x) with all parameters in tables under ``path``; (state, records).

    The same steps as ``train.fit``.  ``path`` is a shared folder; where it holds records of
    the same settings the run goes on after the last one.  ``target_l0`` starts a threshold
    gate from the norms of the first batch.  ``control`` turns a step's L0 into the next
    coefficient; it is fed the L0 of recorded steps when a run goes on.  ``max_steps`` ends
    this call early.  Records of reported epochs (the first, the last, every ``log_every``)
    hold R2, L0, blocks that never fired, and for thresholds the kernel window's share and
    stranded blocks; ``off_target`` marks an L0 more than twice off.  Fewer rows than a batch
    are an error; rows have distinct token ids.
    """
    spark, run = acts.sparkSession, Run(acts.sparkSession, path.rstrip("/"))
    settings = {"kind": model.kind, "groups": model.groups, "size": model.size, "d": model.d, "l0": model.l0, "alpha": model.alpha, "k_aux": model.k_aux, "dead_after": model.dead_after,
                "gain": model.gain, "bandwidth": model.bandwidth, "batch": batch, "rate": rate, "snr": snr, "seed": seed, "target_l0": target_l0, "momentum": momentum}
    records = run.records()
    if records and records[0]["settings"] != settings:
        raise ValueError(f"{path} holds a run of other settings: {records[0]['settings']}")
    if not records:
        n = acts.count()
        if n < batch:
            raise ValueError(f"{n} rows are less than one batch of {batch}")
        std = _deviation(acts) if snr else 0.0
        run.put_state(fresh_state(spark, model, seed), -1)
        first = {"step": -1, "settings": settings, "n": n, "std": std, "scale": model.norm_scale, "coef": model.coef, "dead": 0}
    else:
        first = records[0]
        n, std = first["n"], first["std"]
    per_epoch, at, rows = n // batch, -1, None
    if not records:
        if model.kind == "threshold" and target_l0 is not None:
            rows, at = run.epoch(acts, batch, seed, 0), 0
            first["scale"] = _warm_up(run, noisy(_step_rows(rows, 0), snr, std, seed), model, target_l0)
        run.seal(first)
        records = [first]
    if control is not None:
        for r in records[1:]:
            control(r["l0"])
    done = records[-1]
    stop = epochs * per_epoch if max_steps is None else min(epochs * per_epoch, done["step"] + 1 + max_steps)
    step = done["step"]
    while step + 1 < stop:
        epoch, in_epoch = divmod(step + 1, per_epoch)
        if at != epoch:
            rows, at = run.epoch(acts, batch, seed, epoch), epoch
        state, scale, coef = run.state(step), done["scale"], done["coef"]
        # What is fed every step's L0 is asked between steps.
        n_steps = _at_once(model, batch, min(stop - 1 - step, per_epoch - in_epoch)) if control is None else 1
        given = _step_rows(rows, in_epoch, n_steps)
        step, in_epoch = step + n_steps, in_epoch + n_steps - 1
        if chunks_of(model)[1] == 1:
            new = run.put_state(run_of_steps(state, given, model, done, batch, rate, snr, std, seed, target_l0, momentum), step)
            made = [{**r, "epoch": epoch} for r in json.loads(run.log(step))]
            if control is not None:
                made[-1]["coef"] = control(made[-1]["l0"])
            done, scale = made[-1], made[-1]["scale"]
        else:
            made = []
            given = noisy(given, snr, std, seed + 7919 * (step + 1))
            gated = run.scratch(gates(state, given, model, scale, done["dead"]), "gates")
            errs = run.scratch(errors(state, gated, given, model, batch), "errors")
            new = run.put_state(update(state, gated, errs, model, batch, step + 1, rate, scale, coef), step)
            s = new.agg(F.sum("l0").alias("l0"), F.sum("penalty").alias("penalty"), (F.sum("norm_sum") / (batch * model.groups)).alias("norm"),
                        F.count_if(F.col("silent") > model.dead_after).alias("dead")).first()
            e = errs.agg((F.sum("err") / (batch * model.d)).alias("recon"), (F.sum("aux") / (batch * model.d)).alias("aux")).first()
            aux = model.alpha * e["aux"] if model.alpha and model.kind != "tied" and done["dead"] else 0.0
            if model.kind == "threshold":
                scale = _moved(scale, s["norm"], step, target_l0, momentum)
            done = {"step": step, "epoch": epoch, "recon": e["recon"], "l0": s["l0"], "penalty": s["penalty"], "aux": aux, "loss": e["recon"] + s["penalty"] + aux,
                    "dead": s["dead"], "scale": scale, "coef": control(s["l0"]) if control is not None else coef}
            made.append(done)
        if in_epoch == per_epoch - 1 and (epoch in (0, epochs - 1) or (epoch + 1) % log_every == 0):
            done |= report(run, new, rows, model, batch, min(eval_steps, per_epoch), scale)
            target = target_l0 or (model.l0 if model.kind in ("free", "tied") else None)
            done["off_target"] = bool(target and not target / 2 <= done["eval_l0"] <= 2 * target)
            if model.kind == "threshold":
                done |= new.agg(F.avg("window").alias("in_window"), F.count_if(F.col("window") < STRANDED).alias("stranded")).first().asDict()
        run.seal(*made)
        records += made
    return run.state(done["step"]), records[1:]


def _warm_up(run: Run, given: DataFrame, model: BlockModel, target_l0: float) -> float:
    """Thresholds where about ``target_l0`` blocks of the batch pass; returns the norms' scale."""
    state = run.state(-1)

    def norms(blocks: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks) or not len(batch):
            return pd.DataFrame({"act": []})
        return pd.DataFrame({"act": _norms(_part(model, _stack(blocks["p"])).preact(_stack(batch["xin"]))).ravel()})

    per_chunk = _each_chunk(given.select("xin"), chunks_of(model)[1])
    acts = state.select("chunk", "p").groupBy("chunk").cogroup(per_chunk.groupBy("chunk")).applyInPandas(norms, "act double")
    one = theta_init(acts, target_l0, model.groups, model.gain).first()
    # The threshold is the last number of a block.
    raw = F.concat(F.slice("p", 1, _size(model) - 1), F.array(F.lit(float(one["raw_theta"]))))
    started = run.scratch(state.withColumn("p", raw), "warm-up")
    run.put_state(started, -1)
    return float(one["scale"])


def dictionary(state: DataFrame, model: BlockModel) -> DataFrame:
    """(g, j, dec, enc, bias, theta) of a state: the checkpoint table of a dictionary of any size."""

    def rows(batches):
        for pdf in batches:
            for g, flat in zip(pdf["g"], pdf["p"]):
                one = _part(model, np.asarray(flat, dtype=np.float64)[None])
                atoms = one.atoms()[0]
                tied = model.kind == "tied"
                enc = atoms * one.params["gamma"][0] if tied else one.params["W"][0]
                bias = np.zeros(model.size) if tied else one.params["b"][0]
                theta = float(one.thresholds()[0])
                yield pd.DataFrame({"g": g, "j": range(model.size), "dec": list(atoms), "enc": list(enc), "bias": bias, "theta": theta})

    return state.select("g", "p").mapInPandas(rows, "g int, j int, dec array<double>, enc array<double>, bias double, theta double")
