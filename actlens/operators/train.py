"""Training the shared top-k code, and a plain autoencoder: distributed gradients, a driver that holds the weights.

A step sends the weights in the tasks' closure, lets every task sum up its rows' gradients in one pass, adds these up on
the executors in blocks of ``BLOCK`` weights, so that the driver gets each weight's gradient once, and applies AdamW. Decoder
columns keep unit norm: gradients lose their part along them before a step, and columns are normalised after it; low-rank
factors have no such norm. Latents that have been silent for long are started anew. Counters of silent latents run in every
step, validated epochs or not; the auxiliary loss of a step uses those of the step before, as which latents fire in a batch
is known after it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens.functions.vectors import rms
from actlens.operators.code import _matrix
from actlens.operators.model import Model, Plain

BLOCK = 1 << 16


def calibrate(model: Model, vectors: DataFrame) -> None:
    """Input scales: one over the lower median of the rows' root mean squares; without rows 1."""
    each = vectors.select(*[rms(F.col(f"x{i}")).alias(f"r{i}") for i in range(len(model.streams))])
    medians = each.selectExpr(*[f"percentile_disc(0.5) WITHIN GROUP (ORDER BY r{i}) AS m{i}" for i in range(len(model.streams))]).first()
    for i, n in enumerate(model.streams):
        model.scale[n] = 1.0 if medians[i] is None else 1.0 / max(float(medians[i]), 1e-8)


class AdamW:
    def __init__(self, rate: float = 3e-4, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8, decay: float = 0.01):
        self.rate, self.betas, self.eps, self.decay = rate, betas, eps, decay
        self.m: dict[str, np.ndarray] = {}
        self.v: dict[str, np.ndarray] = {}
        self.t = 0

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        a, b = self.betas
        for k, g in grads.items():
            self.m[k] = a * self.m.get(k, 0.0) + (1 - a) * g
            self.v[k] = b * self.v.get(k, 0.0) + (1 - b) * g * g
            params[k] *= 1 - self.rate * self.decay
            params[k] -= self.rate * (self.m[k] / (1 - a**self.t)) / (np.sqrt(self.v[k] / (1 - b**self.t)) + self.eps)


def add_up(batch: DataFrame, measure: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(sums, gradients, tops) of a batch: ``measure`` gives them for some rows; the first two are summed, the last is a maximum.

    Tasks add up their own rows; executors add up the tasks, each some blocks. None if the batch has no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = measure(b)
                total = part if total is None else (total[0] + part[0], total[1] + part[1], np.maximum(total[2], part[2]))
        if total is not None:
            sums, flat, top = total
            parts = [("grad", at, flat[at : at + BLOCK]) for at in range(0, len(flat), BLOCK)] + [("top", 0, top), ("sums", 0, sums)]
            for kind, at, values in parts:
                yield _row(kind, at, values)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            for kind, at, v in zip(b.column("kind").to_pylist(), b.column("at").to_pylist(), b.column("v"), strict=True):
                v = v.values.to_numpy()
                old = held.get((kind, at))
                held[kind, at] = v.copy() if old is None else np.maximum(old, v) if kind == "top" else old + v
        for (kind, at), v in held.items():
            yield _row(kind, at, v)

    schema = "kind string, at long, v array<double>"
    rows = batch.mapInArrow(run, schema).repartition("kind", "at").mapInArrow(merge, schema).collect()  # each weight once
    if not rows:
        return None
    got = {(r.kind, r.at): np.array(r.v) for r in rows}
    return got["sums", 0], np.concatenate([got[x] for x in sorted(got) if x[0] == "grad"]), got["top", 0]


def _row(kind: str, at: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([at], pa.int64()), pa.array([values], pa.list_(pa.float64()))], names=["kind", "at", "v"])


def _unpack(flat: np.ndarray, params: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, v in params.items():
        out[k] = flat[at : at + v.size].reshape(v.shape)
        at += v.size
    return out


def summed_gradients(model: Model, batch: DataFrame, cross: float, aux: float = 1 / 32) -> tuple[int, float, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Rows, mean loss and gradients, and each latent's largest code over a batch (x0, x1, ...)."""
    state, names = vars(model), list(model.streams)

    def measure(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = Model(**state)
        loss, grads, fired = m.loss_and_gradients({name: _matrix(b.column(f"x{i}")) for i, name in enumerate(names)}, cross, aux)
        return np.array([b.num_rows, loss]), np.concatenate([grads[k].reshape(-1) for k in m.params]), np.concatenate([fired[k] for k in names])

    got = add_up(batch, measure)
    if got is None:
        return 0, 0.0, {k: np.zeros_like(v) for k, v in model.params.items()}, {n: np.zeros(model.latents) for n in names}
    (n, loss), flat, top = got
    return int(n), loss / n, _unpack(flat / n, model.params), {name: top[i * model.latents : (i + 1) * model.latents] for i, name in enumerate(names)}


def reinit_dead(model: Model, threshold: int, rng: np.random.Generator) -> int:
    """Latents silent for more than ``threshold`` batches get a small random encoder row, no bias and a new count.

    Where the streams share factors, a latent dead in any of them gets one new row of the shared encoder.
    """
    gone, every = 0, set()
    for n in model.streams:
        dead = np.flatnonzero(model.last_non_zero[n] > threshold)
        every.update(dead.tolist())
        if not model.rank:
            model.params[f"encoder.{n}"][dead] = rng.standard_normal((len(dead), model.streams[n])) * 0.01
        model.params[f"latent_bias.{n}"][dead] = 0.0
        model.last_non_zero[n][dead] = 0
        gone += len(dead)
    if model.rank:
        model.params["encoder_shared"][sorted(every)] = rng.standard_normal((len(every), model.rank)) * 0.01
    return gone


def train(model: Model, batches: list[DataFrame], epochs: int = 1, rate: float = 3e-4, cross: float = 1.0, threshold: float = 1e-3, dead_after: int | None = None, reinit_every: int = 100, seed: int = 0, aux: float = 1 / 32) -> list[float]:
    """One step for each batch and epoch; returns the mean loss of each epoch. ``reinit_every`` 0 never starts latents anew."""
    adam, rng, step, out = AdamW(rate), np.random.default_rng(seed), 0, []
    for _ in range(epochs):
        losses = []
        for batch in batches:
            n, loss, grads, fired = summed_gradients(model, batch, cross, aux)
            if not n:
                continue
            for name in model.streams:
                if not model.rank:
                    w, g = model.params[f"decoder.{name}"], grads[f"decoder.{name}"]
                    grads[f"decoder.{name}"] = g - w * (w * g).sum(axis=0)
                model.last_non_zero[name] = np.where(fired[name] > threshold, 0, model.last_non_zero[name]) + 1
            adam.step(model.params, grads)
            model.normalise()
            step += 1
            if reinit_every and step % reinit_every == 0:
                reinit_dead(model, model.dead_after if dead_after is None else dead_after, rng)
            losses.append(loss)
        out.append(sum(losses) / max(len(losses), 1))
    return out


def train_plain(model: Plain, batches: list[DataFrame], steps: int = 1000, rate: float = 3e-4, column: str = "x0") -> list[tuple[float, float, float]]:
    """A fixed number of steps over batches that start again at their end; (loss, squared error, mean code) of each step."""
    adam, state, out, empty = AdamW(rate), vars(model), [], 0

    def measure(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = Plain(**state)
        sums, grads = m.loss_and_gradients(_matrix(b.column(column)))
        return np.array([b.num_rows, *sums]), np.concatenate([grads[k].reshape(-1) for k in m.params]), np.zeros(1)

    at = 0
    while len(out) < steps:
        if empty >= len(batches):
            raise ValueError("no batch has rows")
        got = add_up(batches[at % len(batches)], measure)
        at += 1
        if got is None:
            empty += 1
            continue
        (n, error, codes), flat, _ = got
        adam.step(model.params, _unpack(flat / n, model.params))
        out.append((error / n + model.l1 * codes / n, error / n, codes / n))
        empty = 0
    return out
