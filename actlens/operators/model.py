"""The shared top-k code as a model: its weights, what they encode and decode, its losses and their gradients.

Everything here is NumPy on one batch of rows; ``train``, ``recon`` and ``code`` apply it to Arrow batches on the executors.
With a ``rank`` the streams share two inner factors, so that a stream has ``rank`` x (dims) weights of its own each way.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession

from actlens.operators.code import top_k

KINDS = ("encoder", "decoder", "encoder_in", "decoder_out", "pre_bias", "latent_bias", "encoder_shared", "decoder_shared")
FLOOR = 1e-8


def slug(name: str) -> str:
    return name.translate(str.maketrans("./-", "___"))


@dataclass
class Model:
    """Encoders latents x dims, decoders dims x latents, biases and input scales of each stream, in order.

    With ``rank``, ``encoder_shared`` (latents x rank) and ``decoder_shared`` (rank x latents) stand between
    ``encoder_in.<stream>`` (rank x dims) and ``decoder_out.<stream>`` (dims x rank). ``auxk`` latents that have been silent
    for more than ``dead_after`` batches learn to decode what the code leaves over; 0 is without that loss.
    """

    streams: dict[str, int]
    latents: int
    k: int
    params: dict[str, np.ndarray] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    last_non_zero: dict[str, np.ndarray] = field(default_factory=dict)
    rank: int = 0
    auxk: int = 0
    dead_after: int = 1000

    @classmethod
    def create(cls, streams: dict[str, int], latents: int, k: int, seed: int = 0, rank: int = 0, auxk: int = 0, dead_after: int = 1000) -> Model:
        if len({slug(n) for n in streams}) < len(streams):
            raise ValueError("two names give one parameter name")
        rng, m = np.random.default_rng(seed), cls(dict(streams), latents, k, rank=rank, auxk=auxk, dead_after=dead_after)
        if rank:
            e = rng.standard_normal((latents, rank)) / np.sqrt(rank)
            m.params |= {"encoder_shared": e, "decoder_shared": e.T.copy()}
        for n, d in streams.items():
            e = rng.standard_normal((rank or latents, d)) / np.sqrt(d)
            m.params |= {f"encoder_in.{n}": e, f"decoder_out.{n}": e.T.copy()} if rank else {f"encoder.{n}": e, f"decoder.{n}": e.T.copy()}
            m.params |= {f"pre_bias.{n}": np.zeros(d), f"latent_bias.{n}": np.zeros(latents)}
            m.scale[n], m.last_non_zero[n] = 1.0, np.zeros(latents, np.int64)
        m.normalise()
        return m

    @classmethod
    def of_weights(cls, encoders: dict[str, np.ndarray], decoders: dict[str, np.ndarray], k: int, **how) -> Model:
        """A model of given weights, without biases and scales."""
        m = cls({n: e.shape[1] for n, e in encoders.items()}, next(iter(encoders.values())).shape[0], k, **how)
        for n, d in m.streams.items():
            m.params |= {f"encoder.{n}": encoders[n], f"decoder.{n}": decoders[n], f"pre_bias.{n}": np.zeros(d), f"latent_bias.{n}": np.zeros(m.latents)}
            m.scale[n], m.last_non_zero[n] = 1.0, np.zeros(m.latents, np.int64)
        return m

    def normalise(self) -> None:
        for n in self.streams if not self.rank else ():
            d = self.params[f"decoder.{n}"]
            d /= np.linalg.norm(d, axis=0) + FLOOR

    def scaled(self, x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {n: v * self.scale[n] for n, v in x.items()}

    def logits(self, scaled: np.ndarray, name: str) -> np.ndarray:
        p, x = self.params, scaled - self.params[f"pre_bias.{name}"]
        x = x @ p[f"encoder_in.{name}"].T @ p["encoder_shared"].T if self.rank else x @ p[f"encoder.{name}"].T
        return x + p[f"latent_bias.{name}"]

    def encode(self, x: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, dict[str, np.ndarray]]:
        """(scaled inputs, gate indices, dense gated codes)."""
        scaled = self.scaled(x)
        logits = {n: self.logits(v, n) for n, v in scaled.items()}
        gate = top_k(sum(logits.values()), self.k)
        return scaled, gate, {n: gated(v, gate) for n, v in logits.items()}

    def decode(self, z: np.ndarray, name: str) -> np.ndarray:
        """In scaled space; ``/ scale[name]`` gives values as they came."""
        p = self.params
        out = z @ p["decoder_shared"].T @ p[f"decoder_out.{name}"].T if self.rank else z @ p[f"decoder.{name}"].T
        return out + p[f"pre_bias.{name}"]

    def auxiliary(self, scaled: np.ndarray, recon: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
        """(codes, target): the ``auxk`` largest logits, those of live latents counting as 0, and what they should decode to.

        The target is what ``recon``, the stream's own reconstruction, leaves over, and the bias; both are taken as given.
        """
        masked = self.logits(scaled, name) * (self.last_non_zero[name] > self.dead_after)
        return gated(masked, top_k(masked, self.auxk)), scaled - recon + self.params[f"pre_bias.{name}"]

    def _back_decode(self, grads: dict[str, np.ndarray], g: np.ndarray, z: np.ndarray, name: str) -> np.ndarray:
        """Adds the decoder's gradients for ``g``, the loss by the output; returns the loss by the codes."""
        p = self.params
        grads[f"pre_bias.{name}"] += g.sum(axis=0)
        if not self.rank:
            grads[f"decoder.{name}"] += g.T @ z
            return g @ p[f"decoder.{name}"]
        inner = g @ p[f"decoder_out.{name}"]
        grads[f"decoder_out.{name}"] += g.T @ (z @ p["decoder_shared"].T)
        grads["decoder_shared"] += inner.T @ z
        return inner @ p["decoder_shared"]

    def _back_encode(self, grads: dict[str, np.ndarray], d: np.ndarray, scaled: np.ndarray, name: str) -> None:
        p, x = self.params, scaled - self.params[f"pre_bias.{name}"]
        grads[f"latent_bias.{name}"] += d.sum(axis=0)
        if self.rank:
            inner = d @ p["encoder_shared"]
            grads["encoder_shared"] += d.T @ (x @ p[f"encoder_in.{name}"].T)
            grads[f"encoder_in.{name}"] += inner.T @ x
            grads[f"pre_bias.{name}"] -= (inner @ p[f"encoder_in.{name}"]).sum(axis=0)
        else:
            grads[f"encoder.{name}"] += d.T @ x
            grads[f"pre_bias.{name}"] -= (d @ p[f"encoder.{name}"]).sum(axis=0)

    def loss_and_gradients(self, x: dict[str, np.ndarray], cross: float = 1.0, aux: float = 1 / 32) -> tuple[float, dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Summed over rows: loss, gradients; and which latents fired.

        The loss is the mean of self NMSEs in scaled space, ``cross`` times the mean of cross NMSEs, which are
        of unscaled values and so, a row's scale cancelling out, the same ratio, and with ``auxk`` also ``aux`` times the
        mean of the streams' auxiliary NMSEs.
        """
        names = list(self.streams)
        scaled, _, z = self.encode(x)
        grads = {k: np.zeros_like(v) for k, v in self.params.items()}
        dz = {n: np.zeros_like(z[n]) for n in names}
        own = {n: self.decode(z[n], n) for n in names}
        loss, n_cross = 0.0, max(1, len(names) * (len(names) - 1))
        for s in names:
            for t in names:
                share = 1 / len(names) if s == t else cross / n_cross
                part, g = nmse_and_gradient(own[s] if s == t else self.decode(z[s], t), scaled[t])
                loss += share * part
                dz[s] += self._back_decode(grads, share * g, z[s], t)
        for n in names:
            d = dz[n] * (z[n] > 0)
            if self.auxk:
                codes, target = self.auxiliary(scaled[n], own[n], n)
                part, g = nmse_and_gradient(self.decode(codes, n), target)
                loss += aux / len(names) * part
                d += self._back_decode(grads, aux / len(names) * g, codes, n) * (codes > 0)  # live ones' codes are 0
            self._back_encode(grads, d, scaled[n], n)
        return loss, grads, {n: z[n].max(axis=0) if len(z[n]) else np.zeros(self.latents) for n in names}

    def to_rows(self) -> list[tuple]:
        out = [(k, list(v.shape), v.reshape(-1).tolist()) for k, v in self.params.items()]
        out += [(f"input_scale.{n}", [1], [float(v)]) for n, v in self.scale.items()]
        return out + [(f"last_non_zero.{n}", [len(v)], [float(y) for y in v]) for n, v in self.last_non_zero.items()]

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.to_rows(), "name string, shape array<int>, value array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, k: int, names: list[str] | None = None, **how) -> Model:
        """Streams, sizes and rank come from the shapes; encoders of differing latents are an error.

        ``names`` picks streams, in that order; one that the checkpoint lacks is an error.
        """
        rows = {r.name: np.array(r.value).reshape(r.shape) for r in spark.read.parquet(path).collect()}
        rank = rows["encoder_shared"].shape[1] if "encoder_shared" in rows else 0
        prefix = "encoder_in." if rank else "encoder."
        encoders = {n.removeprefix(prefix): v for n, v in rows.items() if n.startswith(prefix)}
        if unknown := [n for n in names or () if n not in encoders]:
            raise ValueError(f"no encoders of {unknown} in the checkpoint; there are {sorted(encoders)}")
        encoders = {n: encoders[n] for n in names or encoders}
        if len({v.shape[0] for v in encoders.values()}) != 1:
            raise ValueError("the streams differ in their number of latents")
        latents = rows["encoder_shared"].shape[0] if rank else next(iter(encoders.values())).shape[0]
        m = cls({n: v.shape[1] for n, v in encoders.items()}, latents, k, rank=rank, **how)
        m.params = {n: v for n, v in rows.items() if n.partition(".")[0] in KINDS and n.partition(".")[2] in ("", *encoders)}
        m.scale = {n: float(rows[f"input_scale.{n}"][0]) for n in encoders}
        m.last_non_zero = {n: rows[f"last_non_zero.{n}"].astype(np.int64) for n in encoders}
        return m


def gated(logits: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """Dense codes: clipped at 0 inside the gate, 0 outside."""
    out = np.zeros_like(logits)
    np.put_along_axis(out, gate, np.maximum(np.take_along_axis(logits, gate, axis=1), 0.0), axis=1)
    return out


def nmse_and_gradient(recon: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray]:
    """The rows' normalised errors, summed, and their gradient by ``recon``."""
    base = np.maximum((target**2).mean(axis=1), FLOOR)[:, None]
    err = recon - target
    return float(((err**2).mean(axis=1) / base[:, 0]).sum()), 2 * err / base / target.shape[1]


@dataclass
class Plain:
    """A plain autoencoder of one stream: ReLU codes with a bias, a linear decoder without, squared error and an L1 term."""

    dims: int
    latents: int
    l1: float = 1e-3
    params: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def create(cls, dims: int, latents: int, l1: float = 1e-3, seed: int = 0) -> Plain:
        rng = np.random.default_rng(seed)
        uniform = {"encoder": ((latents, dims), dims), "bias": ((latents,), dims), "decoder": ((dims, latents), latents)}
        return cls(dims, latents, l1, {k: rng.uniform(-1, 1, shape) / np.sqrt(n) for k, (shape, n) in uniform.items()})

    def loss_and_gradients(self, x: np.ndarray) -> tuple[tuple[float, float], dict[str, np.ndarray]]:
        """((squared error, codes) summed over rows, of a row's mean; gradients of error + l1 * codes)."""
        p = self.params
        z = np.maximum(x @ p["encoder"].T + p["bias"], 0.0)
        err = z @ p["decoder"].T - x
        g = 2 * err / self.dims
        d = (g @ p["decoder"] + self.l1 / self.latents) * (z > 0)
        grads = {"encoder": d.T @ x, "bias": d.sum(axis=0), "decoder": g.T @ z}
        return (float((err**2).mean(axis=1).sum()), float(z.mean(axis=1).sum())), grads

