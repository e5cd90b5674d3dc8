"""Reconstruction from codes: self and cross decoding, losses, fraction of variance unexplained."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens.operators.code import _matrix, matrices, top_k
from actlens.operators.model import Model, nmse_and_gradient
from actlens.operators.streams import LATENTS, STREAMS, TOP_K, weight

#: Makes decoded values of the closed-form weights comparable to the inputs.
DECODE_SCALE = 1.0 / (498.0 * 498.0 * 64.0)
SUMS = "source int, target int, dim int, n long, nmse double, res double, s double, ss double"


def closed_form(k: int = TOP_K, latents: int = LATENTS, **how) -> Model:
    """The closed-form weights as a model: the decoder is the transposed encoder times ``DECODE_SCALE``."""
    w = {s.name: weight(i, latents) for i, s in enumerate(STREAMS)}
    return Model.of_weights(w, {n: e.T * DECODE_SCALE for n, e in w.items()}, k, **how)


def loss_sums(vectors: DataFrame, model: Model | None = None) -> DataFrame:
    """For each task, ordered pair of streams (each with itself included) and dimension of the target: mergeable sums.

    ``n`` positions; ``res`` the squared residuals of what ``source``'s codes decode to, ``s`` and ``ss`` the target's
    values and their squares, all as they came, unscaled. ``nmse``, the sum of the positions' normalised errors, stands at
    dimension 0 and is 0 elsewhere. A row without active codes decodes to the bias. Nothing of a position's size leaves the
    task.
    """
    state = vars(model or closed_form())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**state)
        names, dims = list(m.streams), list(m.streams.values())
        res = {(s, t): np.zeros(dims[t]) for s in range(len(dims)) for t in range(len(dims))}
        one, two, nmse, n = [np.zeros(d) for d in dims], [np.zeros(d) for d in dims], dict.fromkeys(res, 0.0), 0
        for b in batches:
            if not b.num_rows:
                continue
            n += b.num_rows
            x = matrices(b, len(dims))
            z = m.encode(dict(zip(names, x, strict=True)))[2]
            for t, name in enumerate(names):
                one[t] += x[t].sum(axis=0)
                two[t] += (x[t] * x[t]).sum(axis=0)
                size = np.maximum((x[t] * x[t]).mean(axis=1), 1e-8)
                for s, source in enumerate(names):
                    err = (m.decode(z[source], name) / m.scale[name] - x[t]) ** 2
                    res[s, t] += err.sum(axis=0)
                    nmse[s, t] += float((err.mean(axis=1) / size).sum())
        for (s, t), r in res.items() if n else ():
            d = len(r)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.full(d, v, np.int32)) for v in (s, t)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n, np.int64)), pa.array(np.where(np.arange(d) == 0, nmse[s, t], 0.0)), pa.array(r), pa.array(one[t]), pa.array(two[t])],
                names=["source", "target", "dim", "n", "nmse", "res", "s", "ss"],
            )

    return vectors.mapInArrow(run, SUMS)


def auxiliary_sums(vectors: DataFrame, model: Model) -> DataFrame:
    """(stream_idx, n, nmse) for each task: positions, and the summed normalised errors of the auxiliary codes.

    They are of scaled values: what the ``auxk`` largest dead latents of a stream decode to, against what its code leaves
    over. ``model.last_non_zero`` says which latents are dead.
    """
    state = vars(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**state)
        names, total, n = list(m.streams), np.zeros(len(m.streams)), 0
        for b in batches:
            if b.num_rows:
                n += b.num_rows
                scaled, _, z = m.encode(dict(zip(names, matrices(b, len(names)), strict=True)))
                for i, name in enumerate(names):
                    codes, target = m.auxiliary(scaled[name], m.decode(z[name], name), name)
                    total[i] += nmse_and_gradient(m.decode(codes, name), target)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(np.full(len(total), n, np.int64)), pa.array(total)], names=["stream_idx", "n", "nmse"])

    return vectors.mapInArrow(run, "stream_idx int, n long, nmse double")


def mean_nmse(sums: DataFrame) -> DataFrame:
    """(source, target, nmse) averaged over positions."""
    return sums.groupBy("source", "target").agg((F.sum("nmse") / F.sum(F.when(F.col("dim") == 0, F.col("n")))).alias("nmse"))


def training_loss(vectors: DataFrame, model: Model, cross_weight: float = 1.0, aux_weight: float = 1 / 32) -> DataFrame:
    """One row: average self, cross and auxiliary losses and their weighted sum; without ``auxk`` the auxiliary one is 0."""
    out = total_loss(mean_nmse(loss_sums(vectors, model)), cross_weight)
    if not model.auxk:
        return out.withColumn("avg_aux", F.lit(0.0))
    aux = auxiliary_sums(vectors, model).groupBy("stream_idx").agg((F.sum("nmse") / F.sum("n")).alias("nmse")).agg(F.avg("nmse").alias("avg_aux"))
    return out.crossJoin(F.broadcast(aux)).withColumn("total_loss", F.col("total_loss") + aux_weight * F.col("avg_aux"))  # a row each


def total_loss(means: DataFrame, cross_weight: float = 1.0) -> DataFrame:
    """One row: average self and cross losses and their weighted sum."""
    own, cross = F.avg(F.when(F.col("source") == F.col("target"), F.col("nmse"))), F.avg(F.when(F.col("source") != F.col("target"), F.col("nmse")))
    return means.agg(own.alias("avg_self"), cross.alias("avg_cross")).withColumn("total_loss", F.col("avg_self") + cross_weight * F.col("avg_cross"))


def fvu(sums: DataFrame) -> DataFrame:
    """(source, target, fvu, fve): residual sum of squares over the total one around each dimension's mean."""
    dims = sums.groupBy("source", "target", "dim").agg(F.sum("res").alias("res"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("n").alias("n"))
    out = dims.groupBy("source", "target").agg(F.sum("res").alias("res"), F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")).alias("tot"))
    return out.select("source", "target", (F.col("res") / F.greatest("tot", F.lit(1e-12))).alias("fvu")).withColumn("fve", 1 - F.col("fvu"))


def l1_sums(vectors: DataFrame, k: int = TOP_K, latents: int = LATENTS, weights: list[np.ndarray] | None = None) -> DataFrame:
    """(stream_idx, n, l1) for each task: positions and the sum of their codes' absolute sum over the input's norm."""
    w = weights or [weight(i, latents) for i in range(len(STREAMS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(w)), 0
        for b in batches:
            if b.num_rows:
                x = [_matrix(b.column(f"x{i}")) for i in range(len(w))]
                logits = [x[i] @ w[i].T for i in range(len(w))]
                gate = top_k(sum(logits), k)
                n += b.num_rows
                for i in range(len(w)):
                    z = np.maximum(np.take_along_axis(logits[i], gate, axis=1), 0.0).sum(axis=1)
                    total[i] += float((z / np.maximum(np.sqrt((x[i] * x[i]).sum(axis=1)), 1e-8)).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w), dtype=np.int32)), pa.array(np.full(len(w), n, np.int64)), pa.array(total)], names=["stream_idx", "n", "l1"])

    return vectors.mapInArrow(run, "stream_idx int, n long, l1 double")
