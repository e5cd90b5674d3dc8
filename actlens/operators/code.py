"""The shared top-k code: encode every stream, sum logits, keep the k largest for all streams.

One pass with a matrix product for each Arrow batch; weights travel in the closure, once for each
task. What comes out is the sparse long form, k rows for each position and stream, never the dense
positions x latents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actlens.operators.streams import LATENTS, STREAMS, TOP_K, weight

CODES = "pos_id long, latent int, rank int, stream_idx int, logit double, z double"


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def matrices(b: pa.RecordBatch, n: int) -> list[np.ndarray]:
    return [_matrix(b.column(f"x{i}")) for i in range(n)]


def top_k(x: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of each row, largest first; of equal ones the lower column."""
    if k >= x.shape[1]:
        return np.argsort(-x, axis=1, kind="stable")[:, :k]
    least = np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k, None]  # the k-th largest value
    above, equal = x > least, x == least
    room = k - above.sum(axis=1, keepdims=True)
    chosen = above | equal & (np.cumsum(equal, axis=1) <= room)
    columns = np.nonzero(chosen)[1].reshape(len(x), k)
    order = np.argsort(-np.take_along_axis(x, columns, axis=1), axis=1, kind="stable")
    return np.take_along_axis(columns, order, axis=1)


def shared_codes(vectors: DataFrame, k: int = TOP_K, latents: int = LATENTS, weights: list[np.ndarray] | None = None) -> DataFrame:
    """(pos_id, latent, rank, stream_idx, logit, z) of the gated latents; z = max(0, logit) may be 0."""
    w = weights or [weight(i, latents) for i in range(len(STREAMS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            logits = np.stack([_matrix(b.column(f"x{i}")) @ w[i].T for i in range(len(w))])
            gate = top_k(logits.sum(axis=0), k)
            n = len(gate)
            own = np.take_along_axis(logits, np.broadcast_to(gate, (len(w), n, k)), axis=2)  # stream, row, rank
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.tile(np.repeat(b.column("pos_id").to_numpy(), k), len(w))), pa.array(np.tile(gate.reshape(-1), len(w)).astype(np.int32)),
                    pa.array(np.tile(np.arange(1, k + 1), n * len(w)).astype(np.int32)), pa.array(np.repeat(np.arange(len(w)), n * k).astype(np.int32)),
                    pa.array(own.reshape(-1)), pa.array(np.maximum(own, 0.0).reshape(-1)),
                ],
                names=["pos_id", "latent", "rank", "stream_idx", "logit", "z"],
            )

    return vectors.mapInArrow(run, CODES)


def sum_columns(streams: int = len(STREAMS)) -> list[str]:
    """Names of what :func:`latent_sums` adds up, counts first."""
    pairs = list(combinations(range(streams), 2))
    return ["n_gate", "n_all", *(f"n_alive{i}" for i in range(streams)), *(f"{x}{i}{j}" for i, j in pairs for x in ("both", "either")), *(f"{x}{i}" for i in range(streams) for x in ("sum", "square")), *(f"product{i}{j}" for i, j in pairs)]


def logits_by(latents: int = LATENTS, weights: list[np.ndarray] | None = None) -> list[Callable[[np.ndarray], np.ndarray]]:
    """What gives a stream's logits, for each stream: products with ``weights``, or the closed-form ones."""
    return [lambda x, w=w: x @ w.T for w in weights or [weight(i, latents) for i in range(len(STREAMS))]]


def latent_sums(vectors: DataFrame, k: int = TOP_K, latents: int = LATENTS, encoders: list[Callable[[np.ndarray], np.ndarray]] | None = None) -> DataFrame:
    """For each task and latent gated in it: positions, active streams, sums of codes, squares and products.

    ``encoders`` (:func:`logits_by`, or a model's) give each stream's logits.
    """
    w = encoders or logits_by(latents)
    names = sum_columns(len(w))
    real = [n.startswith(("sum", "square", "product")) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {n: np.zeros(latents, np.float64 if r else np.int64) for n, r in zip(names, real, strict=True)}
        for b in batches:
            if not b.num_rows:
                continue
            logits = np.stack([e(x) for e, x in zip(w, matrices(b, len(w)), strict=True)])
            gate = top_k(logits.sum(axis=0), k)
            z = np.maximum(np.take_along_axis(logits, np.broadcast_to(gate, (len(w), *gate.shape)), axis=2), 0.0).reshape(len(w), -1)
            on, at = z > 0, gate.reshape(-1)

            def add(name: str, values: np.ndarray) -> None:
                got = np.bincount(at, values, latents)
                total[name] += got if total[name].dtype == np.float64 else got.astype(np.int64)

            add("n_gate", np.ones(len(at)))
            add("n_all", on.all(axis=0))
            for i in range(len(w)):
                add(f"n_alive{i}", on[i])
                add(f"sum{i}", z[i])
                add(f"square{i}", z[i] * z[i])
            for i, j in combinations(range(len(w)), 2):
                add(f"both{i}{j}", on[i] & on[j])
                add(f"either{i}{j}", on[i] | on[j])
                add(f"product{i}{j}", z[i] * z[j])
        rows = np.flatnonzero(total["n_gate"])
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), *(pa.array(total[n][rows]) for n in names)], names=["latent", *names])

    return vectors.mapInArrow(run, "latent int, " + ", ".join(f"{n} {'double' if r else 'long'}" for n, r in zip(names, real, strict=True)))


def dead_gate(vectors: DataFrame, dead: DataFrame, k: int, latents: int = LATENTS) -> DataFrame:
    """The auxiliary gate: for each stream, its k largest logits with those of live latents set to 0.

    ``dead`` has (stream_idx, latent), at most one row for each latent of the model. Codes are clipped at 0.
    """
    w = [weight(i, latents) for i in range(len(STREAMS))]
    masks = np.zeros((len(w), latents))
    for r in dead.select("stream_idx", "latent").distinct().collect():
        masks[r[0], r[1]] = 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(w) if b.num_rows else 0):
                logits = _matrix(b.column(f"x{i}")) @ w[i].T * masks[i]
                gate = top_k(logits, k)
                z = np.maximum(np.take_along_axis(logits, gate, axis=1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(b.column("pos_id").to_numpy(), k)), pa.array(np.full(gate.size, i, np.int32)), pa.array(gate.reshape(-1).astype(np.int32)), pa.array(np.tile(np.arange(1, k + 1), len(gate)).astype(np.int32)), pa.array(z.reshape(-1))],
                    names=["pos_id", "stream_idx", "latent", "rank", "z"],
                )

    return vectors.mapInArrow(run, "pos_id long, stream_idx int, latent int, rank int, z double")


def batch_activity(codes: DataFrame, batch_rows: int, threshold: float) -> DataFrame:
    """(batch, stream_idx, latent): which latents exceed the threshold anywhere in a batch of positions."""
    return codes.where(F.col("z") > threshold).select((F.floor(F.col("pos_id") / batch_rows)).cast("int").alias("batch"), "stream_idx", "latent").distinct()


def dead_counters(codes: DataFrame, n_batches: int, batch_rows: int, threshold: float, latents: int = LATENTS) -> DataFrame:
    """(stream_idx, latent, last_non_zero) after the last batch: 1 if active in it, else batches since; never active: all."""
    spark = codes.sparkSession
    seen = batch_activity(codes, batch_rows, threshold).groupBy("stream_idx", "latent").agg(F.max("batch").alias("last"))
    grid = spark.range(len(STREAMS) * latents).select((F.col("id") / latents).cast("int").alias("stream_idx"), (F.col("id") % latents).cast("int").alias("latent"))
    return grid.join(seen, ["stream_idx", "latent"], "left").select("stream_idx", "latent", F.coalesce(F.lit(n_batches) - F.col("last"), F.lit(n_batches)).cast("int").alias("last_non_zero"))


def gated_rank(logits: DataFrame, k: int) -> DataFrame:
    """The relational form of the gate on (pos_id, latent, logit) rows: a ranked window, pruned to k before its shuffle."""
    order = Window.partitionBy("pos_id").orderBy(F.desc("logit"), "latent")
    return logits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
