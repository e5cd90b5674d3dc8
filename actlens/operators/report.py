"""From a checkpoint to a report: how far latents are shared by the streams, and how well each stream is reconstructed.

The positions are read once for each report. What reaches the driver has a row for each latent, or for each pair of streams
and dimension, as large as a vector of the model, whatever the number of positions.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.operators import code, metrics, recon
from actlens.operators.model import Model
from actlens.sources.store import write_text

PERCENTS = (0.05, 0.25, 0.5, 0.75, 0.95)


def model_encoders(model: Model) -> list[Callable[[np.ndarray], np.ndarray]]:
    """What gives each stream's logits from values as they came."""
    state = vars(model)
    return [lambda x, n=n: (m := Model(**state)).logits(x * m.scale[n], n) for n in model.streams]


def model_counts(vectors: DataFrame, model: Model) -> DataFrame:
    """The counts and sums of each latent, also of those never gated."""
    sums = code.latent_sums(vectors, model.k, model.latents, model_encoders(model))
    return metrics.on_grid(sums.groupBy("latent").agg(*[F.sum(c).alias(c) for c in sums.columns if c != "latent"]), model.latents)


def universality(vectors: DataFrame, model: Model, alive_above: float = 1e-4, universal_above: float = 0.9) -> dict:
    """Gate, firing and agreement of all latents, regimes, percentiles, correlations and Jaccard of pairs, and the ends of the list.

    Each position gates ``k`` latents, so their sum over ``k`` is the number of positions. Without any position all rates
    are 0. Plots are left to others; ``metrics`` has their data.
    """
    spark, names = vectors.sparkSession, list(model.streams)
    made = model_counts(vectors, model)
    counts = spark.createDataFrame(made.orderBy("latent").collect(), made.schema).coalesce(1)  # a row for each latent
    rows = counts.agg(F.sum("n_gate")).first()[0]
    n = rows // min(model.k, model.latents)
    rated = metrics.rates(counts, max(n, 1)).coalesce(1)
    flags = metrics.regimes(rated, alive_above, universal_above)
    regimes = flags.agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("universal", "specific", "dead", "ambiguous")]).first()
    live = metrics.alive(rated, alive_above)
    spread = live.agg(F.percentile("agreement", list(PERCENTS)).alias("p"), F.avg("agreement").alias("mean")).first()
    pairs = {(r.i, r.j): r.jaccard for r in metrics.jaccard(counts).collect()}
    corr = metrics.correlations(counts).groupBy("i", "j").agg(F.avg("corr").alias("mean"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY corr)").alias("median")).collect()
    each = rated.orderBy("latent").collect()
    return {
        "n_positions": n, "model_names": names, "latent_dim": model.latents, "k": model.k, "auxk": model.auxk,
        "L0_mean": [sum(r[f"n_alive{i}"] for r in each) / max(n, 1) for i in range(len(names))],
        "jaccard_per_pair": {f"{names[i]}|{names[j]}": v for (i, j), v in sorted(pairs.items())},
        "regime_counts": {"universal": regimes.universal, "stream_specific": regimes.specific, "dead": regimes.dead, "ambiguous": regimes.ambiguous},
        "agreement_rate_percentiles": {f"p{int(x * 100):02d}": (spread.p[i] if spread.p else 0.0) for i, x in enumerate(PERCENTS)},
        "agreement_rate_mean": spread["mean"] or 0.0,
        "value_corr_per_pair": {f"{names[r.i]}|{names[r.j]}": {"mean": r["mean"], "median": r.median} for r in sorted(corr)},
        "top_universal_idx": [r.latent for r in live.orderBy(F.desc("agreement"), "latent").limit(20).collect()],
        "top_specific_idx": [r.latent for r in live.orderBy("agreement", "latent").limit(20).collect()],
        "gate_rate": [r.gate_rate for r in each],
        "firing_rate_per_stream": [[r[f"firing{i}"] for r in each] for i in range(len(names))],
        "agreement_rate": [r.agreement for r in each],
        "mean_value_per_stream": [[r[f"mean{i}"] for r in each] for i in range(len(names))],
    }


def evaluation(vectors: DataFrame, model: Model) -> dict:
    """Fractions of variance unexplained and explained, of each stream by its own codes and by those of the others.

    ``recon_<stream>`` is by its own, ``cross_recon_<target>_from_<source>`` by another's.
    """
    names = list(model.streams)
    rows = recon.fvu(recon.loss_sums(vectors, model)).orderBy("source", "target").collect()
    key = lambda r: f"recon_{names[r.target]}" if r.source == r.target else f"cross_recon_{names[r.target]}_from_{names[r.source]}"
    return {key(r): {"fvu": r.fvu, "fve": r.fve} for r in rows}


def write_report(spark: SparkSession, path: str, report: dict) -> None:
    """The report as one JSON file at ``path``, which any file system of Spark may hold; one that is there is replaced."""
    write_text(spark, path, json.dumps(report, indent=2))


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def report_checkpoint(spark: SparkSession, checkpoint: str, vectors: DataFrame, k: int, path: str, names: list[str] | None = None, auxk: int = 0, max_positions: int | None = None) -> dict:
    """A checkpoint's universality report, written to ``path``. ``max_positions`` keeps positions below it."""
    report = universality(first_positions(vectors, max_positions), Model.load(spark, checkpoint, k, names, auxk=auxk))
    write_report(spark, path, report)
    return report


def evaluate_checkpoint(spark: SparkSession, checkpoint: str, vectors: DataFrame, k: int, path: str | None = None, names: list[str] | None = None, max_positions: int | None = None) -> dict:
    """A checkpoint's reconstruction figures, written to ``path`` if there is one."""
    report = evaluation(first_positions(vectors, max_positions), Model.load(spark, checkpoint, k, names))
    if path:
        write_report(spark, path, report)
    return report


def first_positions(vectors: DataFrame, n: int | None) -> DataFrame:
    """Positions below ``n``, pushed down to the scan; None keeps all."""
    return vectors if n is None else vectors.where(F.col("pos_id") < n)


def lines(report: dict) -> list[str]:
    """An evaluation as lines of text, own reconstructions first."""
    order = sorted(report, key=lambda k: (k.startswith("cross_"), k))
    return [f"{'CROSS' if k.startswith('cross_') else 'SELF':5s} {k:55s} FVE={report[k]['fve']:+.4f} FVU={report[k]['fvu']:.4f}" for k in order]
