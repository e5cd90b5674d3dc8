"""Queries on a model: reports from a checkpoint, the auxiliary loss, the whole loss; and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.operators import recon, report
from actlens.operators.model import Model
from actlens.operators.streams import STREAMS, TOP_K
from actlens.plans import features
from actlens.sources.store import work_dir

NAMES = [s.name for s in STREAMS]


def with_counters(spark: SparkSession, sf: str) -> Model:
    """The closed-form model, and how long each of its latents has been silent in ``embeddings``."""
    m = recon.closed_form(auxk=features.AUX_K, dead_after=features.DEAD_AFTER)
    for r in features.dead_counters(spark, sf).collect():  # a row for each stream and latent
        m.last_non_zero[NAMES[r.stream_idx]][r.latent] = r.last_non_zero
    return m


def universality_report(spark: SparkSession, sf: str) -> DataFrame:
    """From a saved checkpoint to a JSON report and back; a row of what it says."""
    where = work_dir(spark, "report")
    recon.closed_form().save(spark, f"{where}/model")
    report.report_checkpoint(spark, f"{where}/model", features.vectors(spark, sf), TOP_K, f"{where}/report.json", NAMES)
    r = report.read_report(spark, f"{where}/report.json")
    row = {"n_positions": r["n_positions"], **r["regime_counts"], "agreement_mean": round(r["agreement_rate_mean"], 9)}
    row |= {k: round(v, 9) for k, v in r["agreement_rate_percentiles"].items()}
    for i, n in enumerate(NAMES):
        row |= {f"l0_{n}": round(r["L0_mean"][i], 9), f"firing_{n}": round(sum(r["firing_rate_per_stream"][i]), 9), f"values_{n}": round(sum(r["mean_value_per_stream"][i]), 2)}
    for pair, v in r["jaccard_per_pair"].items():
        name = pair.replace("|", "")
        row |= {f"jaccard_{name}": round(v, 9), f"corr_mean_{name}": round(r["value_corr_per_pair"][pair]["mean"], 6), f"corr_median_{name}": round(r["value_corr_per_pair"][pair]["median"], 6)}
    row |= {"top_universal": ",".join(map(str, r["top_universal_idx"])), "top_specific": ",".join(map(str, r["top_specific_idx"]))}
    kinds = {int: "long", float: "double", str: "string"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in row.items()))


def eval_report(spark: SparkSession, sf: str) -> DataFrame:
    """From a saved checkpoint to a JSON report of reconstructions and back, a row for each of them."""
    where = work_dir(spark, "evaluation")
    recon.closed_form().save(spark, f"{where}/model")
    report.evaluate_checkpoint(spark, f"{where}/model", features.vectors(spark, sf), TOP_K, f"{where}/report.json", NAMES)
    rows = [(k, round(v["fvu"], 6), round(v["fve"], 6)) for k, v in report.read_report(spark, f"{where}/report.json").items()]
    return spark.createDataFrame(rows, "name string, fvu double, fve double")


def auxk_loss(spark: SparkSession, sf: str) -> DataFrame:
    sums = recon.auxiliary_sums(features.vectors(spark, sf), with_counters(spark, sf))
    return sums.groupBy("stream_idx").agg(F.round(F.sum("nmse") / F.sum("n"), 6).alias("nmse"))


def training_loss(spark: SparkSession, sf: str) -> DataFrame:
    out = recon.training_loss(features.vectors(spark, sf), with_counters(spark, sf))
    return out.select(*[F.round(c, 6).alias(c) for c in ("avg_self", "avg_cross", "avg_aux", "total_loss")])


_LIVE = "greatest(firing0, firing1, firing2) > 1e-4"
_EACH = ", ".join(
    f"round((SELECT sum(n_alive{i}) FROM counts) / n, 9)::DOUBLE AS l0_{s}, round((SELECT sum(firing{i}) FROM rated), 9)::DOUBLE AS firing_{s}, round((SELECT sum(mean{i}) FROM rated), 2)::DOUBLE AS values_{s}" for i, s in enumerate(NAMES)
)
_PAIR = ", ".join(
    f"(SELECT round(jaccard, 9) FROM jac WHERE i = {i} AND j = {j})::DOUBLE AS jaccard_{a}{b}, (SELECT round(avg(corr), 6) FROM corr WHERE i = {i} AND j = {j})::DOUBLE AS corr_mean_{a}{b}, (SELECT round(quantile_disc(corr, 0.5), 6) FROM corr WHERE i = {i} AND j = {j})::DOUBLE AS corr_median_{a}{b}"
    for (i, a), (j, b) in (((0, "a"), (1, "b")), ((0, "a"), (2, "c")), ((1, "b"), (2, "c")))
)
_SPREAD = ", ".join(f"(SELECT round(coalesce(quantile_cont(agreement::DOUBLE, {p}), 0.0), 9) FROM rated WHERE {_LIVE}) AS p{int(p * 100):02d}" for p in report.PERCENTS)
_REGIMES = """(SELECT count(*) FILTER (u)::BIGINT AS universal, count(*) FILTER (k = 1)::BIGINT AS stream_specific, count(*) FILTER (k = 0)::BIGINT AS dead, count(*) FILTER (NOT u AND k > 1)::BIGINT AS ambiguous
  FROM (SELECT agreement > 0.9 AND gate_rate > 1e-4 AS u, (firing0 > 1e-4)::INT + (firing1 > 1e-4)::INT + (firing2 > 1e-4)::INT AS k FROM rated))"""
_TOP = "(SELECT string_agg(latent::VARCHAR, ',' ORDER BY agreement {0}, latent) FROM (SELECT latent, agreement FROM rated WHERE " + _LIVE + " ORDER BY agreement {0}, latent LIMIT 20))"
_AUX = (
    features.RECON
    + """,
dead AS (SELECT pos_id, g.s, g.l, CASE WHEN c.last_non_zero > 1 THEN logit ELSE 0.0 END AS v FROM logits g JOIN counters c ON c.stream_idx = g.s AND c.latent = g.l),
auxgate AS (SELECT pos_id, s, l, greatest(v, 0.0) AS z FROM (SELECT *, row_number() OVER (PARTITION BY pos_id, s ORDER BY v DESC, l) AS rank FROM dead) WHERE rank <= 4),
auxrecon AS (SELECT r.pos_id, r.src AS s, r.d, r.x - r.r AS t, coalesce(sum(a.z * w.w), 0) * (1.0 / (498.0 * 498.0 * 64.0))::DOUBLE AS r
  FROM recon r JOIN auxgate a ON a.pos_id = r.pos_id AND a.s = r.src JOIN w ON w.s = a.s AND w.l = a.l AND w.d = r.d WHERE r.src = r.tgt GROUP BY 1, 2, 3, 4),
auxloss AS (SELECT s, avg(v) AS nmse FROM (SELECT s, pos_id, avg((r - t) * (r - t)) / greatest(avg(t * t), 1e-8) AS v FROM auxrecon GROUP BY 1, 2) GROUP BY 1)
"""
)

SQL = {
    "universality_report": features.BASE
    + f"SELECT n::BIGINT AS n_positions, universal, stream_specific, dead, ambiguous, (SELECT round(avg(agreement), 9) FROM rated WHERE {_LIVE})::DOUBLE AS agreement_mean, {_SPREAD}, {_EACH}, {_PAIR}, {_TOP.format('DESC')} AS top_universal, {_TOP.format('')} AS top_specific FROM npos, {_REGIMES}",
    "eval_report": features.RECON
    + """SELECT CASE WHEN src = tgt THEN 'recon_' || chr(97 + tgt::INT) ELSE 'cross_recon_' || chr(97 + tgt::INT) || '_from_' || chr(97 + src::INT) END AS name, round(sum(res) / greatest(sum(tot), 1e-12), 6) AS fvu, round(1 - sum(res) / greatest(sum(tot), 1e-12), 6) AS fve
      FROM (SELECT src, tgt, d, sum((x - r) * (x - r)) AS res, sum(x * x) - sum(x) * sum(x) / count(*) AS tot FROM recon GROUP BY 1, 2, 3) GROUP BY src, tgt""",
    "auxk_loss": _AUX + "SELECT s::INT AS stream_idx, round(nmse, 6) AS nmse FROM auxloss",
    "training_loss": _AUX
    + "SELECT round(a, 6) AS avg_self, round(b, 6) AS avg_cross, round(c, 6) AS avg_aux, round(a + b + c / 32, 6) AS total_loss FROM (SELECT avg(nmse) FILTER (src = tgt) AS a, avg(nmse) FILTER (src <> tgt) AS b FROM nm), (SELECT avg(nmse) AS c FROM auxloss)",
}
QUERIES = {f.__name__: f for f in (universality_report, eval_report, auxk_loss, training_loss)}
