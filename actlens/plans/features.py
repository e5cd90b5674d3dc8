"""Queries on the shared sparse code of ``embeddings``, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actlens.functions.vectors import l2_norm, rms
from actlens.operators import code, metrics, recon
from actlens.operators.streams import LATENTS, STREAMS, long_vectors, stream_vectors, weight

BATCH = 32
AUX_K = 4
DEAD_AFTER = 1
THRESHOLD = 1e-3


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return stream_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))


def codes(spark: SparkSession, sf: str) -> DataFrame:
    return code.shared_codes(vectors(spark, sf))


def n_positions(spark: SparkSession, sf: str) -> int:
    return spark.read.parquet(f"{sf}/embeddings.parquet").where("embedding IS NOT NULL").count()


def counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.vector_counts(vectors(spark, sf))


def rated(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rates(counts(spark, sf), n_positions(spark, sf))


def stream_rms(spark: SparkSession, sf: str) -> DataFrame:
    return long_vectors(vectors(spark, sf)).select("pos_id", "stream_idx", F.round(rms(F.col("x")), 6).alias("rms"))


def calibrate_scales(spark: SparkSession, sf: str) -> DataFrame:
    rows = long_vectors(vectors(spark, sf)).select("stream_idx", rms(F.col("x")).alias("r"))
    median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY r)")
    return rows.groupBy("stream_idx").agg(median.alias("m")).select("stream_idx", F.round(1.0 / F.greatest("m", F.lit(1e-8)), 12).alias("input_scale"))


def shared_gate_topk(spark: SparkSession, sf: str) -> DataFrame:
    return codes(spark, sf).where("stream_idx = 0").select("pos_id", "latent", "rank")


def sparse_codes(spark: SparkSession, sf: str) -> DataFrame:
    return codes(spark, sf)


def firing_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rated(spark, sf).select("latent", "gate_rate", "firing0", "firing1", "firing2")


def universality_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rated(spark, sf).select("latent", "n_gate", "n_alive0", "n_alive1", "n_alive2", "n_all", "gate_rate", "firing0", "firing1", "firing2", "agreement", *[F.round(f"mean{i}", 4).alias(f"mean{i}") for i in range(3)])


def l0_mean(spark: SparkSession, sf: str) -> DataFrame:
    each = F.array(*[F.struct(F.lit(i).alias("stream_idx"), F.col(f"n_alive{i}").alias("n")) for i in range(len(STREAMS))])
    return counts(spark, sf).select(F.inline(each)).groupBy("stream_idx").agg((F.sum("n") / F.lit(n_positions(spark, sf))).alias("l0"))


def pairwise_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.jaccard(counts(spark, sf))


def jaccard_matrix(spark: SparkSession, sf: str) -> DataFrame:
    pairs = metrics.jaccard(counts(spark, sf))
    full = pairs.union(pairs.select("j", "i", "jaccard")).union(spark.range(len(STREAMS)).select(F.col("id").cast("int").alias("i"), F.col("id").cast("int").alias("j"), F.lit(1.0).alias("jaccard")))
    return full.groupBy("i").pivot("j", list(range(len(STREAMS)))).agg(F.first("jaccard")).select("i", *[F.col(str(k)).alias(f"j{k}") for k in range(len(STREAMS))])


def value_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.correlations(counts(spark, sf)).select("i", "j", "latent", F.round("corr", 6).alias("corr"))


def correlation_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.correlations(counts(spark, sf)).where("corr IS NOT NULL")
    return rows.groupBy("i", "j").agg(F.avg("corr").alias("mean"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY corr)").alias("median")).select("i", "j", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


def regime_counts(spark: SparkSession, sf: str) -> DataFrame:
    flags = metrics.regimes(rated(spark, sf))
    return flags.agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("universal", "specific", "dead", "ambiguous")])


def agreement_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    ps = (0.05, 0.25, 0.5, 0.75, 0.95)
    p = metrics.alive(rated(spark, sf)).agg(F.percentile("agreement", list(ps)).alias("p"))
    return p.select(*[F.round(F.coalesce(F.col("p")[i], F.lit(0.0)), 9).alias(f"p{int(x * 100):02d}") for i, x in enumerate(ps)])


def top_universal(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.alive(rated(spark, sf)).orderBy(F.desc("agreement"), "latent").limit(20).select("latent", "agreement")


def top_specific(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.alive(rated(spark, sf)).orderBy("agreement", "latent").limit(20).select("latent", "agreement")


def firing_rate_hist(spark: SparkSession, sf: str) -> DataFrame:
    each = rated(spark, sf).select(F.explode(F.array("firing0", "firing1", "firing2")).alias("rate"))
    return metrics.firing_histogram(each, "rate")


def agreement_hist(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.even_histogram(metrics.alive(rated(spark, sf)), "agreement")


def stream_nmse(spark: SparkSession, sf: str) -> DataFrame:
    return recon.mean_nmse(recon.loss_sums(vectors(spark, sf))).select("source", "target", F.round("nmse", 6).alias("nmse"))


def total_loss(spark: SparkSession, sf: str) -> DataFrame:
    out = recon.total_loss(recon.mean_nmse(recon.loss_sums(vectors(spark, sf))))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def fvu_fve(spark: SparkSession, sf: str) -> DataFrame:
    return recon.fvu(recon.loss_sums(vectors(spark, sf))).select("source", "target", F.round("fvu", 6).alias("fvu"), F.round("fve", 6).alias("fve"))


def l1_norm(spark: SparkSession, sf: str) -> DataFrame:
    """Mean over positions of the codes' absolute sum over the input's norm, for each stream."""
    rows = recon.l1_sums(vectors(spark, sf))
    return rows.groupBy("stream_idx").agg(F.round(F.sum("l1") / F.sum("n"), 4).alias("l1"))


def plain_sae_loss(spark: SparkSession, sf: str, l1: float = 1e-3) -> DataFrame:
    """The plain autoencoder on stream 0: ReLU codes of all latents, squared error and weighted mean of codes."""
    import numpy as np
    import pyarrow as pa

    w = weight(0)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = code._matrix(b.column("x0"))
                z = np.maximum(x @ w.T, 0.0)
                err = ((z @ w * recon.DECODE_SCALE - x) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(err), pa.array(z.sum(axis=1))], names=["err", "act"])

    sums = vectors(spark, sf).mapInArrow(run, "err double, act double").agg(F.sum("err").alias("err"), F.sum("act").alias("act"), F.count("*").alias("n"))
    mse, mean = F.col("err") / (F.col("n") * STREAMS[0].dims), F.col("act") / (F.col("n") * LATENTS)
    return sums.select(F.round(mse, 0).alias("mse"), F.round(mean, 0).alias("mean_code"))


def last_batch(spark: SparkSession, sf: str) -> int:
    row = spark.read.parquet(f"{sf}/embeddings.parquet").agg(F.max("vec_id")).first()
    return (row[0] or 0) // BATCH + 1


def dead_counters(spark: SparkSession, sf: str) -> DataFrame:
    return code.dead_counters(codes(spark, sf), last_batch(spark, sf), BATCH, THRESHOLD)


def dead_features(spark: SparkSession, sf: str) -> DataFrame:
    dead = dead_counters(spark, sf).where(F.col("last_non_zero") > DEAD_AFTER)
    return dead.groupBy("stream_idx").agg(F.count("*").alias("n_dead"), (F.count("*") / F.lit(LATENTS)).alias("share"))


def dead_union(spark: SparkSession, sf: str) -> DataFrame:
    return dead_counters(spark, sf).where(F.col("last_non_zero") > DEAD_AFTER).select("latent").distinct()


def auxk_gate(spark: SparkSession, sf: str) -> DataFrame:
    dead = dead_counters(spark, sf).where(F.col("last_non_zero") > DEAD_AFTER)
    return code.dead_gate(vectors(spark, sf), dead, AUX_K)


def batch_firing(spark: SparkSession, sf: str) -> DataFrame:
    """Batches since a latent last fired, before each batch in which it fires."""
    seen = code.batch_activity(codes(spark, sf), BATCH, THRESHOLD)
    order = Window.partitionBy("stream_idx", "latent").orderBy("batch")
    return seen.select("stream_idx", "latent", "batch", (F.col("batch") - F.coalesce(F.lag("batch").over(order), F.lit(-1))).cast("int").alias("gap"))


def decoder_norms(spark: SparkSession, sf: str) -> DataFrame:
    """Norms of the closed-form decoder rows, by which unit norm divides."""
    rows = [(i, l, weight(i)[l].tolist()) for i in range(len(STREAMS)) for l in range(LATENTS)]
    return spark.createDataFrame(rows, "stream_idx int, latent int, w array<double>").select("stream_idx", "latent", F.round(l2_norm(F.col("w")), 6).alias("norm"))


BASE = """
WITH x AS (
  SELECT vec_id AS pos_id, 0 AS s, d, floor(embedding[d + 1]::DOUBLE * 1.0 * 10000.0 + 0.5) AS q FROM embeddings, range(0, 64) t(d)
  UNION ALL SELECT vec_id, 1, d, floor(embedding[d + 1]::DOUBLE * 4.0 * 10000.0 + 0.5) FROM embeddings, range(0, 48) t(d)
  UNION ALL SELECT vec_id, 2, d, floor(embedding[d + 1]::DOUBLE * 0.1 * 10000.0 + 0.5) FROM embeddings, range(16, 48) t(d)),
npos AS (SELECT count(*) AS n FROM embeddings),
w AS (SELECT s, l, d, ((l * 131 + d * 71 + s * 17) % 997 - 498)::DOUBLE AS w FROM range(3) a(s), range(64) b(l), range(64) c(d)),
logits AS (SELECT pos_id, x.s AS s, l, sum(q * w) AS logit FROM x JOIN w ON x.s = w.s AND x.d = w.d GROUP BY 1, 2, 3),
total AS (SELECT pos_id, l, sum(logit) AS t FROM logits GROUP BY 1, 2),
gate AS (SELECT pos_id, l, rank FROM (SELECT pos_id, l, row_number() OVER (PARTITION BY pos_id ORDER BY t DESC, l) AS rank FROM total) WHERE rank <= 8),
codes AS (SELECT g.pos_id, g.l::INT AS latent, g.rank::INT AS rank, s::INT AS stream_idx, logit, greatest(logit, 0.0) AS z FROM gate g JOIN logits k ON g.pos_id = k.pos_id AND g.l = k.l),
wide AS (SELECT pos_id, latent, max(CASE WHEN stream_idx = 0 THEN z END) AS z0, max(CASE WHEN stream_idx = 1 THEN z END) AS z1, max(CASE WHEN stream_idx = 2 THEN z END) AS z2 FROM codes GROUP BY 1, 2),
found AS (
  SELECT latent, count(*) AS n_gate, count(*) FILTER (z0 > 0 AND z1 > 0 AND z2 > 0) AS n_all,
    count(*) FILTER (z0 > 0) AS n_alive0, count(*) FILTER (z1 > 0) AS n_alive1, count(*) FILTER (z2 > 0) AS n_alive2,
    sum(z0) AS sum0, sum(z1) AS sum1, sum(z2) AS sum2, sum(z0 * z0) AS sq0, sum(z1 * z1) AS sq1, sum(z2 * z2) AS sq2,
    count(*) FILTER (z0 > 0 AND z1 > 0) AS both01, count(*) FILTER (z0 > 0 AND z2 > 0) AS both02, count(*) FILTER (z1 > 0 AND z2 > 0) AS both12,
    count(*) FILTER (z0 > 0 OR z1 > 0) AS either01, count(*) FILTER (z0 > 0 OR z2 > 0) AS either02, count(*) FILTER (z1 > 0 OR z2 > 0) AS either12,
    sum(z0 * z1) AS prod01, sum(z0 * z2) AS prod02, sum(z1 * z2) AS prod12
  FROM wide GROUP BY 1),
counts AS (SELECT l::INT AS latent, coalesce(COLUMNS(f.* EXCLUDE latent), 0) FROM range(64) t(l) LEFT JOIN found f ON f.latent = l),
rated AS (
  SELECT latent, n_gate, n_all, n_alive0, n_alive1, n_alive2, n_gate / n AS gate_rate, n_alive0 / n AS firing0, n_alive1 / n AS firing1, n_alive2 / n AS firing2,
    n_all / greatest(n_gate, 1) AS agreement, sum0 / greatest(n_alive0, 1) AS mean0, sum1 / greatest(n_alive1, 1) AS mean1, sum2 / greatest(n_alive2, 1) AS mean2
  FROM counts, npos),
jac AS (
  SELECT 0 AS i, 1 AS j, sum(both01) / greatest(sum(either01), 1) AS jaccard FROM counts
  UNION ALL SELECT 0, 2, sum(both02) / greatest(sum(either02), 1) FROM counts
  UNION ALL SELECT 1, 2, sum(both12) / greatest(sum(either12), 1) FROM counts),
corr AS (
  SELECT i, j, latent, (p / g - a / g * (b / g)) / greatest(sqrt(greatest(aa / g - a / g * (a / g), 0) * greatest(bb / g - b / g * (b / g), 0)), 1e-12) AS corr
  FROM (
    SELECT 0 AS i, 1 AS j, latent, greatest(n_gate, 1) AS g, sum0 AS a, sum1 AS b, sq0 AS aa, sq1 AS bb, prod01 AS p FROM counts
    UNION ALL SELECT 0, 2, latent, greatest(n_gate, 1), sum0, sum2, sq0, sq2, prod02 FROM counts
    UNION ALL SELECT 1, 2, latent, greatest(n_gate, 1), sum1, sum2, sq1, sq2, prod12 FROM counts)),
active AS (SELECT DISTINCT (pos_id // 32)::INT AS batch, stream_idx, latent FROM codes WHERE z > 0.001),
nb AS (SELECT max(vec_id) // 32 + 1 AS nb FROM embeddings),
counters AS (
  SELECT s::INT AS stream_idx, l::INT AS latent, coalesce(nb - last, nb)::INT AS last_non_zero
  FROM range(3) a(s) CROSS JOIN range(64) b(l) CROSS JOIN nb LEFT JOIN (SELECT stream_idx, latent, max(batch) AS last FROM active GROUP BY 1, 2) q ON q.stream_idx = s AND q.latent = l)
"""
RECON = (
    BASE
    + """,
pairs AS (SELECT a.s AS src, b.s AS tgt FROM range(3) a(s), range(3) b(s)),
recon AS (
  SELECT p.src, p.tgt, x.pos_id, x.d, x.q AS x, coalesce(sum(c.z * w.w), 0) * (1.0 / (498.0 * 498.0 * 64.0))::DOUBLE AS r
  FROM pairs p JOIN x ON x.s = p.tgt LEFT JOIN codes c ON c.pos_id = x.pos_id AND c.stream_idx = p.src LEFT JOIN w ON w.s = p.tgt AND w.l = c.latent AND w.d = x.d
  GROUP BY 1, 2, 3, 4, 5),
nm AS (SELECT src, tgt, avg(v) AS nmse FROM (SELECT src, tgt, pos_id, avg((r - x) * (r - x)) / greatest(avg(x * x), 1e-8) AS v FROM recon GROUP BY 1, 2, 3) GROUP BY 1, 2)
"""
)

SQL = {
    "stream_rms": BASE + "SELECT pos_id, s::INT AS stream_idx, round(sqrt(sum(q * q) / count(*)), 6) AS rms FROM x GROUP BY 1, 2",
    "calibrate_scales": BASE + "SELECT s::INT AS stream_idx, round(1.0 / greatest(quantile_disc(r, 0.5), 1e-8), 12) AS input_scale FROM (SELECT pos_id, s, sqrt(sum(q * q) / count(*)) AS r FROM x GROUP BY 1, 2) GROUP BY 1",
    "shared_gate_topk": BASE + "SELECT pos_id, l::INT AS latent, rank::INT AS rank FROM gate",
    "sparse_codes": BASE + "SELECT pos_id, latent, rank, stream_idx, logit, z FROM codes",
    "firing_rates": BASE + "SELECT latent, gate_rate, firing0, firing1, firing2 FROM rated",
    "universality_metrics": BASE + "SELECT latent, n_gate::BIGINT AS n_gate, n_alive0::BIGINT AS n_alive0, n_alive1::BIGINT AS n_alive1, n_alive2::BIGINT AS n_alive2, n_all::BIGINT AS n_all, gate_rate, firing0, firing1, firing2, agreement, round(mean0, 4) AS mean0, round(mean1, 4) AS mean1, round(mean2, 4) AS mean2 FROM rated",
    "l0_mean": BASE + "SELECT stream_idx, count(*) FILTER (z > 0) / any_value(n) AS l0 FROM codes, npos GROUP BY 1",
    "pairwise_jaccard": BASE + "SELECT i::INT AS i, j::INT AS j, jaccard FROM jac",
    "jaccard_matrix": BASE + "SELECT i::INT AS i, max(CASE WHEN j = 0 THEN jaccard END) AS j0, max(CASE WHEN j = 1 THEN jaccard END) AS j1, max(CASE WHEN j = 2 THEN jaccard END) AS j2 FROM (SELECT i, j, jaccard FROM jac UNION ALL SELECT j, i, jaccard FROM jac UNION ALL SELECT s, s, 1.0 FROM range(3) t(s)) GROUP BY 1",
    "value_correlation": BASE + "SELECT i::INT AS i, j::INT AS j, latent, round(corr, 6) AS corr FROM corr",
    "correlation_summary": BASE + "SELECT i::INT AS i, j::INT AS j, round(avg(corr), 6) AS mean, round(quantile_disc(corr, 0.5), 6) AS median FROM corr GROUP BY 1, 2",
    "regime_counts": BASE
    + """SELECT count(*) FILTER (u)::BIGINT AS universal, count(*) FILTER (k = 1)::BIGINT AS specific, count(*) FILTER (k = 0)::BIGINT AS dead, count(*) FILTER (NOT u AND k > 1)::BIGINT AS ambiguous
      FROM (SELECT agreement > 0.9 AND gate_rate > 1e-4 AS u, (firing0 > 1e-4)::INT + (firing1 > 1e-4)::INT + (firing2 > 1e-4)::INT AS k FROM rated)""",
    "agreement_percentiles": BASE + "SELECT " + ", ".join(f"round(coalesce(quantile_cont(agreement::DOUBLE, {p}), 0.0), 9) AS p{int(p * 100):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM rated WHERE greatest(firing0, firing1, firing2) > 1e-4",
    "top_universal": BASE + "SELECT latent, agreement FROM rated WHERE greatest(firing0, firing1, firing2) > 1e-4 ORDER BY agreement DESC, latent LIMIT 20",
    "top_specific": BASE + "SELECT latent, agreement FROM rated WHERE greatest(firing0, firing1, firing2) > 1e-4 ORDER BY agreement, latent LIMIT 20",
    "firing_rate_hist": BASE + "SELECT least(floor((log10(greatest(r, 1e-6)) + 6.0) * 59 / 6.0 + 1e-9), 58)::INT AS bin, count(*)::BIGINT AS n FROM (SELECT firing0 AS r FROM rated UNION ALL SELECT firing1 FROM rated UNION ALL SELECT firing2 FROM rated) GROUP BY 1",
    "agreement_hist": BASE + "SELECT least(floor((agreement - lo) / greatest(hi - lo, 1e-300) * 50 + 1e-9), 49)::INT AS bin, count(*)::BIGINT AS n FROM rated, (SELECT min(agreement) AS lo, max(agreement) AS hi FROM rated WHERE greatest(firing0, firing1, firing2) > 1e-4) WHERE greatest(firing0, firing1, firing2) > 1e-4 GROUP BY 1",
    "stream_nmse": RECON + "SELECT src::INT AS source, tgt::INT AS target, round(nmse, 6) AS nmse FROM nm",
    "total_loss": RECON + "SELECT round(a, 6) AS avg_self, round(b, 6) AS avg_cross, round(a + b, 6) AS total_loss FROM (SELECT avg(nmse) FILTER (src = tgt) AS a, avg(nmse) FILTER (src <> tgt) AS b FROM nm)",
    "fvu_fve": RECON
    + """SELECT src::INT AS source, tgt::INT AS target, round(sum(res) / greatest(sum(tot), 1e-12), 6) AS fvu, round(1 - sum(res) / greatest(sum(tot), 1e-12), 6) AS fve
      FROM (SELECT src, tgt, d, sum((x - r) * (x - r)) AS res, sum(x * x) - sum(x) * sum(x) / count(*) AS tot FROM recon GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "l1_norm": BASE
    + """SELECT c.s AS stream_idx, round(avg(c.a / greatest(b.n, 1e-8)), 4) AS l1 FROM (SELECT pos_id, stream_idx AS s, sum(abs(z)) AS a FROM codes GROUP BY 1, 2) c
      JOIN (SELECT pos_id, s, sqrt(sum(q * q)) AS n FROM x GROUP BY 1, 2) b ON c.pos_id = b.pos_id AND c.s = b.s GROUP BY 1""",
    "plain_sae_loss": BASE
    + """, z AS (SELECT pos_id, l, greatest(logit, 0.0) AS z FROM logits WHERE s = 0),
    r AS (SELECT x.pos_id, x.d, x.q, sum(z.z * w.w) * (1.0 / (498.0 * 498.0 * 64.0))::DOUBLE AS r FROM x JOIN z ON x.pos_id = z.pos_id JOIN w ON w.s = 0 AND w.l = z.l AND w.d = x.d WHERE x.s = 0 GROUP BY 1, 2, 3)
    SELECT round((SELECT avg((r - q) * (r - q)) FROM r), 0) AS mse, round((SELECT avg(z) FROM z), 0) AS mean_code""",
    "dead_counters": BASE + "SELECT stream_idx, latent, last_non_zero FROM counters",
    "dead_features": BASE + "SELECT stream_idx, count(*)::BIGINT AS n_dead, count(*) / 64 AS share FROM counters WHERE last_non_zero > 1 GROUP BY 1",
    "dead_union": BASE + "SELECT DISTINCT latent FROM counters WHERE last_non_zero > 1",
    "auxk_gate": BASE
    + """SELECT pos_id, stream_idx, latent, rank, greatest(v, 0.0) AS z FROM (
      SELECT g.pos_id, g.s::INT AS stream_idx, g.l::INT AS latent, row_number() OVER (PARTITION BY g.pos_id, g.s ORDER BY CASE WHEN c.last_non_zero > 1 THEN logit ELSE 0.0 END DESC, g.l)::INT AS rank, CASE WHEN c.last_non_zero > 1 THEN logit ELSE 0.0 END AS v
      FROM logits g JOIN counters c ON c.stream_idx = g.s AND c.latent = g.l) WHERE rank <= 4""",
    "batch_firing": BASE + "SELECT stream_idx, latent, batch, (batch - coalesce(lag(batch) OVER (PARTITION BY stream_idx, latent ORDER BY batch), -1))::INT AS gap FROM active",
    "decoder_norms": "SELECT s::INT AS stream_idx, l::INT AS latent, round(sqrt(sum(w * w)), 6) AS norm FROM (SELECT s, l, d, ((l * 131 + d * 71 + s * 17) % 997 - 498)::DOUBLE AS w FROM range(3) a(s), range(64) b(l), range(64) c(d) WHERE s = 0 OR (s = 1 AND d < 48) OR (s = 2 AND d >= 16 AND d < 48)) GROUP BY 1, 2",
}
QUERIES = {
    f.__name__: f
    for f in (
        stream_rms, calibrate_scales, shared_gate_topk, sparse_codes, firing_rates, universality_metrics, l0_mean, pairwise_jaccard, jaccard_matrix, value_correlation, correlation_summary, regime_counts, agreement_percentiles,
        top_universal, top_specific, firing_rate_hist, agreement_hist, stream_nmse, total_loss, fvu_fve, l1_norm, plain_sae_loss, dead_counters, dead_features, dead_union, auxk_gate, batch_firing, decoder_norms,
    )
}
