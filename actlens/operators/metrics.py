"""Feature analytics over sparse codes (pos_id, latent, rank, stream_idx, z).

All are mergeable sums. From vectors, ``code.latent_sums`` adds them up where the codes are made: one row for each task
and latent is shuffled, whatever the number of positions. From codes in long form, ``latent_counts`` first has to bring a
position's streams together.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlens.operators.code import latent_sums
from actlens.operators.streams import LATENTS, STREAMS

N = len(STREAMS)
PAIRS = list(combinations(range(N), 2))


def streams_of(rows: DataFrame) -> tuple[int, list[tuple[int, int]]]:
    """How many streams counts or rates are of, and their pairs."""
    n = sum(c.startswith("n_alive") for c in rows.columns)
    return n, list(combinations(range(n), 2))


def wide(codes: DataFrame) -> DataFrame:
    """(pos_id, latent, z0, z1, ...): the streams' codes of a gated latent in one row."""
    each = [F.max(F.when(F.col("stream_idx") == i, F.col("z"))).alias(f"z{i}") for i in range(N)]
    return codes.groupBy("pos_id", "latent").agg(*each)


def _count(x: Column) -> Column:
    return F.sum(x.cast("long"))


def latent_counts(codes: DataFrame, latents: int = LATENTS) -> DataFrame:
    """n_gate, n_alive<i>, n_all, sum and sum of squares of codes for each latent, also for those never gated."""
    rows = wide(codes)
    alive = [F.col(f"z{i}") > 0 for i in range(N)]
    every = alive[0]
    for a in alive[1:]:
        every = every & a
    aggs = [F.count("*").alias("n_gate"), _count(every).alias("n_all")]
    for i in range(N):
        aggs += [_count(alive[i]).alias(f"n_alive{i}"), F.sum(f"z{i}").alias(f"sum{i}"), F.sum(F.col(f"z{i}") * F.col(f"z{i}")).alias(f"square{i}")]
    for i, j in PAIRS:
        aggs += [_count(alive[i] & alive[j]).alias(f"both{i}{j}"), _count(alive[i] | alive[j]).alias(f"either{i}{j}"), F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"product{i}{j}")]
    return on_grid(rows.groupBy("latent").agg(*aggs), latents)


def on_grid(counts: DataFrame, latents: int = LATENTS) -> DataFrame:
    """A row for every latent; zeros for those that have none."""
    grid = counts.sparkSession.range(latents).select(F.col("id").cast("int").alias("latent"))
    return grid.join(counts, "latent", "left").na.fill(0)


def vector_counts(vectors: DataFrame, latents: int = LATENTS, **how) -> DataFrame:
    """The columns of :func:`latent_counts`, straight from vectors and without a shuffle of codes."""
    sums = latent_sums(vectors, latents=latents, **how)
    return on_grid(sums.groupBy("latent").agg(*[F.sum(c).alias(c) for c in sums.columns if c != "latent"]), latents)


def rates(counts: DataFrame, n_positions: Column | int) -> DataFrame:
    """gate_rate, firing<i>, agreement and mean<i> for each latent."""
    n = n_positions if isinstance(n_positions, Column) else F.lit(n_positions)
    out = counts.withColumn("gate_rate", F.col("n_gate") / n).withColumn("agreement", F.col("n_all") / F.greatest("n_gate", F.lit(1)))
    for i in range(streams_of(counts)[0]):
        out = out.withColumn(f"firing{i}", F.col(f"n_alive{i}") / n).withColumn(f"mean{i}", F.col(f"sum{i}") / F.greatest(f"n_alive{i}", F.lit(1)))
    return out


def jaccard(counts: DataFrame) -> DataFrame:
    """(i, j, jaccard) over all positions and latents at once."""
    pairs = streams_of(counts)[1]
    sums = counts.agg(*[F.sum(f"{kind}{i}{j}").alias(f"{kind}{i}{j}") for i, j in pairs for kind in ("both", "either")])
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col(f"both{i}{j}") / F.greatest(f"either{i}{j}", F.lit(1))).alias("jaccard")) for i, j in pairs])
    return sums.select(F.inline(each))


def correlations(counts: DataFrame) -> DataFrame:
    """(i, j, latent, corr): correlation of code values where the latent is gated; 0 without variance."""
    n, pairs = F.greatest("n_gate", F.lit(1)), streams_of(counts)[1]

    def corr(i: int, j: int) -> Column:
        mi, mj = F.col(f"sum{i}") / n, F.col(f"sum{j}") / n
        vi, vj = (F.greatest(F.col(f"square{x}") / n - m * m, F.lit(0.0)) for x, m in ((i, mi), (j, mj)))
        return (F.col(f"product{i}{j}") / n - mi * mj) / F.greatest(F.sqrt(vi * vj), F.lit(1e-12))

    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), corr(i, j).alias("corr")) for i, j in pairs])
    return counts.select("latent", F.inline(each))


def regimes(rated: DataFrame, alive_above: float = 1e-4, universal_above: float = 0.9) -> DataFrame:
    """Flags universal, specific, dead and ambiguous of each latent; they may overlap."""
    n = sum(((F.col(f"firing{i}") > alive_above).cast("int") for i in range(1, streams_of(rated)[0])), (F.col("firing0") > alive_above).cast("int"))
    out = rated.withColumn("n_streams", n)
    out = out.withColumn("universal", (F.col("agreement") > universal_above) & (F.col("gate_rate") > alive_above))
    out = out.withColumn("specific", F.col("n_streams") == 1).withColumn("dead", F.col("n_streams") == 0)
    return out.withColumn("ambiguous", ~(F.col("universal") | F.col("specific") | F.col("dead")))


def alive(rated: DataFrame, alive_above: float = 1e-4) -> DataFrame:
    """Latents that fire above the threshold in one stream at least; being gated isn't enough."""
    return rated.where(F.greatest(*[F.col(f"firing{i}") for i in range(streams_of(rated)[0])]) > alive_above)


def firing_histogram(values: DataFrame, column: str, bins: int = 59) -> DataFrame:
    """Counts over bins equal in log10 from 1e-6 to 1; smaller values count as 1e-6, the last bin is closed."""
    place = F.floor((F.log10(F.greatest(F.col(column), F.lit(1e-6))) + 6.0) * bins / 6.0 + 1e-9)
    return values.select(F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def even_histogram(values: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Counts over equal bins from the smallest to the largest value, the last one closed."""
    ends = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    width = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300))
    place = F.floor((F.col(column) - F.col("lo")) / width * bins + 1e-9)
    return values.crossJoin(F.broadcast(ends)).select(F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
