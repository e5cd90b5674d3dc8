"""Mixing sources to target weights by entropy balancing.

Documents get rates w that stay as close as they can, in relative entropy weighted by size, to their
prior rates q, under one constraint for each source: the sum of size * w is the source's target. The
solution is exponentially tilted, w = min(cap, q * exp(t)) with a multiplier t for each source, which
is found by Newton's method on the convex dual. A step needs, for each source, the tilted sum and its
derivative; both depend on documents only through the total size of each (source, prior), so one
aggregation of the corpus serves all steps, and the steps run on that table.

Rates are rounded into copies: the whole part, and one more copy for documents whose hash, divided
by the fraction, lies below a threshold near 1. The threshold is set for each source by two levels of
histograms of the hashes, so that the words taken meet the target up to about one document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actlens.llm.scratch import Scratch
from actlens.llm.words import text_parts

BINS = 4096
#: Sources up to which their table is broadcast, about 10 MB; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """The number of words of a text; null: 0. Only the text goes to Python."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = np.zeros(256, bool)
        table[[0x20, 9, 10, 11, 12, 13]] = True
        for texts in batches:
            n = np.zeros(len(texts), np.int64)
            for at, data, offsets in text_parts(texts):
                space = table[data]
                begins = ~space
                begins[1:] &= space[:-1]
                edge = offsets[:-1][offsets[:-1] < len(data)]
                begins[edge] = ~space[edge]
                sums = np.concatenate(([0], np.cumsum(begins)))
                n[at : at + len(offsets) - 1] = sums[offsets[1:]] - sums[offsets[:-1]]
            yield pa.array(n)

    return F.arrow_udf(run, T.LongType())(text.cast("string"))


def source_targets(totals: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Adds ``target`` to (source, source_size), one row for each source.

    Sources by code point, null last, have the weights in turn, and share ``share`` of the total size by
    them. A target stops at ``cap`` times its source's size, and the excess is shared by weight among
    the others until none is above: all targets are min(cap * size, weight * level) for one level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = totals.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rows = rows.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    rows = rows.withColumn("capped", F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("rest", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("level", (F.col("total") - F.col("capped")) / F.col("rest"))
    # The lowest source, by the level at which it is full, that the level of those from it on doesn't fill.
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.row_number().over(by_level).alias("k"), "level"))
    rows = rows.withColumn("fits", fits)
    rows = rows.withColumn("level", F.coalesce(F.min("fits").over(everything)["level"], F.max(F.col("most") / F.col("weight")).over(everything)))
    return rows.select("source", "source_size", F.least("most", F.col("weight") * F.col("level")).alias("target"))


def tilt(cells: DataFrame, targets: DataFrame, cap: float, scratch: Scratch, tolerance: float = 1e-10, max_steps: int = 60) -> DataFrame:
    """(key, multiplier) of each source: Newton's method on the dual.

    ``cells`` has (key, prior, size) and is the saved table of that name, ``targets`` (key, target). A source without size, or with target 0, has
    a null multiplier: its rate is 0.
    """
    state = targets.select("key", "target", F.lit(0.0).alias("t"), F.lit(1.0).alias("off"))
    state = scratch.save(state, "tilt-0", ("cells",))
    for i in range(1, max_steps + 1):
        rate = F.col("prior") * F.exp("t")
        free = rate < cap
        sums = cells.join(state, "key").groupBy("key", "target", "t").agg(F.sum(F.col("size") * F.least(rate, F.lit(float(cap)))).alias("have"), F.sum(F.when(free, F.col("size") * rate).otherwise(0.0)).alias("slope"))
        gap = F.col("have") - F.col("target")
        # Beyond the capped part, Newton's step; where all rates are at the cap there is nothing left to gain upwards.
        step = F.when(F.col("slope") > 0, gap / F.col("slope")).when(gap > 0, F.lit(1.0)).otherwise(0.0)
        off = F.when((F.col("slope") <= 0) & (gap <= 0), 0.0).otherwise(F.abs(gap) / F.greatest("target", F.lit(1e-300)))
        state = scratch.save(sums.select("key", "target", (F.col("t") - F.greatest(F.least(step, F.lit(2.0)), F.lit(-2.0))).alias("t"), off.alias("off")), f"tilt-{i}", ("cells",))
        scratch.drop(f"tilt-{i - 1}")
        worst = state.where("target > 0").agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance:
            break
    return state.select("key", F.when(F.col("target") > 0, F.col("t")).alias("multiplier"))


def lots(rows: DataFrame) -> DataFrame:
    """Adds ``base``, the whole part of ``rate``, and ``lot``: below 1 with the fraction's probability, null without a fraction."""
    base = F.floor(F.col("rate") + 1e-9)
    part = F.col("rate") - base
    return rows.withColumns({"base": base, "lot": F.when(part > 1e-9, F.least(F.col("hash") / part, F.lit(3.999999999)))})


def edges(rows: DataFrame, goals: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, edge): the lot below which a row gets one more copy, so that each source's words meet its target.

    ``rows`` has (key, size, base, lot), ``goals`` (key, target).
    """
    need = rows.groupBy("key").agg(F.sum(F.col("size") * F.col("base")).alias("sure")).join(goals, "key").select("key", (F.col("target") - F.col("sure")).alias("need"))

    def cut(rows: DataFrame, need: DataFrame) -> DataFrame:
        """(key, bin, rest, bin_size): the first bin in which the need is reached, and what it is to give."""
        bins = rows.groupBy("key", "bin").agg(F.sum("size").alias("size"))  # BINS rows a source at most
        running = F.sum("size").over(Window.partitionBy("key").orderBy("bin"))
        bins = bins.withColumn("upto", running).join(need, "key").where("upto >= need AND need > 0")
        first = bins.groupBy("key").agg(F.min(F.struct("bin", "upto", "size", "need")).alias("x"))
        return first.select("key", F.col("x.bin").alias("bin"), (F.col("x.need") - (F.col("x.upto") - F.col("x.size"))).alias("rest"), F.col("x.size").alias("bin_size"))

    place = F.col("lot") * (BINS / 4)
    loose = rows.where("lot IS NOT NULL")
    coarse = scratch.save(cut(loose.withColumn("bin", F.floor(place).cast("int")), need), "coarse", ("sizes",))
    inner = loose.join(small(coarse.select("key", F.col("bin").alias("outer"))), "key").where(F.floor(place) == F.col("outer"))
    inner = inner.withColumn("bin", F.floor((place - F.col("outer")) * BINS).cast("int"))
    fine = scratch.save(cut(inner, coarse.select("key", F.col("rest").alias("need"))), "fine", ("sizes",))
    # The bin in which the need is reached counts if more than half of it is needed.
    found = coarse.select("key", "bin").join(fine.select("key", F.col("bin").alias("fine"), (F.col("rest") * 2 > F.col("bin_size")).cast("int").alias("one")), "key", "left")
    found = found.select("key", ((F.col("bin") + (F.coalesce("fine", F.lit(0)) + F.coalesce("one", F.lit(0))) / F.lit(float(BINS))) * F.lit(4.0 / BINS)).alias("edge"))
    # A need beyond all loose rows takes them all.
    short = loose.groupBy("key").agg(F.sum("size").alias("all")).join(need, "key").where("need > all").select("key", F.lit(5.0).alias("edge"))
    return found.join(short.select("key"), "key", "left_anti").union(short)


def small(df: DataFrame) -> DataFrame:
    """Broadcast if it has one row for each of at most ``BROADCAST_SOURCES`` sources; joined by a shuffle with the same result beyond."""
    return F.broadcast(df) if df.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else df


def unit_hash(*columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit("mix")), 11) / F.lit(float(1 << 53))


def source_key() -> Column:
    """A source's name with which joins match nulls too."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def rated(rows: DataFrame, goals: DataFrame, cap: float) -> DataFrame:
    """Adds source_size, target, rate and hash to rows with key, doc_id, source, size and prior."""
    rate = F.coalesce(F.least(F.col("prior") * F.exp("multiplier"), F.lit(float(cap))), F.lit(0.0))
    out = rows.join(small(goals.select("key", "source_size", "target", "multiplier")), "key")
    return out.withColumns({"rate": rate, "hash": unit_hash(F.col("doc_id"), F.col("source"), F.col("size"))}).drop("multiplier")


def mix_sources(docs: DataFrame, scratch: Scratch, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, cap: float = 3.0, prior: Column | None = None, keep_text: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target, rate, copies and taken; without text unless ``keep_text``.

    size is the text's number of words (null: 0), taken is size * copies. Null sources are one source, the
    last. ``prior`` is a column of prior rates, 1 by default; a null or negative one is 0. Rows repeated with one doc_id,
    source and size get as many copies each; a null doc_id is a value like others. A source whose texts are all empty has
    target 0, and its rows no copies. ``cap`` must be a whole number, so that copies don't exceed it. Reruns on equal rows
    agree. An empty table stays empty. Columns already named as the new ones are replaced; all others stay, whatever
    their names.
    """
    if cap != int(cap):
        raise ValueError("cap must be a whole number")
    new = ("size", "source_size", "target", "rate", "copies", "taken")
    one = F.lit(1.0) if prior is None else F.greatest(F.coalesce(prior.cast("double"), F.lit(0.0)), F.lit(0.0))
    columns = [c for c in docs.columns if c not in new and (keep_text or c != "text")]
    slim = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), one.alias("prior"))
    rows = scratch.save(slim.withColumn("key", source_key()), "sizes")
    cells = scratch.save(rows.where("size > 0").groupBy("key", "prior").agg(F.sum("size").alias("size")), "cells", ("sizes",))
    totals = scratch.save(rows.groupBy("key", "source").agg(F.sum("size").alias("source_size")), "totals", ("sizes",))
    targets = scratch.save(source_targets(totals.select("source", "source_size"), weights, share, cap).withColumn("key", source_key()), "targets", ("totals",))
    goals = scratch.save(targets.join(tilt(cells, targets, cap, scratch), "key", "left"), "goals", ("totals",))
    edge = scratch.save(edges(lots(rated(rows, goals, cap)), goals.select("key", "target"), scratch), "edge", ("totals",))
    if set(columns) <= {"doc_id", "source"}:
        row = F.struct(*(F.col(c) for c in columns)) if columns else F.struct(F.lit(1))
        rows = rows.withColumn("row", row)
    else:
        rows = docs.select(F.struct(*columns).alias("row"), "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), one.alias("prior")).withColumn("key", source_key())
    out = lots(rated(rows, goals, cap)).join(small(edge), "key", "left")
    extra = F.coalesce(F.col("lot") < F.col("edge"), F.lit(False)).cast("int")
    out = out.withColumn("copies", (F.col("base") + extra).cast("int"))
    return out.select(*(F.col("row")[c].alias(c) for c in columns), "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
