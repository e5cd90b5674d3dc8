"""Paragraph packing and fixed-length token windows."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actlens.functions.text import PIECES, paragraphs, pieces


def paragraph_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, para_idx, para, n_tok): stripped non-empty paragraphs with their token counts."""
    rows = docs.where("text IS NOT NULL AND text <> ''").select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("para_idx", "para"))
    return rows.withColumn("n_tok", F.size(pieces(F.col("para"), 0)))


def paragraph_chunks(docs: DataFrame, max_tokens: int) -> DataFrame:
    """(doc_id, chunk_idx, chunk_text, n_tok): paragraphs packed in order into chunks of at most ``max_tokens`` tokens.

    A paragraph longer than a chunk is left out, and the open chunk stays open; a line feed joins paragraphs and
    counts as one token. Chunks don't span documents. A fold within each row: no shuffle.
    """
    pattern = PIECES[0].replace("\\", "\\\\").replace("'", "\\'")
    fold = f"""
      aggregate(
        transform(paras, p -> struct(p AS t, size(regexp_extract_all(p, '{pattern}', 0)) AS n)),
        struct(cast(NULL AS string) AS cur, 0 AS len, cast(array() AS array<struct<t: string, n: int>>) AS done),
        (acc, p) -> CASE
          WHEN p.n > {max_tokens} THEN acc
          WHEN acc.cur IS NULL THEN struct(p.t AS cur, p.n AS len, acc.done AS done)
          WHEN acc.len + 1 + p.n > {max_tokens} THEN struct(p.t AS cur, p.n AS len, concat(acc.done, array(struct(acc.cur AS t, acc.len AS n))) AS done)
          ELSE struct(concat(acc.cur, '\\n', p.t) AS cur, acc.len + 1 + p.n AS len, acc.done AS done) END,
        acc -> CASE WHEN acc.cur IS NULL THEN acc.done ELSE concat(acc.done, array(struct(acc.cur AS t, acc.len AS n))) END)"""
    rows = docs.where("text IS NOT NULL AND text <> ''").select("doc_id", paragraphs(F.col("text")).alias("paras")).select("doc_id", F.posexplode(F.expr(fold)).alias("chunk_idx", "c"))
    return rows.select("doc_id", "chunk_idx", F.col("c.t").alias("chunk_text"), F.col("c.n").alias("n_tok"))


def token_slices(docs: DataFrame, length: int, skip: int = 0, eos: str | None = "<eos>") -> DataFrame:
    """(seq, pos, pieces): all documents' tokens in order of doc_id, each followed by ``eos`` if there is one, cut into windows of ``length``.

    A row has what one document gives to one window, from place ``pos`` of the window on. The first ``skip`` tokens, consumed
    before, are passed over; the last short window is left out. Documents repeated with one doc_id are as many documents, in an
    order of their texts. Only counts pass through a sum over all; texts are shuffled once, into ranges of doc_id of bounded
    size, and cut into tokens after that.
    """
    rows = docs.where("text IS NOT NULL AND text <> ''").select("doc_id", F.xxhash64("text").alias("tie"), "text")
    spans = ranges(rows, "doc_id", F.octet_length("text"))
    rows, total = numbered(rows.withColumn("n", F.size(pieces(F.col("text"), 0)).cast("long") + int(eos is not None)), ["doc_id", "tie"], "n", spans)
    end = F.array(F.lit(eos)) if eos is not None else F.array().cast("array<string>")
    rows = rows.withColumn("first", F.col("start") - skip).withColumn("stop", F.least(F.col("first") + F.col("n"), F.lit(max(total - skip, 0) // length * length)))
    rows = rows.where("stop > 0 AND stop > first").withColumn("low", F.greatest("first", F.lit(0)))

    def cut(toks: Column) -> Column:
        def part(seq: Column) -> Column:
            begin, after = F.greatest(seq * length, F.col("low")), F.least((seq + 1) * length, F.col("stop"))
            return F.struct(seq.alias("seq"), (begin - seq * length).cast("int").alias("pos"), F.slice(toks, (begin - F.col("first") + 1).cast("int"), (after - begin).cast("int")).alias("pieces"))

        return F.transform(F.sequence(F.floor(F.col("low") / length), F.floor((F.col("stop") - 1) / length)), part)

    toks = F.array(F.concat(pieces(F.col("text"), 0), end))  # bound by a lambda, so that a document is cut into tokens once
    return rows.select(F.inline(F.element_at(F.transform(toks, cut), 1)))


def token_windows(docs: DataFrame, length: int, skip: int = 0, eos: str | None = "<eos>") -> DataFrame:
    """(seq, pos, piece): the tokens of :func:`token_slices`, a row each."""
    rows = token_slices(docs, length, skip, eos).select("seq", "pos", F.posexplode("pieces").alias("i", "piece"))
    return rows.select("seq", (F.col("pos") + F.col("i")).alias("pos"), "piece")


#: Bytes of text for each range of keys, the least for one more, and how many ranges there may be: their bounds are in the plan.
PART, LEAST_PART, MOST = 8 << 20, 1 << 20, 1 << 14


@dataclass(frozen=True)
class Ranges:
    """Ranges of a number, cut at ``bounds``, each of which begins a range; null counts as the least number."""

    bounds: list[int]

    def __len__(self) -> int:
        return len(self.bounds) + 1

    def of(self, key: Column) -> Column:
        """A number's range: first among groups of ranges, then in the group."""
        step = max(int(len(self.bounds) ** 0.5), 1)
        groups = [self.bounds[i : i + step] for i in range(0, len(self.bounds), step)]
        lists = [f"array({', '.join(f'{x}L' for x in g)})" for g in groups]
        if not groups:
            return F.lit(0)
        group = F.size(F.filter(F.expr(f"array({', '.join(f'{g[0]}L' for g in groups[1:])})").cast("array<bigint>"), lambda x: key >= x))
        own = F.element_at(F.expr(f"array({', '.join(lists)})"), group + 1)
        return group * step + F.size(F.filter(own, lambda x: key >= x))

    def within(self, key: Column, low: int, high: int) -> Column:
        """Whether a number lies in one of the ranges from ``low`` to ``high``."""
        at_least = key >= self.bounds[low - 1] if low else F.lit(True)
        below = key.isNull() | (key < self.bounds[high]) if high < len(self.bounds) else F.lit(True)
        return at_least & below


def quantiles(rows: DataFrame, key: str, n: int) -> Ranges:
    """About ``n`` ranges of ``key`` with as many rows each."""
    found = rows.approxQuantile(key, [i / n for i in range(1, n)], min(0.01, 0.25 / n)) if n > 1 else []
    return Ranges(sorted({int(x) for x in found}))


def ranges(rows: DataFrame, key: str, size: Column) -> Ranges:
    """Ranges of ``key`` for tasks of about ``PART`` bytes, so that a task's part doesn't grow with the table; ``size`` gives a row's bytes."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return quantiles(rows, key, min(max(total // PART, min(cores, total // LEAST_PART)) + 1, MOST))


def sums(rows: DataFrame, key: str, n: str, spans: Ranges) -> list[int]:
    """The sum of ``n`` in each range."""
    held = {r[0]: r[1] or 0 for r in rows.groupBy(spans.of(F.col(key)).alias("_b")).agg(F.sum(n)).collect()}  # a row for each range
    return [held.get(b, 0) for b in range(len(spans))]


def numbered(rows: DataFrame, order: list[str], n: str, spans: Ranges) -> tuple[DataFrame, int]:
    """``rows`` with ``start``, the exclusive running sum of ``n`` in ``order``, and the sum of all; a task for each range of the first column of ``order``."""
    before = list(accumulate(sums(rows, order[0], n, spans), initial=0))
    base = F.element_at(F.expr(f"array({', '.join(f'{x}L' for x in before)})"), F.col("_b") + 1)
    rows = rows.withColumn("_b", spans.of(F.col(order[0]))).repartitionById(len(spans), F.col("_b"))
    inner = Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(n).over(inner), F.lit(0)) + base).drop("_b"), before[-1]


def running(rows: DataFrame, order: list[str], n: str = "n", buckets: int = 64) -> DataFrame:
    """``rows`` with ``start``: the exclusive running sum of ``n`` in ``order``, without one task for all rows.

    Rows are dealt into ranges of the first column of ``order``, a number; each range is summed up in its own task, and
    the ranges' totals, one row for each, on the driver. Rows that ``order`` doesn't tell apart come in any order.
    """
    return numbered(rows, order, n, quantiles(rows, order[0], buckets))[0]


def offsets(counts: DataFrame, key: str = "doc_id", n: str = "n", buckets: int = 64) -> DataFrame:
    """(key, start): the exclusive running sum of ``n`` in order of ``key``."""
    return running(counts.select(key, n), [key], n, buckets).select(key, "start")
