"""The same rows from an unbounded source: documents in, aligned rows and count-based batches out.

Chunking and alignment work within a row, so they run unchanged on a stream. Batches of a fixed number
of rows need the number of rows before: ``CountBatches`` keeps it with the output, in one atomic step for
each micro-batch, so that a restart after a failure neither repeats nor skips a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actlens.operators.align import MAX_WINDOW, align_chunks
from actlens.operators.chunk import paragraph_chunks

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def document_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def aligned_stream(docs: DataFrame, max_tokens: int = 512, streams: Sequence[int] = (0, 1, 2), max_window: int = MAX_WINDOW) -> DataFrame:
    """Aligned rows of a batch or streaming table of documents."""
    return align_chunks(paragraph_chunks(docs, max_tokens), streams, max_window)


class CountBatches:
    """A ``foreachBatch`` sink that numbers rows on and writes whole batches of ``batch_rows``.

    Below ``path``, ``rows/epoch=N`` holds what micro-batch N added, with global row numbers ``pos_id``, and
    ``state/epoch=N`` how many rows there are after it. A micro-batch that is run again overwrites its own folders.
    """

    def __init__(self, spark: SparkSession, path: str, batch_rows: int, steps_per_epoch: int | None = None):
        self.spark, self.path, self.batch_rows, self.steps_per_epoch = spark, path.rstrip("/"), batch_rows, steps_per_epoch

    def __len__(self) -> int:
        """Batches of an epoch; an unbounded stream has no length."""
        if self.steps_per_epoch is None:
            raise TypeError("an unbounded stream has no length; set steps_per_epoch")
        return self.steps_per_epoch

    def epoch(self, number: int, first_batch: int = 0) -> DataFrame:
        """Whole batches of an epoch, counted from 0 after ``first_batch``; rows go on from one epoch to the next."""
        start = first_batch + number * len(self)
        return self.batches().where((F.col("batch_id") >= start) & (F.col("batch_id") < start + len(self)))

    def _state(self) -> DataFrame | None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/state")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return None
        return self.spark.read.schema("epoch long, n_rows long").parquet(f"{self.path}/state")

    def before(self, epoch: int) -> int:
        state = self._state()
        return 0 if state is None else (state.where(F.col("epoch") < epoch).agg(F.max("n_rows")).first()[0] or 0)

    def __call__(self, rows: DataFrame, epoch: int) -> None:
        start = self.before(epoch)
        counts = rows.groupBy("doc_id", "chunk_idx").agg(F.count("*").alias("n"))
        # One row for each chunk of the micro-batch is numbered in order; rows follow their chunk.
        chunk = counts.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("doc_id", "chunk_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        out = rows.join(chunk, ["doc_id", "chunk_idx"]).withColumn("pos_id", F.col("first") + F.col("k") + start).drop("n", "first")
        out.write.mode("overwrite").parquet(f"{self.path}/rows/epoch={epoch}")
        n = self.spark.read.parquet(f"{self.path}/rows/epoch={epoch}").count()
        self.spark.createDataFrame([(start + n,)], "n_rows long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state/epoch={epoch}")

    def batches(self) -> DataFrame:
        """All rows of whole batches, with ``batch_id``; the ragged tail waits for more rows."""
        state = self._state()
        total = 0 if state is None else state.agg(F.max("n_rows")).first()[0] or 0
        rows = self.spark.read.parquet(f"{self.path}/rows").withColumn("batch_id", F.floor(F.col("pos_id") / self.batch_rows))
        return rows.where(F.col("batch_id") < total // self.batch_rows)


def split_validation(batches: DataFrame, n_rows: int, batch_rows: int) -> tuple[DataFrame, DataFrame]:
    """(validation, training): whole batches until at least ``n_rows``, and the rest."""
    first = -(-n_rows // batch_rows)
    return batches.where(F.col("batch_id") < first), batches.where(F.col("batch_id") >= first)
