"""Tables and files in the folder that all machines of the cluster share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of input for each task that writes a table of bounded size.
PART, LEAST_PART = 16 << 20, 1 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Where it is unset and Spark runs on one machine, as in tests, a temporary folder takes its
    place; elsewhere that would not be shared, so it is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="actlens-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def redealt(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df``, an aggregate by ``key``, with the key under another name that Spark takes for a new value.

    A join on that name deals ``df`` anew, and only where both sides of a join are dealt for it may Spark split the
    other side's hot keys over several tasks.
    """
    return df.withColumn(name, F.col(key).bitwiseXOR(F.lit(0).cast("long"))).drop(key)


class Scratch:
    """A folder of intermediate tables below the shared one.

    ``save`` writes a table and returns it as read again, which cuts its lineage: a lost executor
    then costs a reread, not a recomputation. ``drop`` removes a table that is no longer needed.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/actlens/{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.close)

    def _fs(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def size(self, name: str) -> int:
        """Bytes of a saved table."""
        fs, where = self._fs(self.path(name))
        return fs.getContentSummary(where).getLength() if fs.exists(where) else 0

    def fit(self, df: DataFrame, of: tuple[str, ...] = (), times: int = 1, like: DataFrame | None = None) -> DataFrame:
        """``df`` in no more tasks than its size is worth, instead of one for each shuffle partition: no crowd of small files.

        Its bytes are at most ``times`` those of the saved tables ``of``, or about those of ``like``. There is a task for each
        ``PART`` bytes; as many as there are cores, if that is more and leaves each ``LEAST_PART`` bytes.
        """
        bound = int(str(like._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if like is not None else times * sum(map(self.size, of))
        return df.coalesce(min(max(bound // PART, min(self.spark.sparkContext.defaultParallelism, bound // LEAST_PART)) + 1, 1 << 20))

    def save(self, df: DataFrame, name: str, of: tuple[str, ...] | None = None, times: int = 1, like: DataFrame | None = None, compression: str = "snappy") -> DataFrame:
        """Writes and rereads a table, fitted if ``of`` or ``like`` is given; the shuffle files that only this write needed go at once."""
        if of is not None or like is not None:
            df = self.fit(df, of or (), times, like)
        conf, before = self.spark.conf, self.spark.conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").options(**{"compression": compression, "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}).parquet(self.path(name))
        finally:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def write_bytes(self, name: str, chunks) -> str:
        """Writes a file from an iterable of bytes and returns its URI."""
        fs, where = self._fs(self.path(name))
        out = fs.create(where, True)
        try:
            for chunk in chunks:
                out.write(bytearray(chunk))
        finally:
            out.close()
        return fs.makeQualified(where).toString()

    def drop(self, *names: str) -> None:
        for name in names:
            fs, where = self._fs(self.path(name))
            fs.delete(where, True)

    def close(self) -> None:
        try:
            self.drop("")
        except Exception:  # noqa: BLE001  the JVM may be gone when the interpreter ends
            pass
