"""The aligned store: vectors in shards of a fixed number of rows, with a manifest and a configuration.

Layout below a root: ``shards/shard_index=N/*.parquet`` (pos_id, last_tok_*, model_*), ``manifest/*.json``
and ``store_config.json``. The manifest is derived from what was written and appended after it, so a
shard is committed when its manifest line is there; a writer that starts again begins after the last one.
"""

from __future__ import annotations

import json
import random
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "shard_index int, token_start long, token_end long, num_tokens long"


@dataclass
class StoreConfig:
    models: list[dict] = field(default_factory=list)  # name, slug, hidden_size, hook_point
    shard_size_tokens: int = 262_144
    batch_size: int = 8
    dtype: str = "float32"
    token_dtype: str = "int32"
    alignment_mode: str = "none"
    max_window: int = 16
    prepend_bos: bool = False

    REQUIRED = ("dtype", "token_dtype", "batch_size", "shard_size_tokens", "models")

    @classmethod
    def parse(cls, text: str) -> StoreConfig:
        raw = json.loads(text)
        missing = [k for k in cls.REQUIRED if k not in raw]
        if missing:
            raise KeyError(f"missing in the configuration: {missing}")
        return cls(**{k: v for k, v in raw.items() if k in cls.__dataclass_fields__})


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file whole or not at all: beside its place first, then by a rename. One that is there is replaced."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(place(f"{path}.tmp"), True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(place(path)):
        fs.delete(place(path), False)
    if not fs.rename(place(f"{path}.tmp"), place(path)):
        raise OSError(f"can't write {path}")


class Store:
    """A store below ``root``, any URI that Spark can write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def place(self, path: str):
        """(file system, path) of any path."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _path(self, name: str):
        return self.place(f"{self.root}/{name}")

    def _exists(self, name: str) -> bool:
        fs, where = self._path(name)
        return fs.exists(where)

    def write_config(self, config: StoreConfig) -> StoreConfig:
        """Writes the configuration of a new store; that of an existing one must be equal."""
        if self._exists("store_config.json"):
            if (old := self.config()) != config:
                raise ValueError(f"the store has another configuration: {old}")
            return old
        write_text(self.spark, f"{self.root}/store_config.json", json.dumps(asdict(config), indent=2))
        return config

    def config(self) -> StoreConfig:
        rows = self.spark.read.text(f"{self.root}/store_config.json", wholetext=True).collect()
        return StoreConfig.parse(rows[0][0])

    def manifest(self) -> DataFrame:
        """Committed shards in order; no store yet is an empty table."""
        if not self._exists("manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest").orderBy("shard_index")

    def committed(self) -> tuple[int, int]:
        """(positions, next shard) from which a writer goes on."""
        row = self.manifest().agg(F.max("token_end"), F.max("shard_index")).first()
        return (row[0] or 0), (-1 if row[1] is None else row[1]) + 1

    def append(self, rows: DataFrame, shard_size: int) -> DataFrame:
        """Appends rows with ``pos_id`` counted from 0, in shards; returns their manifest.

        A writer never touches committed shards. What a run that broke off has left beyond them is removed first, so only
        the rows just written are committed. One writer at a time.
        """
        start, shard = self.committed()
        fs, where = self._path("shards")
        for status in fs.listStatus(where) if fs.exists(where) else ():
            name = status.getPath().getName()
            if name.startswith("shard_index=") and int(name.partition("=")[2]) >= shard:
                fs.delete(status.getPath(), True)
        placed = rows.withColumn("shard_index", (F.floor(F.col("pos_id") / shard_size) + shard).cast("int")).withColumn("pos_id", F.col("pos_id") + start)
        placed = placed.repartition("shard_index").sortWithinPartitions("shard_index", "pos_id")
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard_index").parquet(f"{self.root}/shards")
        new = shard_manifest(self.spark.read.parquet(f"{self.root}/shards").where(F.col("shard_index") >= shard))
        new.coalesce(1).write.mode("append").json(f"{self.root}/manifest")
        return new

    def scan(self, models: list[str] | None = None, shards: list[int] | None = None) -> DataFrame:
        """Committed rows with the columns of some models and, by partition pruning, of some shards."""
        rows = self.spark.read.parquet(f"{self.root}/shards").join(F.broadcast(self.manifest().select("shard_index").distinct()), "shard_index")
        if shards is not None:
            rows = rows.where(F.col("shard_index").isin(shards))
        if models is not None:
            known = {m["name"]: m["slug"] for m in self.config().models}
            if unknown := [m for m in models if m not in known]:
                raise KeyError(f"not in the store: {unknown}")
            wanted = [c for m in models for c in (f"last_tok_{known[m]}", f"model_{known[m]}") if c in rows.columns]
            rows = rows.select("shard_index", "pos_id", *wanted)
        return rows

    def shard_paths(self) -> DataFrame:
        """The manifest with each shard's folder in ``path``; no store yet is an error."""
        if not self._exists("manifest"):
            raise FileNotFoundError(f"no manifest below {self.root}")
        return self.manifest().withColumn("path", F.concat(F.lit(f"{self.root}/shards/shard_index="), F.col("shard_index").cast("string")))

    def read_range(self, start: int, end: int) -> DataFrame:
        """Rows of positions from ``start`` up to ``end``; the manifest says which shards are opened."""
        held = [r.shard_index for r in self.manifest().where((F.col("token_end") > start) & (F.col("token_start") < end)).collect()]
        return self.scan(shards=held).where((F.col("pos_id") >= start) & (F.col("pos_id") < end))


    def stream_dims(self) -> dict[str, int]:
        """Each model's vector length, as configured."""
        return {m["name"]: int(m["hidden_size"]) for m in self.config().models}

    def __len__(self) -> int:
        return self.committed()[0]

    def vectors(self, models: list[str], shards: list[int] | None = None) -> DataFrame:
        """(pos_id, x0, x1, ...): the models' vectors as doubles, as operators on codes take them."""
        slugs = {m["name"]: m["slug"] for m in self.config().models}
        columns = [F.col(f"model_{slugs[m]}").cast("array<double>").alias(f"x{i}") for i, m in enumerate(models)]
        return self.scan(models, shards).select("pos_id", *columns)

    def batches(self, models: list[str], batch: int, seed: int = 0, drop_last: bool = True, shards: list[int] | None = None) -> DataFrame:
        """Rows with ``batch_idx`` within their shard, and ``order_shard`` and ``order_batch``, by which batches come.

        The batch of a row follows from its place in the shard; only the manifest, a row for each shard, is joined.
        """
        starts = self.manifest().select("shard_index", "token_start", "num_tokens")
        rows = self.scan(models, shards).join(F.broadcast(starts), "shard_index")
        rows = rows.withColumn("batch_idx", F.floor((F.col("pos_id") - F.col("token_start")) / batch))
        if drop_last:
            rows = rows.where((F.col("batch_idx") + 1) * batch <= F.col("num_tokens"))
        return rows.drop("token_start", "num_tokens").withColumn("order_shard", scramble(F.col("shard_index"), seed)).withColumn("order_batch", scramble(F.col("batch_idx") + F.col("shard_index") * 7919, seed))

    def collated(self, models: list[str], batch: int, seed: int = 0, drop_last: bool = True, shards: list[int] | None = None) -> DataFrame:
        """A row for each batch: ``pos_ids``, and each model's tokens and vectors as arrays, in order of position."""
        rows = self.batches(models, batch, seed, drop_last, shards)
        data = [c for c in rows.columns if c.startswith(("last_tok_", "model_"))]
        sets = rows.groupBy("order_shard", "order_batch", "shard_index", "batch_idx").agg(F.sort_array(F.collect_list(F.struct("pos_id", *data))).alias("b"))  # ``batch`` rows each
        return sets.select("order_shard", "order_batch", "shard_index", "batch_idx", F.col("b.pos_id").alias("pos_ids"), *[F.col(f"b.{c}").alias(c) for c in data])

    def load(self, models: list[str], batch: int, seed: int = 0, drop_last: bool = True, shuffle: bool = True, shards: list[int] | None = None) -> Iterator[dict]:
        """Batches as arrays, ``{"tokens": {model: n}, "activations": {model: n x dims}}``, one partition of them at a time.

        In scrambled order of shards and of batches within a shard, the same for each epoch; without ``shuffle`` as stored.
        """
        slugs = {m["name"]: m["slug"] for m in self.config().models}
        order = ("order_shard", "shard_index", "order_batch", "batch_idx") if shuffle else ("shard_index", "batch_idx")
        for r in self.collated(models, batch, seed, drop_last, shards).orderBy(*order).toLocalIterator(prefetchPartitions=True):
            yield {"tokens": {m: np.array(r[f"last_tok_{slugs[m]}"]) for m in models}, "activations": {m: np.array(r[f"model_{slugs[m]}"], np.float32) for m in models}}

    def training_batches(self, models: list[str], batch: int, seed: int = 0, shards: list[int] | None = None) -> list[DataFrame]:
        """A table (pos_id, x0, x1, ...) for each whole batch, in scrambled order; each reads only its shard, by its positions."""
        plan = batch_plan(self.manifest(), batch, seed)
        if shards is not None:
            plan = plan.where(F.col("shard_index").isin(shards))
        first = {r.shard_index: r.token_start for r in self.manifest().collect()}
        rows = plan.orderBy("order_shard", "shard_index", "order_batch", "batch_idx").collect()  # a row for each step of an epoch
        each = {s: self.vectors(models, [s]) for s in {r.shard_index for r in rows}}
        return [each[r.shard_index].where((F.col("pos_id") >= first[r.shard_index] + r.start) & (F.col("pos_id") < first[r.shard_index] + r.start + batch)) for r in rows]


def shard_of(pos: Column, shard_size: int) -> Column:
    return F.floor(pos / shard_size).cast("int")


def shard_manifest(rows: DataFrame) -> DataFrame:
    """(shard_index, token_start, token_end, num_tokens) of rows with shard_index and pos_id."""
    return rows.groupBy("shard_index").agg(F.min("pos_id").alias("token_start"), (F.max("pos_id") + 1).alias("token_end"), F.count("*").alias("num_tokens")).select("shard_index", "token_start", "token_end", "num_tokens")


def running_offsets(manifest: DataFrame) -> DataFrame:
    """The manifest, one row a shard, with the exclusive running sum ``lo`` and its end ``hi``."""
    order = Window.orderBy("shard_index").rowsBetween(Window.unboundedPreceding, -1)
    lo = F.coalesce(F.sum("num_tokens").over(order), F.lit(0))
    return manifest.withColumn("lo", lo).withColumn("hi", lo + F.col("num_tokens"))


def locate(indexes: DataFrame, manifest: DataFrame, strict: bool = True) -> DataFrame:
    """(idx, shard_index, local): the place of each global index, by an equal join on ranges as long as the longest shard.

    An index out of range is an error, or left out if not ``strict``; a null one is left out.
    """
    places = running_offsets(manifest)
    size = manifest.agg(F.max("num_tokens")).first()[0] or 1
    ranges = places.where("num_tokens > 0").withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size))))
    rows = indexes.where("idx IS NOT NULL").withColumn("bin", F.floor(F.col("idx") / size))
    found = rows.join(ranges, (rows["bin"] == ranges["bin"]) & (F.col("idx") >= F.col("lo")) & (F.col("idx") < F.col("hi")), "left" if strict else "inner")
    shard = F.col("shard_index")
    if strict:
        shard = F.when(shard.isNotNull(), shard).otherwise(F.raise_error(F.concat(F.lit("index out of range: "), F.col("idx").cast("string"))).cast("int"))
    return found.select("idx", shard.alias("shard_index"), (F.col("idx") - F.col("lo")).alias("local"))


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset and Spark runs on one machine, a temporary one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="actlens-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/actlens/{label}-{uuid.uuid4().hex[:12]}"


def batch_plan(manifest: DataFrame, batch: int, seed: int = 0, drop_last: bool = True) -> DataFrame:
    """(shard_index, batch_idx, start, n_rows) of contiguous batches within shards, in a shuffled but fixed order.

    ``order_shard`` and ``order_batch`` sort it: shards by an arithmetic hash, then batches within the shard.
    """
    n = F.ceil(F.col("num_tokens") / batch)
    rows = manifest.where("num_tokens > 0").select("shard_index", "num_tokens", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("batch_idx"))
    rows = rows.withColumn("start", F.col("batch_idx") * batch).withColumn("n_rows", F.least(F.lit(batch).cast("long"), F.col("num_tokens") - F.col("start")))
    if drop_last:
        rows = rows.where(F.col("n_rows") == batch)
    return rows.select("shard_index", "batch_idx", "start", "n_rows", scramble(F.col("shard_index"), seed).alias("order_shard"), scramble(F.col("batch_idx") + F.col("shard_index") * 7919, seed).alias("order_batch"))


def scramble(x: Column, seed: int) -> Column:
    """An arithmetic hash that every engine can restate."""
    return F.pmod((x.cast("long") + 1 + seed) * F.lit(48271 * 69621), F.lit(2147483647)).cast("long")


def split_shards(manifest: DataFrame, fraction: float = 0.01, seed: int = 42) -> DataFrame:
    """(shard_index, is_valid): ceil(n * fraction) shards, at least one and not all, are for validation."""
    if not 0 < fraction < 1:
        raise ValueError("the fraction must lie between 0 and 1")
    n = F.count("*").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(scramble(F.col("shard_index"), seed), "shard_index"))
    size = F.least(F.greatest(F.lit(1), F.ceil(n * F.lit(fraction))), n - 1)
    return manifest.select("shard_index", (rank <= size).alias("is_valid"))


def split_shard_ids(ids: list[int], fraction: float = 0.01, seed: int = 42) -> tuple[list[int], list[int]]:
    """(train, valid) by Python's seeded shuffle of the shard list; at least two shards are needed."""
    if not 0 < fraction < 1 or len(ids) < 2:
        raise ValueError("a split needs two shards and a fraction between 0 and 1")
    order = list(ids)
    random.Random(seed).shuffle(order)
    n = min(max(1, -int(-len(order) * fraction // 1)), len(order) - 1)
    return sorted(order[n:]), sorted(order[:n])
