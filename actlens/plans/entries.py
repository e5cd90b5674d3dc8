"""Whole runs: documents to a store, by aligned streams or by one shared tokenizer; a store to a trained model.

A run goes on where the one before stopped, ends at its target, and can be asked to end between two steps. Models come as
functions from a chunk's tokens to vectors (``extract``) and numbers (``token_id``).
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.functions.text import file_slug_of
from actlens.operators import align, chunk
from actlens.operators.model import Model
from actlens.operators.train import calibrate, train
from actlens.sources.stop import StopOnSignal
from actlens.sources.store import Store, StoreConfig, split_shard_ids, work_dir
from actlens.sources.types import spark_type

log = logging.getLogger("actlens")
Extract = Callable[[int, list[str]], np.ndarray]


def setup_logging(level: int = logging.INFO) -> None:
    logging.basicConfig(level=level, format="%(asctime)s | %(levelname)s | %(message)s")


def for_streams(names: Sequence[str], values: Sequence[str]) -> list[str]:
    """A value for each stream; one alone stands for all, any other number is an error."""
    if len(values) == 1:
        return list(values) * len(names)
    if len(values) != len(names):
        raise ValueError("there must be one value, or one for each stream")
    return list(values)


def config_of(names: Sequence[str], hidden: Sequence[int], hooks: Sequence[str], **how) -> StoreConfig:
    slugs = [file_slug_of(n) for n in names]
    if len(set(slugs)) < len(slugs):
        raise ValueError("two names give one column name")
    return StoreConfig(models=[{"name": n, "slug": s, "hidden_size": d, "hook_point": h} for n, s, d, h in zip(names, slugs, hidden, for_streams(names, hooks), strict=True)], **how)


def preprocess_aligned(spark: SparkSession, docs: DataFrame, root: str, config: StoreConfig, extract: Extract, token_id: Extract, target: int, max_tokens: int = 512, shards_a_step: int = 64, streams: Sequence[int] = (0, 1, 2), stop: StopOnSignal | None = None) -> int:
    """Writes aligned positions up to ``target`` into the store at ``root``; returns how many it holds.

    Positions have a fixed order (document, chunk, match), so those committed before are passed over. All documents are aligned
    once to count positions, and those with a position that is wanted once more, into a table; steps of ``shards_a_step`` shards
    are appended from it, as the order of its files lets each step read its part.
    """
    store = Store(spark, root)
    store.write_config(config)
    done = store.committed()[0]
    if done >= target:
        return done
    rows = align.gather_positions(docs, max_tokens, streams, extract, token_id, config.max_window, done, target)
    tokens = [F.col("last_tok")[i].cast(spark_type(config.token_dtype)).alias(f"last_tok_{m['slug']}") for i, m in enumerate(config.models)]
    values = [F.col("vectors")[f"v{s}"].cast(f"array<{spark_type(config.dtype)}>").alias(f"model_{m['slug']}") for s, m in zip(streams, config.models, strict=True)]
    return _append(store, rows.select("pos_id", *tokens, *values), config.shard_size_tokens, shards_a_step, stop)


def preprocess_shared(spark: SparkSession, docs: DataFrame, root: str, config: StoreConfig, extract: Extract, token_id: Extract, target: int, length: int = 256, shards_a_step: int = 64, eos: str | None = "<eos>", stop: StopOnSignal | None = None) -> int:
    """The same with one tokenizer for all models: documents' tokens in windows of ``length``, a vector of each model a token.

    ``extract`` gets the number of the model. The target is rounded down to whole windows, of which a model sees one at a time.
    """
    store = Store(spark, root)
    store.write_config(config)
    done, target = store.committed()[0], target // length * length
    if done >= target:
        return done
    rows = chunk.token_windows(docs, length, eos=eos).where((F.col("seq") >= done // length) & (F.col("seq") < target // length))
    windows = rows.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("w"))  # ``length`` rows each
    n = len(config.models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for seq, pieces in zip(b.column("seq").to_pylist(), b.column("pieces").to_pylist(), strict=True):
                vectors = [np.asarray(extract(i, pieces), np.float32) for i in range(n)]
                columns = [pa.ListArray.from_arrays(pa.array(np.arange(len(pieces) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.reshape(-1))) for v in vectors]
                yield pa.RecordBatch.from_arrays([pa.array(seq * length + np.arange(len(pieces))), pa.array(np.asarray(token_id(0, pieces), np.int64)), *columns], names=["pos_id", "token", *(f"v{i}" for i in range(n))])

    made = windows.select("seq", F.col("w.piece").alias("pieces")).mapInArrow(run, "pos_id long, token long, " + ", ".join(f"v{i} array<float>" for i in range(n)))
    token = F.col("token").cast(spark_type(config.token_dtype))
    columns = [c for i, m in enumerate(config.models) for c in (token.alias(f"last_tok_{m['slug']}"), F.col(f"v{i}").cast(f"array<{spark_type(config.dtype)}>").alias(f"model_{m['slug']}"))]
    return _append(store, made.select("pos_id", *columns), config.shard_size_tokens, shards_a_step, stop)


def _append(store: Store, rows: DataFrame, shard_size: int, shards_a_step: int, stop: StopOnSignal | None) -> int:
    where = work_dir(store.spark, "rows")
    rows.write.parquet(where)
    made, step = store.spark.read.parquet(where), shard_size * shards_a_step
    end = made.agg(F.max("pos_id")).first()[0]
    while end is not None and (done := store.committed()[0]) <= end:
        if stop is not None and stop.stop:
            log.warning("asked to stop: %s positions are committed", done)
            break
        part = made.where((F.col("pos_id") >= done) & (F.col("pos_id") < done + step))
        store.append(part.withColumn("pos_id", F.col("pos_id") - done), shard_size)
        log.info("positions committed: %s", min(done + step, end + 1))
    fs, at = store.place(where)
    fs.delete(at, True)
    return store.committed()[0]


def train_on_store(spark: SparkSession, root: str, checkpoint: str, latents: int, k: int, batch: int = 4096, epochs: int = 1, valid: float = 0.02, calibration_batches: int = 256, seed: int = 42, rate: float = 3e-4, **how) -> tuple[Model, list[float], dict]:
    """Trains on the store's shards but the held-out ones, saves the weights; returns model, losses and held-out figures.

    ``how`` goes to :meth:`Model.create`. A batch is one scan of its shard's part; scales are calibrated on the first batches.
    """
    from actlens.operators.report import evaluation

    store = Store(spark, root)
    names = [m["name"] for m in store.config().models]
    ids = [r.shard_index for r in store.manifest().collect()]  # a row for each shard
    own, held = split_shard_ids(ids, valid, seed) if len(ids) > 1 else (ids, [])
    model = Model.create(store.stream_dims(), latents, k, seed=seed, **how)
    batches = store.training_batches(names, batch, seed, shards=own)
    if not batches:
        raise ValueError("no whole batch in the store")
    first = batches[0]
    for b in batches[1:calibration_batches]:
        first = first.unionAll(b)
    calibrate(model, first)
    losses = train(model, batches, epochs, rate, seed=seed)
    model.save(spark, checkpoint)
    return model, losses, evaluation(store.vectors(names, held), model) if held else {}
