"""Command line: ``python -m actlens <run> ...``, on the Spark that ``spark-submit`` or the environment configures.

``--models`` names, as ``module:attribute``, a pair of functions (vectors, numbers) of a stream's number and its tokens.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession

from actlens.operators import report
from actlens.plans import entries
from actlens.sources.stop import StopOnSignal
from actlens.sources.store import Store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="actlens")
    runs = top.add_subparsers(dest="run", required=True)
    for name in ("aligned", "shared"):
        p = runs.add_parser(name, help=f"documents to a store, by {'aligned streams' if name == 'aligned' else 'one shared tokenizer'}")
        p.add_argument("--documents", required=True)
        p.add_argument("--store", required=True)
        p.add_argument("--model-names", nargs="+", required=True)
        p.add_argument("--hidden-sizes", nargs="+", type=int, required=True)
        p.add_argument("--hook-points", nargs="+", required=True)
        p.add_argument("--models", required=True)
        p.add_argument("--target", type=int, required=True)
        p.add_argument("--length", type=int, default=512 if name == "aligned" else 256)
        p.add_argument("--shard-size", type=int, default=262_144)
        p.add_argument("--dtype", default="float32")
        p.add_argument("--token-dtype", default="int32")
        p.add_argument("--max-window", type=int, default=16)
    t = runs.add_parser("train", help="a model on a store")
    t.add_argument("--store", required=True)
    t.add_argument("--checkpoint", required=True)
    for flag, kind, default in (("latents", int, 16_384), ("k", int, 128), ("batch", int, 4096), ("epochs", int, 1), ("rate", float, 3e-4), ("valid", float, 0.02), ("rank", int, 0), ("auxk", int, 0), ("dead-after", int, 1000), ("seed", int, 42)):
        t.add_argument(f"--{flag}", type=kind, default=default)
    for name in ("evaluate", "report"):
        p = runs.add_parser(name, help="figures of a checkpoint on a store, as JSON")
        p.add_argument("--store", required=True)
        p.add_argument("--checkpoint", required=True)
        p.add_argument("--output", required=True)
        p.add_argument("--model-names", nargs="+")
        p.add_argument("--k", type=int, default=128)
        p.add_argument("--positions", type=int)
    return top


def functions_of(path: str) -> tuple:
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def vectors(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, list[str]]:
    store = Store(spark, args.store)
    names = args.model_names or list(store.stream_dims())
    return store.vectors(names), names


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    entries.setup_logging()
    spark = spark or SparkSession.builder.appName("actlens").getOrCreate()
    if args.run in ("aligned", "shared"):
        extract, token_id = functions_of(args.models)
        config = entries.config_of(args.model_names, args.hidden_sizes, args.hook_points, shard_size_tokens=args.shard_size, dtype=args.dtype, token_dtype=args.token_dtype, max_window=args.max_window, alignment_mode=args.run)
        docs = spark.read.parquet(args.documents)
        with StopOnSignal() as stop:
            if args.run == "aligned":
                n = entries.preprocess_aligned(spark, docs, args.store, config, extract, token_id, args.target, args.length, streams=range(len(args.model_names)), stop=stop)
            else:
                n = entries.preprocess_shared(spark, docs, args.store, config, extract, token_id, args.target, args.length, stop=stop)
        print(f"positions in the store: {n}")
    elif args.run == "train":
        _, losses, held = entries.train_on_store(spark, args.store, args.checkpoint, args.latents, args.k, args.batch, args.epochs, args.valid, seed=args.seed, rate=args.rate, rank=args.rank, auxk=args.auxk, dead_after=args.dead_after)
        print("\n".join([*(f"epoch {i + 1}: loss {v:.4f}" for i, v in enumerate(losses)), *report.lines(held)]))
    else:
        rows, names = vectors(spark, args)
        if args.run == "evaluate":
            print("\n".join(report.lines(report.evaluate_checkpoint(spark, args.checkpoint, rows, args.k, args.output, names, args.positions))))
        else:
            got = report.report_checkpoint(spark, args.checkpoint, rows, args.k, args.output, names, max_positions=args.positions)
            print("\n".join(f"{k}: {v}" for k, v in got.items() if not isinstance(v, list)))


if __name__ == "__main__":
    main(sys.argv[1:])
