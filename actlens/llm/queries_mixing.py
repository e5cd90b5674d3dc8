"""The query of source mixing over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from actlens.llm.mixing import mix_sources
from actlens.llm.scratch import Scratch


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs, Scratch(spark, "mixing")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
