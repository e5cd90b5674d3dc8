"""The query of repeated passages over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from actlens.llm.scratch import Scratch
from actlens.llm.substring import passages


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return passages(docs, Scratch(spark, "substring")).drop("text_digest")
