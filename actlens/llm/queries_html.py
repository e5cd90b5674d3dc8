"""The query of HTML extraction over ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from actlens.llm.htmltext import extract_text


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", "n_chars")
