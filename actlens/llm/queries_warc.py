"""The query of the WARC writer over ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from actlens.llm.scratch import Scratch
from actlens.llm.warc import read_archives, write_archives


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    index = write_archives(pages, Scratch(spark, "warc"), min_revisit_bytes=0)
    return read_archives(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH raw AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
hashed AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, lower(sha1(payload)) AS hex FROM raw),
digests AS (
  SELECT page_id, payload_bytes, hex,
    array_to_string(list_transform(range(32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
        (list_reduce(list_transform(range(5), lambda d: (strpos('0123456789abcdef', substr(hex, (i // 4 * 5 + d + 1)::BIGINT, 1)) - 1)::BIGINT), lambda a, b: a * 16 + b)
          >> (15 - 5 * (i % 4))::BIGINT) & 31)::BIGINT, 1)), '') AS payload_digest
  FROM hashed),
firsts AS (SELECT hex, min(page_id) AS first FROM digests GROUP BY hex)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN d.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id = f.first THEN NULL ELSE f.first END AS refers_to
FROM digests d JOIN firsts f USING (hex)
"""
