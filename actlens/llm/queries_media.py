"""The query of media columns over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from actlens.llm.media import describe_stored, encode_text, sniff_media
from actlens.llm.scratch import Scratch


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = Scratch(spark, "media").save(encode_text(docs), "stored", compression="zstd")
    return describe_stored(sniff_media(stored)).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )


#: All but ``tail_crc32`` in words of SQL; the CRC is a fold over the last 64 bytes' bits.
OP10_SQL = """
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
padded AS (
  SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes,
    h || repeat('0', 2 * (greatest(64, ((length(h) // 2 + 63) // 64) * 64) - length(h) // 2)) AS p FROM raw),
sized AS (SELECT *, (length(p) // 2)::BIGINT AS n FROM padded),
texts AS (SELECT *, format('{:08X}', n) AS n_be, format('{:08X}', n + 36) AS riff_be FROM sized),
media AS (
  SELECT *, '52494646' || substr(riff_be, 7, 2) || substr(riff_be, 5, 2) || substr(riff_be, 3, 2) || substr(riff_be, 1, 2)
    || '57415645' || '666D7420' || '10000000' || '01000100' || '401F0000' || '401F0000' || '01000800'
    || '64617461' || substr(n_be, 7, 2) || substr(n_be, 5, 2) || substr(n_be, 3, 2) || substr(n_be, 1, 2) || p AS m FROM texts),
crc AS (
  SELECT DISTINCT right(p, 128) AS tail FROM sized),
crcs AS (
  SELECT tail, (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(64), lambda i: ('0x' || substr(tail, (2 * i + 1)::BIGINT, 2))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda k: k::BIGINT)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)) AS tail_crc32
  FROM crc)
SELECT doc_id, n_bytes, n AS payload_bytes, sha256(unhex(p)) AS payload_sha256, tail_crc32, n + 44 AS media_bytes, sha256(unhex(m)) AS media_sha256,
  'audio/wav;bits=8;channels=1;rate=8000;samples=' || n || ';valid=' || (n + 44) || ';embedded=' AS feature
FROM media JOIN crcs ON right(p, 128) = tail
"""
