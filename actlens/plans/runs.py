"""Queries on whole runs and on what a model is given: stores written and read back by batch, filled-up batches, first tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.functions.text import is_content, pieces
from actlens.operators import batches
from actlens.plans import entries, texts
from actlens.plans.texts import ROWS, SHARD, stand_in_ids, stand_in_vectors
from actlens.sources.store import Store, StoreConfig, work_dir

BOS = "<bos>"
BATCH_DOCS, TARGET, LENGTH, RUN_SHARD, SEED = 8, 20_000, 256, 4096, 3


def bos_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of each stream after a first one, which has no content; the last stream's tokenizer has none."""
    rows = texts._tokens(spark, sf).withColumn("toks", F.when(F.col("stream_idx") < 2, batches.with_bos(F.col("toks"), F.lit(BOS))).otherwise(F.col("toks")))
    solid = F.filter("toks", lambda t: is_content(t, (BOS,)))
    return rows.select("doc_id", "stream_idx", F.size("toks").alias("n_tok"), F.size(solid).alias("n_content"), F.length(F.element_at("toks", 1)).alias("first"))


def padded_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The third tokenizer's token lengths of eight documents, filled up to the longest list; a row for each document."""
    rows = texts.docs(spark, sf).select("doc_id", F.floor(F.col("doc_id") / BATCH_DOCS).alias("batch"), F.transform(pieces(F.coalesce("text", F.lit("")), 2), lambda t: F.length(t).cast("bigint")).alias("tokens"))
    out = batches.pad_batches(rows, "batch", "tokens", batches.filler(None, -1))
    return out.select("doc_id", "batch", "width", F.size("tokens").alias("n"), F.size(F.filter("tokens", lambda t: t == -1)).alias("n_fill"), F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, t: a + t).alias("total"))


def store_batches(spark: SparkSession, sf: str) -> DataFrame:
    """``embeddings`` in a store, read back as whole batches in their order, a row for each batch."""
    kept = Store(spark, work_dir(spark, "batches"))
    kept.write_config(StoreConfig(models=[{"name": "m", "slug": "m", "hidden_size": 64, "hook_point": "last"}], shard_size_tokens=SHARD))
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("pos_id"), F.col("label").cast("int").alias("last_tok_m"), F.transform("embedding", lambda v: F.floor(v.cast("double") * 1000).cast("float")).alias("model_m"))
    kept.append(rows, SHARD)
    total = F.aggregate("model_m", F.lit(0.0), lambda a, x: a + F.aggregate(x, F.lit(0.0), lambda b, y: b + y.cast("double")))
    return kept.collated(["m"], ROWS, SEED).select("order_shard", "order_batch", "shard_index", "batch_idx", F.array_min("pos_ids").alias("first_pos"), F.concat_ws(",", F.transform("last_tok_m", lambda t: t.cast("string"))).alias("labels"), total.alias("total"))


def shared_store(spark: SparkSession, sf: str) -> DataFrame:
    """Documents' tokens in windows, two models' vectors for each token, written up to a target; a row for each shard."""
    where = work_dir(spark, "shared")
    config = entries.config_of(["m/0", "m/1"], [texts.VECTOR] * 2, ["last"], shard_size_tokens=RUN_SHARD, token_dtype="int64")
    entries.preprocess_shared(spark, texts.docs(spark, sf), where, config, stand_in_vectors, stand_in_ids, TARGET, LENGTH, shards_a_step=3)
    values = [F.sum(F.aggregate(f"model_m_{i}", F.lit(0.0), lambda a, x: a + x.cast("double"))).alias(f"values{i}") for i in range(2)]
    return Store(spark, where).scan(["m/0", "m/1"]).groupBy("shard_index").agg(F.min("pos_id").alias("first_pos"), F.count("*").alias("n"), F.sum("last_tok_m_0").alias("tokens"), *values)


_P = texts._P
SQL = {
    "bos_tokens": texts.TOKENS
    + r""", b AS (SELECT doc_id, stream_idx, CASE WHEN stream_idx < 2 THEN list_prepend('<bos>', t) ELSE t END AS t, t AS own FROM toks)
    SELECT doc_id, stream_idx::INT AS stream_idx, len(t)::INT AS n_tok, len(list_filter(own, lambda p: regexp_replace(p, '[ \t\r\n]+', '', 'g') <> ''))::INT AS n_content, length(t[1])::INT AS first FROM b""",
    "padded_batches": rf"""WITH t AS (SELECT doc_id, doc_id // 8 AS batch, regexp_extract_all(coalesce(text, ''), '{_P[2]}') AS t FROM documents), w AS (SELECT *, max(len(t)) OVER (PARTITION BY batch) AS width FROM t)
    SELECT doc_id, batch, width::INT AS width, width::INT AS n, (width - len(t))::INT AS n_fill, (length(array_to_string(t, '')) - (width - len(t)))::BIGINT AS total FROM w""",
    "store_batches": texts.SHARDS
    + """, r AS (SELECT vec_id, label, vec_id // 128 AS s, vec_id % 128 // 32 AS b, list_sum(list_transform(embedding, lambda v: floor(v::DOUBLE * 1000)))::DOUBLE AS v FROM embeddings)
    SELECT ((s + 1 + 3) * (48271 * 69621::BIGINT)) % 2147483647 AS order_shard, ((b + s * 7919 + 1 + 3) * (48271 * 69621::BIGINT)) % 2147483647 AS order_batch, s::INT AS shard_index, b AS batch_idx, min(vec_id) AS first_pos, string_agg(label::INT::VARCHAR, ',' ORDER BY vec_id) AS labels, sum(v) AS total
    FROM r GROUP BY s, b HAVING count(*) = 32""",
    "shared_store": rf"""WITH t AS (SELECT doc_id, list_append(regexp_extract_all(text, '{_P[0]}'), '<eos>') AS t FROM documents WHERE text IS NOT NULL AND text <> ''),
    o AS (SELECT t, coalesce(sum(len(t)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(len(t)) OVER () AS total FROM t),
    g AS (SELECT (start + i - 1)::BIGINT AS g, total, t[i] AS piece FROM o, unnest(range(1, len(t) + 1)) q(i)),
    k AS (SELECT g, ord(piece) * 1000 + length(piece) AS token, list_sum(list_transform(range(4), lambda d: (length(piece) * 31 + g % 256 * 7 + d * 13) % 101)) AS v0, list_sum(list_transform(range(4), lambda d: (length(piece) * 31 + g % 256 * 7 + d * 13 + 17) % 101)) AS v1
      FROM g WHERE g < 20000 // 256 * 256 AND g // 256 < total // 256)
    SELECT (g // 4096)::INT AS shard_index, min(g) AS first_pos, count(*)::BIGINT AS n, sum(token)::BIGINT AS tokens, sum(v0)::DOUBLE AS values0, sum(v1)::DOUBLE AS values1 FROM k GROUP BY 1""",
}
QUERIES = {f.__name__: f for f in (bos_tokens, padded_batches, store_batches, shared_store)}
