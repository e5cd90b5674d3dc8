"""Queries on documents: paragraphs, chunks, tokens, alignment, shards, names; and their oracle SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.functions.text import cell, file_slug, format_window, is_content, parameter_slug, pieces, solid_length
from actlens.operators import align, chunk
from actlens.sources import store

CHUNK = 128
WINDOW = 256
SKIP = 1000
SHARD = 128
ROWS = 32


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.paragraph_chunks(docs(spark, sf), CHUNK)


def first_long_document(spark: SparkSession, sf: str) -> DataFrame:
    return one_long(spark, sf).select("doc_id", F.length("text").alias("n_chars"))


def one_long(spark: SparkSession, sf: str) -> DataFrame:
    """The first document of over 1000 characters; none is an error."""
    rows = docs(spark, sf).where(F.length("text") > 1000).orderBy("doc_id").limit(1)
    if rows.isEmpty():
        raise ValueError("no document has over 1000 characters")
    return rows


def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.paragraph_rows(docs(spark, sf))


def paragraph_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf)


def first_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).where("chunk_idx = 0").select("doc_id", "chunk_text")


def _sequences(rows: DataFrame, *more: Column) -> DataFrame:
    """A row for each window, summed up from what documents give to it."""
    first = F.max(F.when(F.col("pos") == 0, F.col("pieces")[0])).alias("first_piece")
    return rows.groupBy("seq").agg(F.sum(F.size("pieces").cast("long")).alias("n"), F.sum(F.length(F.array_join("pieces", "")).cast("long")).alias("chars"), *more, first)


def token_sequences(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunk.token_slices(docs(spark, sf), WINDOW)
    return _sequences(rows, F.sum(F.size(F.filter("pieces", lambda p: p == "<eos>")).cast("long")).alias("n_eos"))


def token_sequences_resume(spark: SparkSession, sf: str) -> DataFrame:
    return _sequences(chunk.token_slices(docs(spark, sf), WINDOW, skip=SKIP))


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = docs(spark, sf).where("text IS NOT NULL AND text <> ''")
    each = F.array(*[F.struct(F.lit(i).alias("stream_idx"), pieces(F.col("text"), i).alias("toks")) for i in range(3)])
    return rows.select("doc_id", F.inline(each))


def tokenize_streams(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).select("doc_id", "stream_idx", F.size("toks").alias("n_tok"), F.length(F.array_join("toks", "")).alias("chars"))


def content_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = _tokens(spark, sf).select("stream_idx", F.explode("toks").alias("piece")).where(is_content(F.col("piece")))
    return rows.groupBy("stream_idx", solid_length(F.col("piece")).alias("solid")).agg(F.count("*").alias("n"))


def align_two(spark: SparkSession, sf: str) -> DataFrame:
    return align.align_ends(chunks(spark, sf), (0, 1))


def align_three(spark: SparkSession, sf: str) -> DataFrame:
    return align.align_ends(chunks(spark, sf), windows=(1,))


def align_report(spark: SparkSession, sf: str) -> DataFrame:
    """The windows of the first chunk of the first long document, in cells of a table."""
    rows = align.align_chunks(chunk.paragraph_chunks(one_long(spark, sf), CHUNK).where("chunk_idx = 0"))
    cells = [cell(format_window(pieces(F.col("windows")[i], i))).alias(f"cell{i}") for i in (0, 2)]
    # Three characters a piece, counted from the chunk's start: a window's pieces are those of whole threes.
    cells.insert(1, cell(format_window(F.regexp_extract_all(F.col("windows")[1], F.lit("(?s).{1,3}"), F.lit(0)))).alias("cell1"))
    return rows.select("doc_id", "k", *cells)


def aligned_store(spark: SparkSession, sf: str) -> DataFrame:
    """From documents to a store and back: chunks, tokens, alignment, vectors at the last tokens, shards, and rows read by batch."""
    rows = aligned_rows(docs(spark, sf), TARGET)
    kept = store.Store(spark, store.work_dir(spark, "aligned"))
    kept.write_config(store.StoreConfig(models=[{"name": f"m{i}", "slug": f"m{i}", "hidden_size": VECTOR, "hook_point": "last"} for i in range(3)], shard_size_tokens=STORE_SHARD))
    kept.append(rows, STORE_SHARD)
    read = kept.scan(["m0", "m1", "m2"]).withColumn("batch_idx", F.floor(F.pmod("pos_id", F.lit(STORE_SHARD)) / STORE_BATCH))
    tokens = [F.sum(f"last_tok_m{i}").alias(f"tokens{i}") for i in range(3)]
    values = [F.sum(F.aggregate(f"model_m{i}", F.lit(0.0), lambda a, x: a + x.cast("double"))).alias(f"values{i}") for i in range(3)]
    return read.groupBy("shard_index", "batch_idx").agg(F.min("pos_id").alias("first_pos"), F.count("*").alias("n"), *tokens, *values)


VECTOR, TARGET, STORE_SHARD, STORE_BATCH = 4, 20_000, 4096, 256


def stand_in_vectors(stream: int, toks: list[str]) -> np.ndarray:
    """Whole numbers from a token's length and place, in place of a model's activations."""
    n = np.fromiter(map(len, toks), np.int64, len(toks))
    return (n[:, None] * 31 + np.arange(len(toks))[:, None] * 7 + np.arange(VECTOR) * 13 + stream * 17) % 101


def stand_in_ids(stream: int, toks: list[str]) -> np.ndarray:
    return np.array([ord(t[0]) * 1000 + len(t) for t in toks], np.int64)


def aligned_rows(docs: DataFrame, target: int | None = None) -> DataFrame:
    """(pos_id, last_tok_<model>, model_<model>) of all matches in order of document, chunk and match, up to ``target``."""
    out = align.gather_positions(docs, CHUNK, (0, 1, 2), stand_in_vectors, stand_in_ids, high=target)
    return out.select("pos_id", *[F.col("last_tok")[i].alias(f"last_tok_m{i}") for i in range(3)], *[F.col("vectors")[f"v{i}"].alias(f"model_m{i}") for i in range(3)])


def align_completion(spark: SparkSession, sf: str) -> DataFrame:
    rows = align.align_summary(chunks(spark, sf))
    return rows.agg(F.count("*").alias("n_chunks"), F.sum(F.col("completed").cast("long")).alias("n_completed"), F.sum("n_aligned").alias("n_rows"), F.avg(F.col("completed").cast("double")).alias("share"))


def align_retention(spark: SparkSession, sf: str) -> DataFrame:
    rows = align.align_summary(chunks(spark, sf))
    return rows.select("doc_id", "chunk_idx", *[F.col("n_tokens")[i].alias(f"n_tok{i}") for i in range(3)], "n_aligned", (F.col("n_aligned") / F.greatest(F.array_min("n_tokens"), F.lit(1))).alias("retention"))


def single_stream_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = align.align_chunks(chunks(spark, sf), (2,))
    return rows.groupBy("doc_id", "chunk_idx").agg(F.count("*").alias("n_rows"), F.max(F.col("ends")[0]).alias("last"))


def _shards(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("pos_id"))
    return store.shard_manifest(rows.withColumn("shard_index", store.shard_of(F.col("pos_id"), SHARD)))


def shard_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return _shards(spark, sf)


def shard_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return store.running_offsets(_shards(spark, sf)).select("shard_index", "lo", "hi")


def shard_lookup(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.read.parquet(f"{sf}/embeddings.parquet").select((F.col("vec_id") * 7).alias("idx")).where("idx >= 0")
    return store.locate(n, _shards(spark, sf), strict=False)


def range_read(spark: SparkSession, sf: str) -> DataFrame:
    """Positions of a range, read from the shards of a store that hold them."""
    kept = store.Store(spark, store.work_dir(spark, "range"))
    kept.append(spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("pos_id"), "label"), SHARD)
    return kept.read_range(100, 164).select("pos_id", "label")


def typed_manifest(spark: SparkSession, sf: str) -> DataFrame:
    kept = store.Store(spark, store.work_dir(spark, "manifest"))
    kept.append(spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("pos_id"), "label"), SHARD)
    return kept.shard_paths().withColumn("path", F.substring_index("path", "/", -2))


def batch_plan(spark: SparkSession, sf: str) -> DataFrame:
    return store.batch_plan(_shards(spark, sf), ROWS, seed=3)


def batch_count(spark: SparkSession, sf: str) -> DataFrame:
    rows = _shards(spark, sf)
    return rows.agg(F.sum(F.floor(F.col("num_tokens") / ROWS)).alias("whole"), F.sum(F.ceil(F.col("num_tokens") / ROWS)).alias("with_ragged"))


def batch_collate(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a batch as columns in order of position."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", F.floor(F.col("vec_id") / ROWS).alias("batch_id"))
    sets = rows.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("vec_id", "label"))).alias("b"))  # a batch's rows
    return sets.where(F.size("b") == ROWS).select("batch_id", F.concat_ws(",", F.transform("b", lambda r: r["label"].cast("string"))).alias("labels"))


def train_valid_split(spark: SparkSession, sf: str) -> DataFrame:
    return store.split_shards(_shards(spark, sf), 0.3, seed=42)


def slugify_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/part.parquet").select(F.concat_ws("/", F.concat(F.lit(" "), "p_brand"), F.concat("p_type", F.lit(" v1.0-b!"))).alias("name")).distinct()
    return rows.select("name", file_slug(F.col("name")).alias("file_slug"), parameter_slug(F.col("name")).alias("parameter_slug"))


_P = [r" ?[^ \n]+| |\n", r"(?s).{1,3}", r"[ \n]|[0-9]+|[!-/:-@\[-`{-~]+|[^ \n0-9!-/:-@\[-`{-~]+"]
TEXT = rf"""
WITH RECURSIVE paras AS (
  SELECT doc_id, (i - 1)::INT AS para_idx, ps[i] AS para, len(regexp_extract_all(ps[i], '{_P[0]}'))::INT AS n_tok
  FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda p: regexp_replace(p, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')), lambda p: p <> '') AS ps FROM documents WHERE text IS NOT NULL AND text <> ''), unnest(range(1, len(ps) + 1)) t(i)),
fit AS (SELECT doc_id, para, n_tok, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) AS k FROM paras WHERE n_tok <= 128),
fold(doc_id, k, chunk, len) AS (
  SELECT doc_id, k, 0, n_tok FROM fit WHERE k = 1
  UNION ALL SELECT f.doc_id, f.k, CASE WHEN o.len + 1 + f.n_tok > 128 THEN o.chunk + 1 ELSE o.chunk END, CASE WHEN o.len + 1 + f.n_tok > 128 THEN f.n_tok ELSE o.len + 1 + f.n_tok END
  FROM fold o JOIN fit f ON f.doc_id = o.doc_id AND f.k = o.k + 1),
chunks AS (SELECT o.doc_id, o.chunk::INT AS chunk_idx, string_agg(f.para, chr(10) ORDER BY f.k) AS chunk_text, max(o.len)::INT AS n_tok FROM fold o JOIN fit f ON f.doc_id = o.doc_id AND f.k = o.k GROUP BY 1, 2)
"""
TOKENS = rf"""
WITH toks AS (
  SELECT doc_id, 0 AS stream_idx, regexp_extract_all(text, '{_P[0]}') AS t FROM documents WHERE text <> ''
  UNION ALL SELECT doc_id, 1, regexp_extract_all(text, '{_P[1]}') FROM documents WHERE text <> ''
  UNION ALL SELECT doc_id, 2, regexp_extract_all(text, '{_P[2]}') FROM documents WHERE text <> '')
"""
_PIECES = (
    TEXT
    + rf""",
lists AS (
  SELECT doc_id, chunk_idx, 0 AS s, regexp_extract_all(chunk_text, '{_P[0]}') AS t FROM chunks
  UNION ALL SELECT doc_id, chunk_idx, 1, regexp_extract_all(chunk_text, '{_P[1]}') FROM chunks
  UNION ALL SELECT doc_id, chunk_idx, 2, regexp_extract_all(chunk_text, '{_P[2]}') FROM chunks),
ntok AS (SELECT doc_id, chunk_idx, s, len(t) AS n FROM lists),
each AS (SELECT doc_id, chunk_idx, s, (i - 1)::INT AS pos, t[i] AS piece, length(regexp_replace(t[i], '[ \t\r\n]', '', 'g')) AS solid FROM lists, unnest(range(1, len(t) + 1)) q(i)),
marks AS (SELECT doc_id, chunk_idx, s, pos, sum(solid) OVER (PARTITION BY doc_id, chunk_idx, s ORDER BY pos) AS mark, solid FROM each),
content AS (SELECT *, lead(pos) OVER (PARTITION BY doc_id, chunk_idx, s ORDER BY pos) AS next FROM marks WHERE solid > 0)
"""
)


def _aligned(streams: tuple[int, ...]) -> str:
    n = len(streams)
    ids = ", ".join(map(str, streams))
    return (
        _PIECES
        + f""",
met AS (SELECT doc_id, chunk_idx, mark FROM content WHERE s IN ({ids}) GROUP BY 1, 2, 3 HAVING count(*) = {n}),
spans AS (
  SELECT c.doc_id, c.chunk_idx, c.s, c.mark, c.pos AS end_pos,
    coalesce(lag(c.next) OVER (PARTITION BY c.doc_id, c.chunk_idx, c.s ORDER BY c.mark), min(f.first)) AS start_pos
  FROM content c JOIN met m ON m.doc_id = c.doc_id AND m.chunk_idx = c.chunk_idx AND m.mark = c.mark
  JOIN (SELECT doc_id, chunk_idx, s, min(pos) AS first FROM content GROUP BY 1, 2, 3) f ON f.doc_id = c.doc_id AND f.chunk_idx = c.chunk_idx AND f.s = c.s
  WHERE c.s IN ({ids}) GROUP BY c.doc_id, c.chunk_idx, c.s, c.mark, c.pos, c.next),
sized AS (SELECT *, end_pos - start_pos + 1 AS size FROM spans),
edge AS (SELECT doc_id, chunk_idx, mark FROM sized GROUP BY 1, 2, 3 HAVING max(size) = 17 AND count(*) FILTER (size > 16) = 1),
grown AS (
  SELECT p.doc_id, p.chunk_idx, p.mark, p.s, p.size, length(replace(trim(regexp_replace(string_agg(e.piece, '' ORDER BY e.pos), '[ \t\r\n]+', ' ', 'g')), 'ß', 'ss')) AS n
  FROM sized p JOIN edge g ON g.doc_id = p.doc_id AND g.chunk_idx = p.chunk_idx AND g.mark = p.mark JOIN each e ON e.doc_id = p.doc_id AND e.chunk_idx = p.chunk_idx AND e.s = p.s AND e.pos BETWEEN p.start_pos AND p.end_pos - 1
  WHERE p.size > 1 GROUP BY 1, 2, 3, 4, 5),
last AS (SELECT doc_id, chunk_idx, mark, arg_max(size, n * 10 + s) AS size FROM grown GROUP BY 1, 2, 3),
ok AS (
  SELECT z.doc_id, z.chunk_idx, z.mark, max(z.size) > 16 AND NOT coalesce(any_value(l.size) = 17, false) AS wide
  FROM sized z LEFT JOIN last l ON l.doc_id = z.doc_id AND l.chunk_idx = z.chunk_idx AND l.mark = z.mark GROUP BY 1, 2, 3),
cut AS (SELECT doc_id, chunk_idx, mark, bool_or(wide) OVER (PARTITION BY doc_id, chunk_idx ORDER BY mark) AS gone, bool_or(wide) OVER (PARTITION BY doc_id, chunk_idx) AS broken FROM ok),
rows AS (
  SELECT c.doc_id, c.chunk_idx, c.mark, (row_number() OVER (PARTITION BY c.doc_id, c.chunk_idx ORDER BY c.mark) - 1)::INT AS k, NOT broken AS completed FROM cut c WHERE NOT gone)
"""
    )


_WIN = """(SELECT string_agg(e.piece, '' ORDER BY e.pos) FROM each e WHERE e.doc_id = r.doc_id AND e.chunk_idx = r.chunk_idx AND e.s = 1 AND e.pos BETWEEN p1.start_pos AND p1.end_pos)"""
_J = "JOIN spans p{i} ON p{i}.doc_id = r.doc_id AND p{i}.chunk_idx = r.chunk_idx AND p{i}.mark = r.mark AND p{i}.s = {i}"
_DONE = ", every AS (SELECT c.doc_id, c.chunk_idx, NOT coalesce(bool_or(b.broken), false) AS completed, count(b.mark) FILTER (NOT b.gone) AS n_aligned FROM chunks c LEFT JOIN cut b ON b.doc_id = c.doc_id AND b.chunk_idx = c.chunk_idx GROUP BY 1, 2)"
SHARDS = "WITH m AS (SELECT (vec_id // 128)::INT AS shard_index, min(vec_id) AS token_start, max(vec_id) + 1 AS token_end, count(*)::BIGINT AS num_tokens FROM embeddings GROUP BY 1), off AS (SELECT *, coalesce(sum(num_tokens) OVER (ORDER BY shard_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo FROM m)"
_SEQ = rf"""WITH t AS (SELECT doc_id, list_append(regexp_extract_all(text, '{_P[0]}'), '<eos>') AS t FROM documents WHERE text IS NOT NULL AND text <> ''),
o AS (SELECT doc_id, t, coalesce(sum(len(t)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(len(t)) OVER () AS total FROM t),
g AS (SELECT (start + i - 1 - SKIP)::BIGINT AS g, (total - SKIP)::BIGINT AS total, t[i] AS piece FROM o, unnest(range(1, len(t) + 1)) q(i))
SELECT g // 256 AS seq, count(*)::BIGINT AS n, sum(length(piece))::BIGINT AS chars, EOS max(CASE WHEN g % 256 = 0 THEN piece END) AS first_piece FROM g WHERE g >= 0 AND g // 256 < total // 256 GROUP BY 1"""

SQL = {
    "first_long_document": "SELECT doc_id, length(text)::INT AS n_chars FROM documents WHERE length(text) > 1000 ORDER BY doc_id LIMIT 1",
    "paragraphs": TEXT + "SELECT doc_id, para_idx, para, n_tok FROM paras",
    "paragraph_chunks": TEXT + "SELECT doc_id, chunk_idx, chunk_text, n_tok FROM chunks",
    "first_chunks": TEXT + "SELECT doc_id, chunk_text FROM chunks WHERE chunk_idx = 0",
    "token_sequences": _SEQ.replace("SKIP", "0").replace("EOS", "count(*) FILTER (piece = '<eos>')::BIGINT AS n_eos,"),
    "token_sequences_resume": _SEQ.replace("SKIP", "1000").replace("EOS", ""),
    "tokenize_streams": TOKENS + "SELECT doc_id, stream_idx::INT AS stream_idx, len(t)::INT AS n_tok, length(array_to_string(t, ''))::INT AS chars FROM toks",
    "content_tokens": TOKENS + r"SELECT stream_idx::INT AS stream_idx, length(regexp_replace(p, '[ \t\r\n]', '', 'g'))::INT AS solid, count(*)::BIGINT AS n FROM (SELECT stream_idx, unnest(t) AS p FROM toks) WHERE regexp_replace(p, '[ \t\r\n]', '', 'g') <> '' GROUP BY 1, 2",
    "align_two": _aligned((0, 1)) + f"SELECT r.doc_id, r.chunk_idx, r.k, p0.end_pos AS end0, p1.end_pos AS end1, r.completed FROM rows r {_J.format(i=0)} {_J.format(i=1)}",
    "align_three": _aligned((0, 1, 2))
    + f""", win AS (SELECT p.doc_id, p.chunk_idx, p.mark, string_agg(e.piece, '' ORDER BY e.pos) AS window1 FROM spans p JOIN each e ON e.doc_id = p.doc_id AND e.chunk_idx = p.chunk_idx AND e.s = 1 AND e.pos BETWEEN p.start_pos AND p.end_pos WHERE p.s = 1 GROUP BY 1, 2, 3)
    SELECT r.doc_id, r.chunk_idx, r.k, p0.end_pos AS end0, p1.end_pos AS end1, p2.end_pos AS end2, w.window1, r.completed FROM rows r {_J.format(i=0)} {_J.format(i=1)} {_J.format(i=2)} JOIN win w ON w.doc_id = r.doc_id AND w.chunk_idx = r.chunk_idx AND w.mark = r.mark""",
    "aligned_store": _aligned((0, 1, 2))
    + """, ordered AS (SELECT r.doc_id, r.chunk_idx, r.mark, row_number() OVER (ORDER BY r.doc_id, r.chunk_idx, r.k) - 1 AS pos_id FROM rows r),
    tok AS (
      SELECT o.pos_id, p.s, e.pos, e.piece FROM ordered o JOIN spans p ON p.doc_id = o.doc_id AND p.chunk_idx = o.chunk_idx AND p.mark = o.mark
      JOIN each e ON e.doc_id = p.doc_id AND e.chunk_idx = p.chunk_idx AND e.s = p.s AND e.pos = p.end_pos WHERE o.pos_id < 20000),
    val AS (
      SELECT pos_id, s, (ord(piece) * 1000 + length(piece))::BIGINT AS t, list_sum(list_transform(range(4), lambda d: (length(piece) * 31 + pos * 7 + d * 13 + s * 17) % 101))::DOUBLE AS v FROM tok)
    SELECT (pos_id // 4096)::INT AS shard_index, (pos_id % 4096) // 256 AS batch_idx, min(pos_id)::BIGINT AS first_pos, (count(*) // 3)::BIGINT AS n,
      (sum(t) FILTER (s = 0))::BIGINT AS tokens0, (sum(t) FILTER (s = 1))::BIGINT AS tokens1, (sum(t) FILTER (s = 2))::BIGINT AS tokens2,
      sum(v) FILTER (s = 0) AS values0, sum(v) FILTER (s = 1) AS values1, sum(v) FILTER (s = 2) AS values2 FROM val GROUP BY 1, 2""",
    "align_completion": _aligned((0, 1, 2)) + _DONE + "SELECT count(*)::BIGINT AS n_chunks, count(*) FILTER (completed)::BIGINT AS n_completed, sum(n_aligned)::BIGINT AS n_rows, avg(completed::INT)::DOUBLE AS share FROM every",
    "align_retention": _aligned((0, 1, 2))
    + _DONE
    + "SELECT e.doc_id, e.chunk_idx, max(n) FILTER (s = 0)::INT AS n_tok0, max(n) FILTER (s = 1)::INT AS n_tok1, max(n) FILTER (s = 2)::INT AS n_tok2, any_value(n_aligned)::INT AS n_aligned, any_value(n_aligned) / greatest(min(n), 1) AS retention FROM every e JOIN ntok t ON t.doc_id = e.doc_id AND t.chunk_idx = e.chunk_idx GROUP BY 1, 2",
    "single_stream_rows": _PIECES + "SELECT doc_id, chunk_idx, count(*)::BIGINT AS n_rows, max(pos)::INT AS last FROM content WHERE s = 2 GROUP BY 1, 2",
    "shard_manifest": SHARDS + "SELECT * FROM m",
    "shard_offsets": SHARDS + "SELECT shard_index, lo, lo + num_tokens AS hi FROM off",
    "shard_lookup": SHARDS + "SELECT vec_id * 7 AS idx, shard_index, vec_id * 7 - lo AS local FROM embeddings JOIN off ON vec_id * 7 >= lo AND vec_id * 7 < lo + num_tokens",
    "range_read": "SELECT vec_id AS pos_id, label FROM embeddings WHERE vec_id >= 100 AND vec_id < 164",
    "typed_manifest": SHARDS + "SELECT shard_index, token_start, token_end, num_tokens, 'shards/shard_index=' || shard_index AS path FROM m",
    "batch_plan": SHARDS
    + "SELECT shard_index, b AS batch_idx, b * 32 AS start, least(32, num_tokens - b * 32)::BIGINT AS n_rows, ((shard_index::BIGINT + 1 + 3) * (48271 * 69621::BIGINT)) % 2147483647 AS order_shard, ((b + shard_index * 7919 + 1 + 3)::BIGINT * (48271 * 69621::BIGINT)) % 2147483647 AS order_batch FROM m, range(1000) t(b) WHERE (b + 1) * 32 <= num_tokens",
    "batch_count": SHARDS + "SELECT sum(num_tokens // 32)::BIGINT AS whole, sum((num_tokens + 31) // 32)::BIGINT AS with_ragged FROM m",
    "batch_collate": "SELECT vec_id // 32 AS batch_id, string_agg(label::VARCHAR, ',' ORDER BY vec_id) AS labels FROM embeddings GROUP BY 1 HAVING count(*) = 32",
    "train_valid_split": SHARDS + "SELECT shard_index, k <= least(greatest(1, ceil(n * 0.3)), n - 1) AS is_valid FROM (SELECT shard_index, count(*) OVER () AS n, row_number() OVER (ORDER BY ((shard_index::BIGINT + 1 + 42) * (48271 * 69621::BIGINT)) % 2147483647, shard_index) AS k FROM m)",
    "slugify_names": "WITH n AS (SELECT DISTINCT ' ' || p_brand || '/' || p_type || ' v1.0-b!' AS name FROM part) SELECT name, regexp_replace(replace(trim(name), '/', '_'), '[^a-zA-Z0-9._-]+', '-', 'g') AS file_slug, translate(name, './-', '___') AS parameter_slug FROM n",
}
QUERIES = {
    f.__name__: f
    for f in (
        first_long_document, paragraphs, paragraph_chunks, first_chunks, token_sequences, token_sequences_resume, tokenize_streams, content_tokens, align_two, align_three, align_report, aligned_store, align_completion, align_retention, single_stream_rows,
        shard_manifest, shard_offsets, shard_lookup, range_read, typed_manifest, batch_plan, batch_count, batch_collate, train_valid_split, slugify_names,
    )
}
