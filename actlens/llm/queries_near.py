"""The query of the n-gram Jaccard join over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from actlens.llm.partenum import near_copies
from actlens.llm.scratch import Scratch


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_copies(docs, Scratch(spark, "near")).select("doc_id", "n_shingles", "component_id")


OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
lists AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM lists),
sets AS (SELECT md5(array_to_string(list_sort(s), '|')) AS sid, any_value(s) AS s, len(any_value(s)) AS n, min(doc_id) AS least FROM lists WHERE len(s) > 0 GROUP BY 1),
items AS (SELECT sid, n, unnest(s) AS x FROM sets),
common AS (
  SELECT a.sid AS a, b.sid AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM items a JOIN items b ON a.x = b.x AND a.sid < b.sid AND a.n * 4 >= b.n * 3 AND b.n * 4 >= a.n * 3 GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * c >= 75 * (na + nb - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, other) AS (SELECT a, b FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a),
comps AS (SELECT s.sid, least(s.least, coalesce(min(t.least), s.least)) AS component_id
  FROM sets s LEFT JOIN reach r ON r.node = s.sid LEFT JOIN sets t ON t.sid = r.other GROUP BY s.sid, s.least)
SELECT l.doc_id, z.n AS n_shingles, coalesce(c.component_id, l.doc_id) AS component_id
FROM lists l JOIN sizes z USING (doc_id) LEFT JOIN comps c ON len(l.s) > 0 AND c.sid = md5(array_to_string(list_sort(l.s), '|'))
"""
