"""The pipeline's stages on the small table, each judged on its own input."""

import collections
import os
import re

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs)
    assert all(d.columns == columns for d in seen[:-1]) and seen[-1].columns == [*columns, "copy"]
    texts = [{r.doc_id: r.text for r in d.collect()} for d in seen]
    for before, after in zip(texts, texts[1:]):
        assert set(after) <= set(before)
    assert len(texts[1]) < len(texts[0])
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in texts[2].items() if (w := words(t))}
    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            assert not (a and b and 4 * len(a & b) >= 3 * len(a | b))
    first = {}
    for i in sorted(texts[3]):
        w = words(texts[3][i])
        for j in range(len(w) - 49):
            assert len(set(w[j : j + 50])) == 1 or first.setdefault(tuple(w[j : j + 50]), i) == i
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    joined = {i: " " + " ".join(words(t)) + " " for i, t in texts[4].items()}
    assert not any(" " + " ".join(x) + " " in t for x in items for t in joined.values())
    size = sum(len(words(t)) for t in texts[4].values())
    taken = seen[5].groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("m")).collect()
    assert all(r.n == r.m <= 3 for r in taken)
    assert abs(sum(r.n * len(words(texts[4][r.doc_id])) for r in taken) - size) < 0.1 * size


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and collections.Counter((r.doc_id, r["copy"]) for r in rows).most_common(1)[0][1] == 1
