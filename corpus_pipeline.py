"""A corpus pipeline: from ``documents`` to a training mixture.

Each stage takes all that its predecessor kept, written as Parquet and read again, and calls one of
the operators of :mod:`actlens.llm`. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.llm.decontaminate import contaminated
from actlens.llm.mixing import mix_sources
from actlens.llm.partenum import keep_one
from actlens.llm.quality import fit_quality, score_quality
from actlens.llm.queries_quality import THRESHOLD
from actlens.llm.scratch import Scratch
from actlens.llm.substring import passages, remove_passages

#: SQL can't state the learned scores of the first stage.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    A null or empty text has the good label's share as its score, and stays if that is enough. Repeated rows are judged
    alike; an empty table stays empty. No usable label at all is an error. All columns stay, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    if docs.isEmpty():
        return docs
    model = fit_quality(docs.select("doc_id", "text"), labels)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return score_quality(rows, model).where(F.col("score") >= THRESHOLD).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; see :func:`keep_one` for nulls, ties and repeated rows."""
    return keep_one(docs, Scratch(spark, "pipeline-near"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has too; those with no other words go.

    Rows without a doc_id, and all but one of differing texts under one doc_id, count as later documents and are cut
    like others. Null texts stay.
    """
    scratch = Scratch(spark, "pipeline-passages")
    return scratch.fit(remove_passages(docs, passages(docs, scratch)), like=docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Every row is judged by its own text, whatever its doc_id; null texts stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    scratch = Scratch(spark, "pipeline-benchmark")
    digest = F.xxhash64(F.col("text").cast("string"))
    found = contaminated(docs.select(digest.alias("doc_id"), "text"), items, scratch)
    hits = scratch.save(found.select(F.col("doc_id").alias("hit")).distinct(), "hits", ("regions",))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.when(F.col("text").isNotNull(), digest).alias("digest"))
    return rows.join(hits, F.col("digest") == F.col("hit"), "left_anti").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: every document as often as it is taken, with the number of each copy in ``copy``, which replaces a
    column of that name. Documents without words are never taken; see :func:`mix_sources` for nulls and repeated rows."""
    rows = docs.drop("copy")
    whole = rows.select("doc_id", "source", "text", F.struct(*rows.columns).alias("whole"))
    mixed = mix_sources(whole, Scratch(spark, "pipeline-mixing")).where("copies > 0")
    return mixed.select("whole.*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, f"stage-{k}")
    return docs
