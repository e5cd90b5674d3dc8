"""Quality classifier from compression: one Zstandard dictionary of good text, one of bad.

A text is compressed in blocks against both dictionaries. The difference of the two sizes, divided
by the text's length, says which class its phrases come from; the smaller size, likewise divided,
says how much it repeats itself. A logistic curve over these two and the length, with their products,
turns them into a calibrated score; it is fitted on labelled texts that the dictionaries haven't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actlens.llm.samples import held_out, stratified

BLOCK, LEVEL = 1024, 3


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # the last one is the intercept
    empty: float  # score of an empty text

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        out = []
        for raw in (self.good, self.bad):
            dictionary = zstandard.ZstdCompressionDict(raw)
            dictionary.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out[0], out[1]

    def scores(self, sizes: np.ndarray) -> np.ndarray:
        """Scores from rows of compressed sizes (good, bad) and length."""
        if not len(sizes):
            return np.zeros(0)
        x = (features(sizes) - self.mean) / self.spread
        z = np.clip(x @ self.weights[:-1] + self.weights[-1], -40, 40)
        return np.where(sizes[:, 2] > 0, 1 / (1 + np.exp(-z)), self.empty)


def compressed_sizes(texts: list, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> np.ndarray:
    """(good, bad, length) of each text, given as bytes or a buffer."""
    out = np.zeros((len(texts), 3))
    for i, t in enumerate(texts):
        a = b = 0
        view = memoryview(t)
        for at in range(0, len(t), BLOCK):
            block = view[at : at + BLOCK]
            a += len(good.compress(block))
            b += len(bad.compress(block))
        out[i] = a, b, len(t)
    return out


def features(sizes: np.ndarray) -> np.ndarray:
    n = np.maximum(sizes[:, 2], 1)
    d, r, size = (sizes[:, 1] - sizes[:, 0]) / n, sizes[:, :2].min(axis=1) / n, np.log(n)
    return np.stack([d, r, size, d * d, r * r, d * r, r**3, size * size, d * size, r * size, 1 / n], axis=1)


def train(texts: list[str], labels: list[int], good_share: float, dictionary_bytes: int = 64 << 10, fit_share: float = 0.6, ridge: float = 1e-2) -> QualityModel:
    """Builds the dictionaries from the first ``fit_share`` of each class and calibrates on the rest.

    ``good_share`` is label 1's share among all labelled rows, which the sample need not have.
    A class too small for a trained dictionary has its texts, joined, as a raw one.
    """
    raw = [[t.encode() for t, y in zip(texts, labels, strict=True) if y == k] for k in (0, 1)]
    dictionaries, rest = [], []
    for own in raw:
        cut = max(1, int(len(own) * fit_share)) if own else 0
        blocks = [t[at : at + 2 * BLOCK] for t in own[:cut] for at in range(0, len(t), 2 * BLOCK)]
        try:
            dictionaries.append(zstandard.train_dictionary(dictionary_bytes, blocks).as_bytes())
        except (zstandard.ZstdError, ValueError):
            dictionaries.append((b"\n".join(blocks)[-dictionary_bytes:]).ljust(8, b"\n"))
        rest.append(own[cut:] or own)
    model = QualityModel(dictionaries[1], dictionaries[0], np.zeros(11), np.ones(11), np.zeros(12), good_share)
    y = np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    sizes = compressed_sizes(rest[0] + rest[1], *model.compressors())
    if not len(y):
        return model
    share = y.mean()
    weight = np.where(y == 1, good_share / max(share, 1e-9), (1 - good_share) / max(1 - share, 1e-9))
    x = features(sizes)
    model.mean, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.column_stack(((x - model.mean) / model.spread, np.ones(len(y))))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, per_label: int = 1500, max_bytes: int = 32 << 10, **how) -> QualityModel:
    """Learns from ``labels`` (doc_id, quality 0 or 1) and the texts of ``docs`` (doc_id, text), without held-out rows.

    About ``per_label`` rows of each label are drawn by a hash of doc_id, with texts of up to
    ``max_bytes`` bytes: the bound on what reaches the driver. Null and other labels, and labels
    without a text, are left out; of different labels for one doc_id the most frequent counts, of equally frequent ones 0.
    No usable label at all is an error.
    """
    marked = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg((F.avg("quality") > 0.5).cast("int").alias("quality"))
    total = marked.agg(F.avg("quality")).first()[0]
    drawn = stratified(marked, "quality", "doc_id", per_label)
    by_id = {r[0]: r[1] for r in drawn}
    small = docs.where(F.col("doc_id").isin(list(by_id)) & F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes)) if by_id else docs.limit(0)
    rows = small.select("doc_id", "text").distinct().orderBy(F.xxhash64("doc_id", F.lit("order")), "doc_id", "text").limit(4 * per_label).collect()
    rows = [r for r in rows if r.text]
    if not rows:
        raise ValueError("no labelled text to learn from")
    return train([r.text for r in rows], [by_id[r.doc_id] for r in rows], float(total), **how)


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """Adds ``score``, the likelihood of label 1, to every row, from its whole text.

    A null or empty text has label 1's share among the labelled rows. A column already named
    ``score`` is replaced, others stay whatever their names; equal texts have equal scores, and repeated rows stay
    repeated. An empty table stays empty. Only the text goes to Python.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # two dictionaries of 64 KB

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = QualityModel(**shared.value)
        good, bad = m.compressors()
        for texts in batches:
            sizes = np.zeros((len(texts), 3))
            for i, x in enumerate(texts):
                if x.is_valid:
                    sizes[i] = compressed_sizes([x.as_buffer()], good, bad)[0]
            yield pa.array(m.scores(sizes))

    return docs.withColumn("score", F.arrow_udf(run, T.DoubleType())(F.col(text).cast("string")))
