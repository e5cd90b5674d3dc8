"""Language identification by averaged subword embeddings.

A text's letters give hashed subwords: runs of one, two and three characters, where anything that
isn't a letter counts as one mark and no run has a mark in its middle. The mean of the subwords'
embeddings goes through a linear softmax. Both layers are trained by stochastic gradient descent in
NumPy on snippets of a bounded sample; a temperature and a rejection threshold are calibrated on
sampled texts kept out of training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actlens.llm.samples import held_out, stratified

UNDETERMINED = "und"


class Subwords:
    """Bucket numbers of the subwords of some texts."""

    def __init__(self, buckets: int):
        self.bits = int(buckets).bit_length() - 1
        self.letter = np.frombuffer(bytes(chr(i).isalpha() for i in range(1 << 16)), bool)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, first bucket of each text); every text begins and ends with a mark."""
        joined = "\n" + "\n".join(texts) + "\n"
        code = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) if t.isascii() else len(t.lower()) for t in texts], np.int64)
        ends = np.cumsum(lengths + 1)  # the place of the mark after each text
        mark = np.zeros(len(code), bool)
        mark[0] = True
        mark[ends] = True
        alpha = np.where(code < 1 << 16, self.letter[np.minimum(code, 65535)], True) & ~mark
        c = np.where(alpha, code, 0).astype(np.uint32)
        shift = np.uint32(32 - self.bits)
        one = c * np.uint32(2654435761) >> shift
        two = (c[:-1] * np.uint32(0x85EBCA6B) ^ c[1:] * np.uint32(0xC2B2AE35)) * np.uint32(2246822519) >> shift
        three = ((c[:-2] * np.uint32(0x27D4EB2F) ^ c[1:-1] * np.uint32(0x165667B1)) * np.uint32(3266489917) ^ c[2:] * np.uint32(0x9E3779B1)) * np.uint32(668265263) >> shift
        at1 = np.flatnonzero(alpha)
        at2 = np.flatnonzero(alpha[:-1] | alpha[1:])
        at3 = np.flatnonzero(alpha[1:-1])
        # A run belongs to the text of its letters: of the mark before a text, the next one.
        where = np.concatenate((at1, np.where(alpha[at2], at2, at2 + 1), at3 + 1))
        ids = np.concatenate((one[at1], two[at2], three[at3]))
        doc = np.searchsorted(ends, where)
        order = np.argsort(doc, kind="stable") if len(texts) > 1 else slice(None)
        return ids[order].astype(np.int64), np.searchsorted(doc[order], np.arange(len(texts) + 1))


#: Characters that are looked at at once.
PIECE = 200_000


def pieces(text: str) -> Iterator[str]:
    """Parts of a text of ``PIECE`` characters at most. They end before a character that is no letter, which stands
    for a mark as the end of a part does; where there is none, at the full size."""
    at = 0
    while len(text) - at > PIECE:
        to = at + PIECE
        while to > at and text[to].isalpha():
            to -= 1
        if to == at:
            yield text[at : at + PIECE]
            at += PIECE
        else:
            yield text[at:to]
            at = to + 1
    yield text[at:]


@dataclass
class LanguageModel:
    labels: list[str]
    embedding: np.ndarray  # buckets x dim, float32
    weights: np.ndarray  # dim x labels
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def sums(self, ids: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
        """The sum of ``table``'s rows over each text's subwords."""
        out = np.zeros((len(first) - 1, table.shape[1]))
        some = np.flatnonzero(np.diff(first))
        if len(some):
            out[some] = np.add.reduceat(table[ids], first[some], axis=0, dtype=np.float64)
        return out

    def logits(self, texts: list[str], sub: Subwords) -> np.ndarray:
        """Of whole texts, a few pieces at a time: long ones are cut where that changes no subword."""
        table = self.embedding @ self.weights.astype(np.float32)  # as wide as there are labels
        total, n = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        held: list[str] = []
        owner: list[int] = []
        size = 0

        def add() -> None:
            ids, first = sub.ids(held)
            np.add.at(total, owner, self.sums(ids, first, table))
            np.add.at(n, owner, np.diff(first))

        for i, t in enumerate(texts):
            for p in pieces(t):
                if held and size + len(p) > PIECE:
                    add()
                    held, owner, size = [], [], 0
                held.append(p)
                owner.append(i)
                size += len(p)
        if held:
            add()
        return total / np.maximum(n, 1)[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def shrunk(x: np.ndarray, most: float) -> np.ndarray:
    return x * min(1.0, most / max(1e-12, float(np.sqrt((x * x).sum()))))


def train(texts: list[str], labels: list[str], buckets: int = 1 << 16, dim: int = 16, epochs: int = 6, least_steps: int = 150, rate: float = 0.5, snippet: int = 240, batch: int = 64, clip: float = 0.05, accept: float = 0.99, seed: int = 7) -> LanguageModel:
    """Fits a model; every fifth text is kept for calibration. Needs one text at least.

    The texts are gone through ``epochs`` times, or more often if they are so few that this gives fewer than ``least_steps``
    steps. Steps with a norm over ``clip`` are shortened to it: where labels are learned early, full ones diverge.
    """
    random = np.random.default_rng(seed)
    names = sorted(set(labels))
    y_all = np.array([names.index(x) for x in labels])
    sub = Subwords(buckets)
    fit = [i for i in range(len(texts)) if i % 5 or len(texts) < 10]
    rest = [i for i in range(len(texts)) if i % 5 == 0] or fit
    model = LanguageModel(names, random.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32), np.zeros((dim, len(names))), np.zeros(len(names)))
    weight = 1 / np.maximum(np.bincount(y_all[fit], minlength=len(names)), 1)
    weight = weight * len(fit) / len(names)
    epochs = max(epochs, -(-least_steps // -(-len(fit) // batch)))
    steps, step = epochs * -(-len(fit) // batch), 0
    for _ in range(epochs):
        for k in range(0, len(order := random.permutation(fit)), batch):
            rows = order[k : k + batch]
            cut = []
            for i in rows:
                at = int(random.integers(0, max(1, len(texts[i]) - snippet + 1)))
                cut.append(texts[i][at : at + int(random.integers(snippet // 6, snippet + 1))])
            ids, first = sub.ids(cut)
            n = np.maximum(np.diff(first), 1)
            some = np.flatnonzero(np.diff(first))
            mean = np.zeros((len(rows), dim))
            if not len(some):
                continue
            mean[some] = np.add.reduceat(model.embedding[ids], first[some], axis=0, dtype=np.float64)
            mean /= n[:, None]
            z = mean @ model.weights + model.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y_all[rows]] -= 1
            p *= weight[y_all[rows], None]
            lr = rate * (1 - step / steps)
            grad = p @ model.weights.T
            step_w = mean.T @ p / len(rows)
            model.weights -= 4 * lr * shrunk(step_w, clip)
            model.bias -= lr * p.mean(axis=0)
            share = np.repeat(grad / n[:, None], np.diff(first), axis=0)
            uniq, slot = np.unique(ids, return_inverse=True)
            move = np.stack([np.bincount(slot, share[:, d], len(uniq)) for d in range(dim)], axis=1)
            model.embedding[uniq] -= (40 * lr * shrunk(move, clip)).astype(np.float32)
            step += 1
    z, y = model.logits([texts[i] for i in rest], sub), y_all[rest]

    # As if one text more were mislabelled: few texts, all right, don't make every answer certain.
    doubt = 1 / (len(y) + 2)

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - (1 - doubt) * s[np.arange(len(y)), y] - doubt * s.mean(axis=1)))

    model.temperature = float(min(np.geomspace(0.05, 20, 80), key=loss))
    model.reject_below = float(np.quantile(model.probabilities(z).max(axis=1), 1 - accept))
    return model


def fit_language(docs: DataFrame, per_label: int = 600, max_bytes: int = 64 << 10, **how) -> LanguageModel:
    """Trains on the rows of ``docs`` (doc_id, text, lang) that aren't held out.

    About ``per_label`` texts of each language are drawn by a hash of doc_id, of those with up to
    ``max_bytes`` bytes: the bound on what reaches the driver. Empty and null texts, and null
    languages, aren't drawn. No labelled text at all is an error.
    """
    some = docs.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes) & (F.col("text") != ""))
    keys = stratified(some, "lang", "doc_id", per_label)
    ids = sorted({r[0] for r in keys})
    rows = some.where(F.col("doc_id").isin(ids) & F.col("lang").isNotNull()).select("doc_id", "text", "lang").distinct().orderBy("doc_id", "lang", "text").limit(4 * len(ids)).collect() if ids else []
    if not rows:
        raise ValueError("no labelled text to learn from")
    random = np.random.default_rng(1)
    rows = [rows[i] for i in random.permutation(len(rows))]
    return train([r.text for r in rows], [r.lang for r in rows], **how)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``rejected`` to every row, from its whole text.

    A null text, or one without a letter, is ``und`` with score 0 and rejected. Other texts have the
    likeliest learned language with its calibrated probability; ``rejected`` if that is below the
    calibrated threshold. Columns already named so are replaced, others stay whatever their names. Equal texts are judged
    alike, repeated rows stay repeated, and an empty table stays empty. Only the text goes to Python; memory doesn't grow
    with a text's length beyond a few times that.
    """
    made = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # buckets x dim floats, 4 MB at the defaults

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = LanguageModel(**shared.value)
        sub = Subwords(len(m.embedding))
        for column in batches:
            parts = []
            for at in range(0, len(column), 1000):
                texts = [x or "" for x in column[at : at + 1000].to_pylist()]
                p = m.probabilities(m.logits(texts, sub))
                lettered = np.array([any(map(str.isalpha, t)) for t in texts], bool)
                best = p.argmax(axis=1)
                score = np.where(lettered, p[np.arange(len(texts)), best], 0.0)
                pred = [m.labels[k] if ok else UNDETERMINED for k, ok in zip(best, lettered, strict=True)]
                parts.append(pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score), pa.array(~lettered | (score < m.reject_below))], made.names))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]))

    own = [c for c in docs.columns if c not in made.names]
    rows = docs.select(F.struct(*own, F.lit(None).alias("none")).alias("row"), F.arrow_udf(run, made)(F.col(text).cast("string")).alias("judged"))
    return rows.select(*(F.col("row")[c].alias(c) for c in own), "judged.*")
