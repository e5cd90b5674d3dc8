"""Words and shingles of whole Arrow batches, as NumPy arrays of 64-bit digests.

Words are runs of anything but ``[\\x20\\x09-\\x0D]``. A word's digest is a polynomial over its bytes
with a random 64-bit number for each byte value, taken from prefix sums over the whole buffer, so no
Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are hashed at a time, in arrays of about 40 times that.
PIECE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, a bijection of 64-bit numbers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_parts(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a string array with at most ``limit`` bytes, or one text: first row, bytes, offsets from 0.

    A null is an empty text.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    if texts.null_count:  # a null's bytes need not be absent
        lengths = np.where(texts.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        if (lengths != np.diff(offsets)).any():
            texts = texts.fill_null("")
            yield from text_parts(texts, limit)
            return
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Words:
    """The words of some texts in order: ``doc`` (row of the text), ``start``, ``end`` (bytes) and ``digest``."""

    def __init__(self, doc, start, end, digest, n_docs: int):
        self.doc, self.start, self.end, self.digest, self.n_docs = doc, start, end, digest, n_docs
        self.first = np.searchsorted(doc, np.arange(n_docs + 1))  # of each text, in the arrays

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


class Hasher:
    """Digests of words and shingles; equal seeds give equal digests on every machine."""

    def __init__(self, seed: int = 20250701):
        random = np.random.default_rng(seed)
        self.table = random.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
        self.lower = self.table.copy()
        self.lower[ord("A") : ord("Z") + 1] = self.table[ord("a") : ord("z") + 1]
        self.base = int(random.integers(0, 1 << 62)) * 4 + 3
        self.inverse = pow(self.base, -1, 1 << 64)
        self.factors = random.integers(0, 1 << 63, 64, np.uint64) * U64(2) + U64(1)
        self.space = np.zeros(256, bool)
        self.space[[0x20, 9, 10, 11, 12, 13]] = True
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, PIECE)
            for name, by in (("_up", self.base), ("_down", self.inverse)):
                x = np.full(size, by, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self._up[:n], self._down[:n]

    def words(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
        n, n_docs = len(data), len(offsets) - 1
        if not n:
            none = np.zeros(0, np.int64)
            return Words(none, none, none, np.zeros(0, np.uint64), n_docs)
        space = self.space[data]
        edge = np.ones(n + 1, bool)  # a text begins here, or the buffer ends
        edge[1:n] = False
        edge[offsets[:-1]] = True
        start = np.flatnonzero(~space & (edge[:-1] | np.concatenate(([True], space[:-1]))))
        end = np.flatnonzero(~space & (edge[1:] | np.concatenate((space[1:], [True])))) + 1
        up, down = self._powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.lower if lower else self.table)[data] * up, out=sums[1:])
        digest = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
        return Words(np.searchsorted(offsets, start, "right") - 1, start, end, digest, n_docs)

    def sequence(self, digests: np.ndarray) -> int:
        """The digest of a short sequence of words."""
        k = np.arange(len(digests)) % len(self.factors)
        return int(mix((digests * self.factors[k]).sum(dtype=np.uint64) + U64(len(digests)) + np.zeros(1, np.uint64))[0])

    def shingles(self, w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of the text, digest and first word of every ``k``-word shingle, in order.

        A text with fewer words, but at least one, has one shingle: the whole sequence.
        """
        n = len(w.digest)
        if n >= k:
            at = np.flatnonzero(w.doc[: n - k + 1] == w.doc[k - 1 :])
            d = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                d += w.digest[j : n - k + 1 + j] * self.factors[j]
            digest = mix(d[at] + U64(k))
        else:
            at, digest = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        doc = w.doc[at] if n else at
        few = np.flatnonzero((w.counts > 0) & (w.counts < k))
        if len(few):
            extra = np.array([self.sequence(w.digest[w.first[i] : w.first[i + 1]]) for i in few], np.uint64)
            doc, digest, at = np.concatenate((doc, few)), np.concatenate((digest, extra)), np.concatenate((at, w.first[few]))
            order = np.argsort(doc, kind="stable")
            doc, digest, at = doc[order], digest[order], at[order]
        return doc, digest, at

    def shingle_sets(self, w: Words, k: int = 5) -> Iterator[np.ndarray]:
        """The sorted distinct shingles of each text."""
        doc, digest, _ = self.shingles(w, k)
        bounds = np.searchsorted(doc, np.arange(w.n_docs + 1))
        for i in range(w.n_docs):
            yield np.unique(digest[bounds[i] : bounds[i + 1]])
