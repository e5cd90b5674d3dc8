"""Benchmark decontamination by SimHash fingerprints of item-sized windows.

For each benchmark item, every window of a document with as many words is a candidate place. A window
whose weighted similarity to an item can reach the threshold has at least that share of its shingles
among the item's; a fixed-size Bloom filter of (shingle, item length) finds the windows for which
that is possible, and only these get a fingerprint: no similar window is lost by that.

Fingerprints have ``BLOCKS`` blocks of ``WIDTH`` bits. Two fingerprints within ``RADIUS`` bits differ by at most
2 * ``REACH`` bits in some block, so some key within ``REACH`` of the one's block is within ``REACH`` of the other's:
items are entered under all such keys, windows look all of theirs up, and every item within the radius is found.
One block in 170 of random ones agrees that far, so under a tenth of unrelated pairs meet. Two windows of one size
with similarity j share 2j / (1 + j) of their shingles, which is the cosine of their sums and gives the expected share
of differing bits, 0.17 at 0.75; the radius is 3.7 standard deviations beyond that. Those that meet within the radius
are verified by the exact weighted Jaccard similarity of their shingles, each shingle weighing as often as it occurs.

Documents are scanned once, whatever the number of items; the windows found are kept as regions, the shingles that
windows of one size cover. Items are then taken in parts of bounded size, by length, and each part is sent to the
regions of its lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens.llm.bloom import BITS as BLOOM_BITS
from actlens.llm.bloom import bloom_bytes, maybe
from actlens.llm.scratch import Scratch
from actlens.llm.words import U64, Hasher, mix, text_parts

WIDTH, BLOCKS, REACH = 20, 17, 2
BITS = WIDTH * BLOCKS
RADIUS = BLOCKS * (2 * REACH + 1) - 1
#: Bytes of items and their index that are sent to the executors at once.
PART_BYTES = 24 << 20
MASKS = np.array([sum(1 << b for b in bits) for d in range(REACH + 1) for bits in combinations(range(WIDTH), d)], np.int32)


def bit_signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each shingle and bit."""
    words = np.stack([mix(shingles + U64((i * 0x9E3779B97F4A7C15 + 0x5851F42D4C957F2D) % (1 << 64))) for i in range(-(-BITS // 64))], axis=1)
    return np.unpackbits(words.view(np.uint8).reshape(len(shingles), -1), axis=1)[:, :BITS].astype(np.int8) * 2 - 1


def window_fingerprints(shingles: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of the windows of ``n`` shingles that begin at ``starts``, ascending: a row of block keys each."""
    out = np.zeros((len(starts), BLOCKS), np.int32)
    at = 0
    while at < len(starts):  # near windows share their sums
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + max(2048, n), "right")))
        low, high = int(starts[at]), int(starts[to - 1]) + n
        sums = np.zeros((high - low + 1, BITS), np.int32)
        np.cumsum(bit_signs(shingles[low:high]), axis=0, out=sums[1:], dtype=np.int32)
        s = starts[at:to] - low
        out[at:to] = (sums[s + n] > sums[s]).reshape(to - at, BLOCKS, WIDTH) @ (1 << np.arange(WIDTH, dtype=np.int32))
        at = to
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which rows of block keys differ."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def near_keys(prints: np.ndarray) -> np.ndarray:
    """For each fingerprint, all keys within ``REACH`` of each of its blocks, with the block's number."""
    return ((prints[:, :, None] ^ MASKS) | (np.arange(BLOCKS, dtype=np.int32) << WIDTH)[:, None]).reshape(len(prints), -1)


class Index:
    """Fingerprints of items of one length, found by the keys of their blocks."""

    def __init__(self, prints: np.ndarray):
        keys = near_keys(prints).reshape(-1)
        order = np.argsort(keys, kind="stable")
        self.prints, self.keys, self.item = prints, keys[order], (order // (BLOCKS * len(MASKS))).astype(np.int32)

    def meeting(self, prints: np.ndarray) -> np.ndarray:
        """Pairs (row, item) that share a key."""
        found = []
        for at in range(0, len(prints), 128):
            probes = near_keys(prints[at : at + 128])
            flat = probes.reshape(-1)
            low, high = np.searchsorted(self.keys, flat), np.searchsorted(self.keys, flat, "right")
            some = np.flatnonzero(high > low)
            if len(some):
                size = (high - low)[some]
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[some], size)
                found.append(np.unique((np.repeat(some // probes.shape[1] + at, size) << 32) | self.item[place]))
        both = np.concatenate(found) if found else np.zeros(0, np.int64)
        return np.stack((both >> 32, both & 0xFFFFFFFF), axis=1)

    def near(self, prints: np.ndarray, radius: int = RADIUS) -> np.ndarray:
        """Pairs (row, item) within ``radius``."""
        pairs = self.meeting(prints)
        return pairs[distance(prints[pairs[:, 0]], self.prints[pairs[:, 1]]) <= radius]


def length_keys(shingles: np.ndarray, words: int) -> np.ndarray:
    return mix(shingles + U64(words * 0x9E3779B97F4A7C15 % (1 << 64)))


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two bags of shingles."""
    if not len(a) or not len(b):
        return 0.0
    _, slot = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = np.bincount(slot[: len(a)], minlength=slot.max() + 1), np.bincount(slot[len(a) :], minlength=slot.max() + 1)
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


def item_table(items: DataFrame, k: int) -> DataFrame:
    """(item_id, words, shingles) of items with a word at least; fewer than ``k`` words are one shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            for at, data, offsets in text_parts(b.column("text")):
                w = hasher.words(data, offsets)
                doc, digest, _ = hasher.shingles(w, k)
                bounds = np.searchsorted(doc, np.arange(w.n_docs + 1))
                rows = [(i, digest[bounds[i] : bounds[i + 1]].tobytes()) for i in np.flatnonzero(w.counts)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("item_id").slice(at, w.n_docs).take(pa.array([i for i, _ in rows], pa.int64())), pa.array(w.counts[w.counts > 0], pa.int32()), pa.array([s for _, s in rows], pa.binary())], names=["item_id", "words", "shingles"]
                )

    return items.mapInArrow(run, "item_id long, words int, shingles binary")


def item_keys(table: DataFrame) -> DataFrame:
    """Bloom filter keys: each shingle alone, and with its item's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, s in zip(b.column("words").to_pylist(), b.column("shingles"), strict=True):
                s = np.frombuffer(s.as_buffer(), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((s, length_keys(s, n))).view(np.int64))], names=["key"])

    return table.mapInArrow(run, "key long")


REGION = "doc_id long, words int, first int, starts binary, shingles binary"


def regions(docs: DataFrame, bitmap: bytes, lengths: list[int], k: int, similarity: float) -> DataFrame:
    """The places of each document that may be similar to an item of a length.

    One row for each document and length, or more where they lie far apart: ``starts`` are the first shingles of windows
    with as many words, counted from ``first``, and ``shingles`` those that the windows cover. A document shorter
    than an item is one window as a whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # a fixed number of bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bits = Hasher(), np.frombuffer(shared.value, np.uint8)
        by_size = {min(k, n): [x for x in lengths if min(k, x) == min(k, n)] for n in lengths}  # lengths by the words of a shingle
        for b in batches:
            for at, data, offsets in text_parts(b.column("text")):
                w = hasher.words(data, offsets)
                rows: list[tuple] = []
                held = 0
                for each, mine in by_size.items():
                    if not len(w.digest):
                        continue
                    doc, digest, _ = hasher.shingles(w, each)
                    hit = np.flatnonzero(maybe(digest, bits))
                    least = int(np.ceil(similarity * (min(mine) - each + 1) - 1e-9))
                    for i in np.flatnonzero(np.bincount(doc[hit], minlength=w.n_docs) >= least):
                        low, high = np.searchsorted(doc, (i, i + 1))
                        s, own = digest[low:high], hit[np.searchsorted(hit, low) : np.searchsorted(hit, high)] - low
                        for n_words in mine:
                            n = n_words - each + 1
                            need = int(np.ceil(similarity * n - 1e-9))
                            if len(own) < need or len(s) < need or w.counts[i] < each:
                                continue
                            near = own[maybe(length_keys(s[own], n_words), bits)]
                            if len(near) < need:
                                continue
                            if n == 1:  # equal windows are equally similar: the first one counts
                                near = np.sort(near[np.unique(s[near], return_index=True)[1]])
                            counts = np.zeros(len(s) + 1, np.int64)
                            counts[near + 1] = 1
                            counts = np.cumsum(counts)
                            size = min(n, len(s))
                            starts = np.flatnonzero(counts[size:] - counts[: len(s) + 1 - size] >= need)
                            for part in np.split(starts, np.flatnonzero(np.diff(starts) > 4 * size) + 1) if len(starts) else []:
                                first = int(part[0])
                                rows.append((at + int(i), n_words, first, (part - first).astype(np.int32).tobytes(), s[first : int(part[-1]) + size].tobytes()))
                                held += len(rows[-1][3]) + len(rows[-1][4])
                                if held > 4 << 20:  # a long text may have many
                                    yield batch(b, rows)
                                    rows, held = [], 0
                if rows:
                    yield batch(b, rows)

    def batch(b: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(c[0])), *(pa.array(x, t) for x, t in zip(c[1:], (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True))], names=["doc_id", "words", "first", "starts", "shingles"])

    return docs.mapInArrow(run, REGION)


def parts_of(table: DataFrame) -> list[tuple[list[int], int, int]]:
    """Parts of the items of ``PART_BYTES`` at most: (lengths, part, number of parts that these lengths are dealt over).

    One row for each length reaches the driver. Items of one length are dealt by a hash of their ids.
    """
    each = BLOCKS * len(MASKS) * 8 + 8 * BLOCKS
    out: list[tuple[list[int], int, int]] = []
    open_lengths: list[int] = []
    held = 0
    for words, n, size in sorted((r[0], r[1], r[2]) for r in table.groupBy("words").agg(F.count("*"), F.sum(F.octet_length("shingles"))).collect()):
        cost = n * each + size
        if held + cost > PART_BYTES and open_lengths:
            out.append((open_lengths, 0, 1))
            open_lengths, held = [], 0
        if cost > PART_BYTES:
            n_parts = -(-2 * cost // PART_BYTES)  # by a hash, so with room
            out += [([words], i, n_parts) for i in range(n_parts)]
        else:
            open_lengths.append(words)
            held += cost
    return out + ([(open_lengths, 0, 1)] if open_lengths else [])


HIT = "doc_id long, item_id long, start_word int, n_words int, similarity double"


def verified(found: DataFrame, table: DataFrame, part: tuple[list[int], int, int], k: int, similarity: float, radius: int) -> DataFrame:
    """Each region's best window for each item of a part that reaches the similarity."""
    lengths, number, n_parts = part
    mine = table.where(F.col("words").isin(lengths) & (F.pmod(F.xxhash64("item_id"), F.lit(n_parts)) == number)).collect()
    by_length: dict[int, list] = {}
    for r in mine:  # PART_BYTES at most
        by_length.setdefault(r.words, []).append((r.item_id, bytes(r.shingles)))
    shared = found.sparkSession.sparkContext.broadcast(by_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: dict[int, tuple] = {}
        for b in batches:
            out = []
            for doc, words, first, starts, s in zip(*(b.column(c).to_pylist() for c in ("doc_id", "words", "first")), b.column("starts"), b.column("shingles"), strict=True):
                if words not in items:
                    bags = [np.frombuffer(x, np.uint64) for _, x in shared.value[words]]
                    items[words] = bags, Index(np.concatenate([window_fingerprints(x, np.zeros(1, np.int64), len(x)) for x in bags])), [i for i, _ in shared.value[words]]
                bags, index, ids = items[words]
                starts, s = np.frombuffer(starts.as_buffer(), np.int32).astype(np.int64), np.frombuffer(s.as_buffer(), np.uint64)
                size = min(len(bags[0]), len(s))
                best: dict[int, tuple] = {}
                for at in range(0, len(starts), 4096):
                    for x, item in index.near(window_fingerprints(s, starts[at : at + 4096], size), radius).tolist():
                        x = int(starts[at + x])
                        score = weighted_jaccard(s[x : x + size], bags[item])
                        if score >= similarity - 1e-12 and score > best.get(item, (0.0,))[0]:
                            best[item] = score, first + x, size + min(k, words) - 1
                out += [(doc, ids[item], x, n, score) for item, (score, x, n) in best.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["doc_id", "item_id", "start_word", "n_words", "similarity"])

    return found.where(F.col("words").isin(lengths)).mapInArrow(run, HIT)


def contaminated(docs: DataFrame, items: DataFrame, scratch: Scratch, similarity: float = 0.75, k: int = 5, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity) of each document's best window for each item it holds.

    The similarity is the weighted Jaccard similarity of ``k``-word shingles; of equally similar windows the
    first counts. Items of fewer than ``k`` words are one shingle as a whole, as are windows of their length. Null texts
    and texts without words match nothing; rows with a null doc_id or item_id are left out. Rows repeated with one
    doc_id, or with one item_id, count as one document or item: its best window is returned. No item, or no document,
    gives an empty table. Only doc_id, item_id and text are read, so other columns may have any name. Texts of any
    length are read whole.
    """
    if radius > RADIUS:
        raise ValueError(f"the index guarantees {RADIUS} bits")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    table = scratch.save(item_table(items, k).distinct(), "items")
    parts = parts_of(table)
    if not parts:
        return docs.sparkSession.createDataFrame([], HIT)
    lengths = sorted({x for p in parts for x in p[0]})
    found = scratch.save(regions(docs, bloom_bytes(item_keys(table), BLOOM_BITS), lengths, k, similarity), "regions")
    sure = verified(found, table, parts[0], k, similarity, radius)
    for p in parts[1:]:
        sure = sure.union(verified(found, table, p, k, similarity, radius))
    best = sure.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start_word")).alias("before"), "n_words")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.before")).cast("int").alias("start_word"), F.col("b.n_words").alias("n_words"), F.col("b.similarity").alias("similarity"))
