"""Repeated passages: shared k-mer seeds, collinear chains, alignment.

Seeds are robust winnowing's choice of word k-mers, each with its rank among equal k-mers of its
document, so that a text which repeats itself still has distinct seeds. A seed's source is the
smallest document that has its k-mer at its rank, or, if no earlier one repeats it as often, the last
such place of the earlier ones; every other document with it matches that one place, so a passage
that any number of documents share costs one match a document and seed, never a pair of documents.
Seeds that a large share of a sample of documents have are matched where they arise, against a
broadcast table of their sources; the bound on its keys is ``1 / hot_share`` times the seeds of a
document, and a key has as many places as the document that repeats it most. All others meet in
sorted order and are streamed; matched ones pass through, dealt evenly.

The matches of a document with one source are merged into diagonal pieces, and those chained in
order by a Fenwick tree of prefix maxima, with costs for what a gap skips on either side. A chain's
surroundings in both documents are then aligned word by word; maximal scoring stretches of at least
``min_words`` words are the passages, exact or fuzzy. A chain may thus bridge words whose own seeds
have another source.

A run of words whose seeds fall to several sources may have no chain. Any run of ``min_words`` words
that an earlier document has lies in a stretch where all seeds have some source, so the windows of
such stretches that aren't wholly in passages are looked up by their digests in all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actlens.llm.bloom import BITS, bloom_bytes, maybe
from actlens.llm.scratch import Scratch
from actlens.llm.words import U64, Hasher, Words, mix, text_parts

NONE = U64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Rules:
    """k and window of seeds; the shortest passage; chaining and alignment costs, in matching words."""

    k: int = 6
    window: int = 8
    min_words: int = 50
    max_gap: int = 48
    gap_cost: float = 0.2
    mismatch: float = 2.0
    drop: float = 16.0
    hot_share: float = 0.005

    @property
    def pad(self) -> int:
        return self.k + self.window + 10

    @property
    def least_chain(self) -> int:
        """Words that the seeds of the shortest passage span at least, if its ends are exact."""
        return max(self.k, self.min_words - 2 * (self.k + self.window))


def seeds(w: Words, hasher: Hasher, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, row of the text, first word in it, rank among equal keys of the text) of each seed."""
    k, window = rules.k, rules.window
    none = np.zeros(0, np.int64)
    n = len(w.digest)
    if n < k:
        return np.zeros(0, np.uint64), none, none, none
    at = np.flatnonzero(w.doc[: n - k + 1] == w.doc[k - 1 :])
    if not len(at):
        return np.zeros(0, np.uint64), none, none, none
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h += w.digest[j : n - k + 1 + j] * hasher.factors[j]
    h, doc = mix(h[at]) >> U64(1), w.doc[at]
    spaced = np.full(len(at) + (int(doc[-1]) + 2) * window, NONE)  # texts don't share a window
    place = np.arange(len(at)) + (doc + 1) * window
    spaced[place] = h
    least = np.minimum.reduce([spaced[j : len(spaced) - window + 1 + j] for j in range(window)])
    # A seed is the least of some window; windows over a text's edge count too.
    most = np.maximum.reduce([np.where(least[place - j] == NONE, 0, least[place - j]) for j in range(window)])
    chosen = most == h
    h, doc, pos = h[chosen], doc[chosen], (at - w.first[doc])[chosen]
    order = np.lexsort((pos, h, doc))
    same = np.zeros(len(order), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order)) - start
    return mix(h), doc, pos, rank


def below(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For places of keys in order of key and rank, the last one of the same key in a smaller document, or -1.

    Documents ascend with the rank, as a document that has a rank has all smaller ones.
    """
    if not len(key):
        return np.zeros(0, np.int64)
    cut = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
    start = np.maximum.accumulate(np.where(cut, np.arange(len(key)), 0))
    return np.where((start > 0) & (key[start - 1] == key), start - 1, -1)


SEED = "key long, doc_id long, pos long, source long"


def seed_rows(docs: DataFrame, rules: Rules, hot=None, heads=None) -> DataFrame:
    """(key, doc_id, pos, source) of the seeds of all documents; source is null, pos has the rank in its upper half.

    With ``hot``, a broadcast sorted array of keys, only their seeds are made. With ``heads`` as well, broadcast
    arrays of their places (doc_id, pos, place below) for each rank and where each key's begin, all seeds are made,
    and those of hot keys are matches: source is set, pos holds the source's place in its upper half, and key is
    spread evenly; seeds without a source are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            for at, data, offsets in text_parts(b.column("text")):
                key, doc, pos, rank = seeds(hasher.words(data, offsets), hasher, rules)
                if not len(key):
                    continue
                key, ids = key.view(np.int64), b.column("doc_id").slice(at, len(offsets) - 1).to_numpy(zero_copy_only=False)[doc]
                source, none = np.zeros(len(key), np.int64), np.ones(len(key), bool)
                if hot is not None:
                    slot = np.minimum(np.searchsorted(hot.value, key), len(hot.value) - 1)
                    inside = hot.value[slot] == key
                    if heads is None:
                        key, ids, pos, rank, source, none = key[inside], ids[inside], pos[inside], rank[inside], source[inside], none[inside]
                    else:
                        (at_doc, at_pos, lower), begin = heads.value
                        place = np.where(inside, begin[slot] + rank, 0)
                        place = np.where(at_doc[place] == ids, lower[place], place)  # a place of its own
                        source, none = np.where(inside, at_doc[place], 0), ~inside
                        rank = np.where(inside, at_pos[place], rank)
                        key = np.where(inside, mix((key ^ ids ^ pos ^ (rank << 32)).view(np.uint64)).view(np.int64), key)
                        rest = none | (place >= 0)
                        key, ids, pos, rank, source, none = key[rest], ids[rest], pos[rest], rank[rest], source[rest], none[rest]
                pos = pos | (rank << 32)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(pos), pa.array(source, mask=none)], names=["key", "doc_id", "pos", "source"])

    return docs.mapInArrow(run, SEED)


MATCH = "doc_id long, source long, pos int, source_pos int"


def first_matches(sorted_seeds: DataFrame) -> DataFrame:
    """Matches of each seed with the first one of its key and rank, from a stream sorted by key, doc_id and pos.

    The first one of a rank matches the last place of its key in a smaller document. Rows with a source are
    matches already. What is held of a key is one place for each rank.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        names = ["doc_id", "source", "pos", "source_pos"]
        for b in batches:
            done = b.column("source").is_valid().to_numpy(zero_copy_only=False)
            if done.any():
                part = b.filter(pa.array(done))
                both = part.column("pos").to_numpy()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array((both & 0xFFFFFFFF).astype(np.int32)), pa.array((both >> 32).astype(np.int32))], names=names)
            key, doc, pos = (b.column(c).to_numpy()[~done] for c in ("key", "doc_id", "pos"))
            if not len(key):
                continue
            held = 0
            if head is not None:
                held = len(head[0])
                key, doc, pos = (np.concatenate(x) for x in zip(head, (key, doc, pos), strict=True))
            rank = pos >> 32
            order = np.lexsort((np.arange(len(key)) >= held, doc, rank, key))
            new, key, doc, pos, rank = order >= held, key[order], doc[order], pos[order] & 0xFFFFFFFF, rank[order]
            start = np.concatenate(([True], (key[1:] != key[:-1]) | (rank[1:] != rank[:-1])))
            places = np.flatnonzero(start)
            at = np.cumsum(start) - 1
            again = np.zeros(len(key), bool)  # rows repeated with one doc_id
            again[1:] = ~start[1:] & (doc[1:] == doc[:-1])
            at = np.where(doc == doc[places[at]], below(key[places], doc[places])[at], at)
            hit = np.flatnonzero(new & (at >= 0) & ~again)
            first = places[at[hit]]
            last = places[key[places] == key[-1]]
            head = [x[last] for x in (key, doc, pos | (rank << 32))]
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(doc[first]), pa.array(pos[hit].astype(np.int32)), pa.array(pos[first].astype(np.int32))], names=names)

    return sorted_seeds.mapInArrow(run, MATCH)


def hot_keys(docs: DataFrame, rules: Rules, sample: int = 10_000) -> DataFrame:
    """The keys that more than ``hot_share`` of a sample of documents have.

    The sample only decides on the way that a key's seeds take, not on what is found.
    """
    n = docs.count()
    mod = max(1, n // sample)
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("hot")), F.lit(mod)) == 0)
    return seed_rows(some, rules).groupBy("key").count().where(F.col("count") > max(20, int(rules.hot_share * n / mod))).select("key")


def chain(pieces: np.ndarray, rules: Rules) -> list[np.ndarray]:
    """Chains of diagonal pieces (start, end, source start), ascending by start, each piece once.

    A chain is cut where a gap is over ``max_gap``. One pass scores all pieces; chains are then taken from the best
    end on, each back to where a better one goes its own way.
    """
    n = len(pieces)
    x, x_end, y = pieces[:, 0], pieces[:, 1], pieces[:, 2]
    y_end = y + x_end - x
    ranks = np.unique(np.concatenate((y, y_end)))
    size = len(ranks)
    tree_score, tree_piece = [-1e18] * (size + 1), [-1] * (size + 1)
    y_at, end_at = np.searchsorted(ranks, y, "right").tolist(), (np.searchsorted(ranks, y_end) + 1).tolist()
    by_end = np.argsort(x_end, kind="stable").tolist()
    x, x_end, y, y_end = (v.tolist() for v in (x, x_end, y, y_end))
    score, back = [0.0] * n, [-1] * n
    c, waiting = rules.gap_cost, 0
    for i in range(n):
        while waiting < n and x_end[by_end[waiting]] <= x[i]:  # ends before this piece begins
            j = by_end[waiting]
            value, k = score[j] + c * (x_end[j] + y_end[j]), end_at[j]
            while k <= size:
                if tree_score[k] < value:
                    tree_score[k], tree_piece[k] = value, j
                k += k & -k
            waiting += 1
        best, j, k = -1e18, -1, y_at[i]
        while k > 0:
            if tree_score[k] > best:
                best, j = tree_score[k], tree_piece[k]
            k -= k & -k
        gain = best - c * (x[i] + y[i])
        if gain > 0 and max(x[i] - x_end[j], y[i] - y_end[j]) <= rules.max_gap:
            back[i] = j
        score[i] = x_end[i] - x[i] + (gain if back[i] >= 0 else 0.0)
    out, taken = [], [False] * n
    for i in np.argsort(-np.array(score), kind="stable").tolist():
        path = []
        while i >= 0 and not taken[i]:
            taken[i] = True
            path.append(i)
            i = back[i]
        if path:
            out.append(pieces[path[::-1]])
    return out


def pieces_of(pos: np.ndarray, source_pos: np.ndarray, k: int, max_gap: int) -> np.ndarray:
    """Diagonal pieces of matches in order of pos."""
    diagonal = pos - source_pos
    order = np.lexsort((pos, diagonal))
    d, p, s = diagonal[order], pos[order], source_pos[order]
    cut = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (p[1:] - p[:-1] > max_gap))))
    last = np.append(cut[1:], len(p)) - 1
    pieces = np.stack((p[cut], p[last] + k, s[cut]), axis=1).astype(np.int64)
    return pieces[np.lexsort((pieces[:, 1], pieces[:, 0]))]


CHAIN = "doc_id long, source long, x0 int, x1 int, y0 int, y1 int, pieces binary"


def chains(sorted_matches: DataFrame, rules: Rules) -> DataFrame:
    """Chains long enough for a passage, from matches sorted by doc_id, source and pos.

    Rows without a source are stretches of matches of any source: windows of ``min_words`` words from x0 up to x1
    are the only ones that an earlier document may have. Rows held are those of one document, whose length bounds them.
    """

    def of_doc(cols: list[np.ndarray]) -> Iterator[tuple]:
        doc, source, pos, source_pos = cols
        for p in np.split(np.arange(len(doc)), np.flatnonzero(doc[1:] != doc[:-1]) + 1):
            places = np.unique(pos[p])
            cut = np.flatnonzero(np.diff(places) > rules.window)  # seeds of a text are no farther apart
            begin = np.maximum(0, places[np.append(0, cut + 1)] - rules.window + 1)
            last = places[np.append(cut, -1)] - (rules.min_words - rules.k + 1 - rules.window)
            for x0, x1 in zip(begin[last >= begin].tolist(), last[last >= begin].tolist(), strict=True):
                yield int(doc[p[0]]), None, x0, x1 + rules.min_words, None, None, None
        start = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (source[1:] != source[:-1]))))
        end = np.append(start[1:], len(doc))
        span = pos[end - 1] + rules.k - pos[start]
        for a, b in zip(start[span >= rules.least_chain], end[span >= rules.least_chain], strict=True):
            pieces = pieces_of(pos[a:b], source_pos[a:b], rules.k, rules.max_gap)
            for part in chain(pieces, rules) if len(pieces) > 1 else [pieces]:
                x0, x1 = int(part[0, 0]), int(part[-1, 1])
                if x1 - x0 >= rules.least_chain:
                    yield int(doc[a]), int(source[a]), x0, x1, int(part[0, 2]), int(part[-1, 2] + part[-1, 1] - part[-1, 0]), part.astype(np.int32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        names = ["doc_id", "source", "x0", "x1", "y0", "y1", "pieces"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

        def emit(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            rows = list(of_doc(cols))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for b in batches:
            cols = [b.column(c).to_numpy() for c in ("doc_id", "source", "pos", "source_pos")]
            if carry is not None:
                cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
            if not len(cols[0]):
                continue
            done = int(np.searchsorted(cols[0], cols[0][-1]))
            carry = [c[done:] for c in cols]
            if done:
                yield from emit([c[:done] for c in cols])
        if carry is not None:
            yield from emit(carry)

    return sorted_matches.mapInArrow(run, CHAIN)


def word_arrays(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text_digest, words) of the documents named in ``ids`` (and of a few others), words being 32-bit digests."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom_bytes(ids))  # 4 MB at every size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bits = Hasher(), np.frombuffer(shared.value, np.uint8)
        for b in batches:
            wanted = maybe(b.column("doc_id").to_numpy(zero_copy_only=False), bits)
            part = b.filter(pa.array(wanted))
            for at, data, offsets in text_parts(part.column("text")):
                w = hasher.words(data, offsets)
                short = (w.digest >> U64(32)).astype(np.uint32)
                rows = [short[w.first[i] : w.first[i + 1]].tobytes() for i in range(w.n_docs)]
                yield pa.RecordBatch.from_arrays([*(part.column(c).slice(at, w.n_docs) for c in ("doc_id", "text_digest")), pa.array(rows, pa.binary())], names=["doc_id", "text_digest", "words"])

    return docs.withColumn("text_digest", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_digest long, words binary")


def numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) with one row for each id, and (own_id, doc_id) of those that have got another one.

    Of texts under one doc_id the one with the least digest keeps it. All others, and those without a doc_id, get
    numbers beyond the largest one, so they count as later documents. None where all ids differ.
    """
    several = scratch.save(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id"), "several", like=docs)
    if several.isEmpty():
        return docs, None
    rest = docs.join(several, "doc_id", "left_anti").where("doc_id IS NOT NULL")
    texts = docs.join(several.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").distinct()
    first = texts.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("x")).select("doc_id", F.col("x.text").alias("text"))
    first = scratch.save(first, "first-texts")
    others = texts.join(first.select(F.col("doc_id").alias("id"), F.col("text").alias("own")), F.col("doc_id") == F.col("id"), "left").where("id IS NULL OR text <> own")
    most = docs.agg(F.max("doc_id")).first()[0] or 0
    others = scratch.save(others.select(F.monotonically_increasing_id().alias("own_id"), "doc_id", "text"), "other-texts").withColumn("own_id", F.col("own_id") + F.lit(most + 1))
    return rest.union(first).union(others.select("own_id", "text")), others.select("own_id", "doc_id")


def align(d: np.ndarray, s: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """For each word of ``d``, the place of its counterpart in ``s``, or -1 if it has no equal one.

    ``pieces`` (start, end, source start) are the chain's, in order; what lies between, before and
    after them is aligned on the nearest diagonal, or by a longest common subsequence where a gap
    is longer on one side.
    """
    to = np.full(len(d), -1, np.int64)

    def diagonal(a: int, b: int, y: int) -> None:
        a2 = max(a, a - y, 0)
        b2 = min(b, a + len(s) - y, len(d))
        if b2 > a2:
            y2 = y + a2 - a
            same = d[a2:b2] == s[y2 : y2 + b2 - a2]
            to[a2:b2][same] = np.arange(y2, y2 + b2 - a2)[same]

    first, last = pieces[0], pieces[-1]
    diagonal(0, int(first[0]), int(first[2] - first[0]))
    for i, (x, end, y) in enumerate(pieces.tolist()):
        diagonal(x, end, y)
        if i + 1 < len(pieces):
            x2, y1, y2 = int(pieces[i + 1, 0]), y + end - x, int(pieces[i + 1, 2])
            if x2 - end == y2 - y1:
                diagonal(end, x2, y1)
            elif x2 > end and y2 > y1:
                for p, q in common_subsequence(d[end:x2], s[y1:y2]):
                    to[end + p] = y1 + q
    diagonal(int(last[1]), len(d), int(last[2] + last[1] - last[0]))
    return to


def common_subsequence(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    length = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        row = np.where(b == a[i], length[i + 1, 1:] + 1, length[i + 1, :-1])
        length[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif length[i + 1, j] >= length[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def stretches(match: np.ndarray, rules: Rules) -> list[tuple[int, int]]:
    """Maximal scoring stretches of at least ``min_words`` words that begin and end with a match."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], match.astype(np.int8), [0]))))
    runs = edge.reshape(-1, 2)
    out: list[tuple[int, int]] = []
    begin = best_end = None
    score = best = 0.0
    for a, b in runs.tolist():
        if begin is not None:
            score -= rules.mismatch * (a - last)
            if score <= 0 or best - score > rules.drop:
                if best_end - begin >= rules.min_words:
                    out.append((begin, best_end))
                begin = None
        if begin is None:
            begin, score, best = a, 0.0, 0.0
        score += b - a
        if score >= best:
            best, best_end = score, b
        last = b
    if begin is not None and best_end - begin >= rules.min_words:
        out.append((begin, best_end))
    return out


def window_digests(hasher: Hasher, short: np.ndarray, n: int) -> np.ndarray:
    """Digests of all windows of ``n`` words, from the words' 32-bit digests."""
    if len(short) < n:
        return np.zeros(0, np.int64)
    up, down = hasher._powers(len(short))
    sums = np.zeros(len(short) + 1, np.uint64)
    np.cumsum(mix(short.astype(np.uint64) + U64(1)) * up, out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(short) - n + 1]).view(np.int64)


def exact_passages(docs: DataFrame, stretches: DataFrame, spans: DataFrame, words: DataFrame, scratch: Scratch, rules: Rules) -> DataFrame | None:
    """Passages of equal words for the windows of ``stretches`` that aren't wholly in ``spans``.

    A window's source is the smallest document that has it, where it begins there first. None if no window is open.
    """
    n = rules.min_words
    own = stretches.select("doc_id", F.col("x0").alias("a"), (F.col("x1") - n).alias("b"), F.lit(False).alias("held"))
    own = own.union(spans.select("doc_id", "start_word", F.col("start_word") + F.col("n_words") - n, F.lit(True)))
    own = own.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b", "held")).alias("own"))  # a document's own

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, windows = [], []
            for d, x in zip(b.column("doc_id").to_pylist(), b.column("own").to_pylist(), strict=True):
                size = max(r["b"] for r in x) + 1
                free, outside = np.zeros(size, bool), np.ones(size + n - 1, np.int64)
                for r in x:
                    if r["held"]:
                        outside[r["a"] : r["b"] + n] = 0
                    else:
                        free[r["a"] : r["b"] + 1] = True
                left = np.concatenate(([0], np.cumsum(outside)))
                free &= left[n:] > left[:-n]
                if free.any():
                    ids.append(d)
                    windows.append(np.flatnonzero(free).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(windows, pa.binary())], names=["doc_id", "windows"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            for d, at, w in zip(b.column("doc_id").to_pylist(), b.column("windows"), b.column("words"), strict=True):
                at, w = np.frombuffer(at.as_buffer(), np.int32), np.frombuffer(w.as_buffer(), np.uint32)
                at = at[at <= len(w) - n]
                yield pa.RecordBatch.from_arrays([pa.array(window_digests(hasher, w, n)[at]), pa.array(np.full(len(at), d, np.int64)), pa.array(at)], names=["digest", "doc_id", "pos"])

    wanted = scratch.save(own.mapInArrow(rest, "doc_id long, windows binary").join(words, "doc_id").mapInArrow(digests, "digest long, doc_id long, pos int"), "open")
    n_open = wanted.count()
    if not n_open:
        return None
    bits = min(28, max(BITS, (8 * n_open).bit_length()))  # 32 MB at most
    shared = docs.sparkSession.sparkContext.broadcast(bloom_bytes(wanted.select("digest"), bits))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bitmap = Hasher(), np.frombuffer(shared.value, np.uint8)
        for b in batches:
            cols: list[list[np.ndarray]] = [[], [], []]
            for at, data, offsets in text_parts(b.column("text")):
                w = hasher.words(data, offsets)
                digest = window_digests(hasher, (w.digest >> U64(32)).astype(np.uint32), n)
                if not len(digest):
                    continue
                found = np.flatnonzero(w.doc[: len(digest)] == w.doc[n - 1 :])
                found = found[maybe(digest[found], bitmap, bits)]
                row = w.doc[found]
                ids = b.column("doc_id").slice(at, w.n_docs).to_numpy(zero_copy_only=False)[row]
                for c, x in zip(cols, (digest[found], ids, (found - w.first[row]).astype(np.int32)), strict=True):
                    c.append(x)
            if cols[0]:  # of each window of a batch, the first place
                digest, ids, pos = map(np.concatenate, cols)
                order = np.lexsort((pos, ids, digest))
                first = order[np.concatenate(([True], digest[order][1:] != digest[order][:-1]))] if len(order) else order
                yield pa.RecordBatch.from_arrays([pa.array(digest[first]), pa.array(ids[first]), pa.array(pos[first])], names=["digest", "doc_id", "pos"])

    heads = docs.mapInArrow(scan, "digest long, doc_id long, pos int").groupBy("digest").agg(F.min(F.struct("doc_id", "pos")).alias("head"))
    hits = wanted.join(heads, "digest").where("head.doc_id < doc_id").groupBy("doc_id", F.col("head.doc_id").alias("source")).agg(F.collect_list(F.struct("pos", F.col("head.pos").alias("source_pos"))).alias("places"))
    hits = scratch.save(hits, "hits", ("open",))
    both = scratch.save(word_arrays(docs, hits.select("doc_id").union(hits.select("source"))), "hit-words")
    low, high = [F.array_min(f"places.{c}") for c in ("pos", "source_pos")], [F.array_max(f"places.{c}") + n for c in ("pos", "source_pos")]
    pairs = hits.join(both, "doc_id").select("doc_id", "text_digest", "source", "places", low[0].alias("x"), slice_words("words", low[0], high[0]).alias("mine"))
    pairs = pairs.join(both.select(F.col("doc_id").alias("source"), F.col("words")), "source").select("doc_id", "text_digest", "source", "places", "x", low[1].alias("y"), "mine", slice_words("words", low[1], high[1]).alias("theirs"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r, m, t in zip(b.drop_columns(["mine", "theirs"]).to_pylist(), b.column("mine"), b.column("theirs"), strict=True):
                d, s = np.frombuffer(m.as_buffer(), np.uint32), np.frombuffer(t.as_buffer(), np.uint32)
                done = -1  # the last window of the passages so far
                for x, y in sorted((p["pos"] - r["x"], p["source_pos"] - r["y"]) for p in r["places"]):
                    if x <= done or not np.array_equal(d[x : x + n], s[y : y + n]):
                        continue  # digests of other words agree
                    after = min(len(d) - x, len(s) - y)
                    other = np.flatnonzero(d[x : x + after] != s[y : y + after])
                    size = int(other[0]) if len(other) else after
                    rows.append((r["doc_id"], r["text_digest"], r["x"] + x, size, r["source"], r["y"] + y, size, size))
                    done = x + size - n
            if rows:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "text_digest", "start_word", "n_words", "source_doc_id", "source_start_word", "source_words", "matched"])

    out = scratch.save(pairs.mapInArrow(extend, SPAN).distinct(), "exact-spans", ("hits",))
    scratch.drop("open", "hits", "hit-words")
    return out


SPAN = "doc_id long, text_digest long, start_word int, n_words int, source_doc_id long, source_start_word int, source_words int, matched int"


def passages(docs: DataFrame, scratch: Scratch, rules: Rules | None = None) -> DataFrame:
    """The passages of ``docs`` (doc_id, text) that a document with a smaller doc_id has too.

    One row for each passage and source: doc_id, text_digest, start_word, n_words and the source's
    doc_id, first word and words, with the number of equal words. Of all documents with a passage, the one with
    the smallest doc_id has no row for it. Passages of one document may overlap. Of every run of
    ``min_words`` equal words that an earlier document has, all words lie in them.

    Null and short texts have none. Rows repeated with doc_id and text are one document. Of differing texts under
    one doc_id the one with the least digest is the document of that id; the others, and rows without a doc_id,
    count as documents after all others, in an order of their own. ``text_digest``, ``xxhash64`` of the text, tells
    them apart. Only doc_id and text are read; an empty table gives no rows.
    """
    rules = rules or Rules()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    docs, own_ids = numbered(docs, scratch)
    spark = docs.sparkSession
    keys = sorted(r[0] for r in hot_keys(docs, rules).collect())  # at most 1 / hot_share times the seeds of a document
    hot = heads = None
    if keys:
        hot = spark.sparkContext.broadcast(np.array(keys, np.int64))
        rank = F.shiftright("pos", 32).alias("rank")
        first = seed_rows(docs, rules, hot).groupBy("key", rank).agg(F.min(F.struct("doc_id", "pos")).alias("x")).select("key", "x.doc_id", "x.pos").orderBy("key", "rank").collect()
        key, at_doc, at_pos = (np.array(x, np.int64) for x in zip(*first, strict=True))
        heads = spark.sparkContext.broadcast((np.stack((at_doc, at_pos & 0xFFFFFFFF, below(key, at_doc))), np.searchsorted(key, np.array(keys, np.int64))))
    rows = seed_rows(docs, rules, hot, heads).repartition("key").sortWithinPartitions("key", "doc_id", "pos")
    matches = scratch.save(first_matches(rows), "matches", like=docs)
    linked = scratch.save(chains(matches.repartition("doc_id").sortWithinPartitions("doc_id", "source", "pos", "source_pos"), rules), "chains", like=docs)
    scratch.drop("matches")
    found, stretched = linked.where("source IS NOT NULL"), linked.where("source IS NULL").select("doc_id", "x0", "x1")
    words = scratch.save(word_arrays(docs, linked.select("doc_id").union(found.select("source"))), "words")
    pad = rules.pad
    mine = found.join(words, "doc_id").select("doc_id", "text_digest", "source", "x0", "y0", "y1", "pieces", slice_words("words", F.col("x0") - pad, F.col("x1") + pad).alias("mine"))
    both = mine.join(words.select(F.col("doc_id").alias("source"), "words"), "source")
    both = both.select("doc_id", "text_digest", "source", "x0", "y0", "pieces", "mine", slice_words("words", F.col("y0") - pad, F.col("y1") + pad).alias("theirs"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for r, m, t in zip(b.drop_columns(["mine", "theirs"]).to_pylist(), b.column("mine"), b.column("theirs"), strict=True):
                d, s = np.frombuffer(m.as_buffer(), np.uint32), np.frombuffer(t.as_buffer(), np.uint32)
                dx, dy = max(0, r["x0"] - pad), max(0, r["y0"] - pad)
                pieces = np.frombuffer(r["pieces"], np.int32).reshape(-1, 3) - np.array([dx, dx, dy])
                to = align(d, s, pieces)
                for x, y in stretches(to >= 0, rules):
                    spans.append((r["doc_id"], r["text_digest"], dx + x, y - x, r["source"], dy + int(to[x]), int(to[y - 1] - to[x] + 1), int((to[x:y] >= 0).sum())))
            if spans:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*spans, strict=True), types, strict=True)], names=["doc_id", "text_digest", "start_word", "n_words", "source_doc_id", "source_start_word", "source_words", "matched"])

    spans = scratch.save(both.mapInArrow(measure, SPAN).distinct(), "spans", ("chains",))
    exact = exact_passages(docs, stretched, spans, words, scratch, rules)
    scratch.drop("words", "chains")
    spans = spans if exact is None else spans.union(exact)
    if own_ids is None:
        return spans
    for c in ("doc_id", "source_doc_id"):
        named = spans.join(own_ids.select("own_id", F.col("doc_id").alias("id")), F.col(c) == F.col("own_id"), "left")
        spans = named.withColumn(c, F.when(F.col("own_id").isNull(), F.col(c)).otherwise(F.col("id"))).drop("own_id", "id")
    return spans


def slice_words(words: str, low: Column, high: Column) -> Column:
    """The part of a column of 32-bit words from ``low``, or the first one, up to ``high``."""
    low = F.greatest(low, F.lit(0))
    return F.substring(F.col(words), low * 4 + 1, (high - low) * 4)


def without(texts: pa.Array, cuts: pa.Array) -> pa.Array:
    """Each text without its cuts (start_word, n_words) and the space after them; null if no word is left."""
    hasher, out = Hasher(), []
    for text, cut in zip(texts, cuts, strict=True):
        if not text.is_valid:
            out.append(None)
            continue
        raw = text.as_buffer().to_pybytes()
        w = hasher.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        gone = np.zeros(len(w.start) + 1, np.int8)
        for c in cut.as_py():
            gone[c["start_word"] : c["start_word"] + c["n_words"]] = 1
        gone[-1] = 0
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone)))).reshape(-1, 2)
        kept, at = [], 0
        for a, z in edge.tolist():
            kept.append(raw[at : w.start[a]])
            at = int(w.start[z]) if z < len(w.start) else len(raw)
        kept.append(raw[at:])
        out.append(None if len(w.start) and gone[:-1].all() else b"".join(kept).decode())
    return pa.array(out, pa.string())


def remove_passages(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` without the words of ``spans`` (doc_id, text_digest, start_word, n_words) and the space after them.

    Other columns stay as they are, whatever their names, but ``n_chars``, if there, is counted anew where words
    went. Rows of whose words none is left are left out; null texts and texts without words stay. Rows repeated
    with doc_id and text are cut alike. Only texts that lose words go through Python.
    """
    cut = spans.groupBy(F.col("doc_id").alias("cut_id"), F.col("text_digest").alias("cut_digest")).agg(F.collect_set(F.struct("start_word", "n_words")).alias("cuts"))  # a text's own
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(F.col("text").cast("string")).alias("own_digest"))
    joined = whole.join(cut, F.col("own_id").eqNullSafe(F.col("cut_id")) & (F.col("own_digest") == F.col("cut_digest")), "left")
    hit = F.col("cuts").isNotNull()
    new = F.arrow_udf(without, T.StringType()).asNondeterministic()(F.when(hit, F.col("row.text").cast("string")), F.coalesce("cuts", F.array().cast("array<struct<start_word:int,n_words:int>>")))
    out = joined.select("row", hit.alias("hit"), new.alias("new")).where("NOT hit OR new IS NOT NULL")
    changed = {"text": F.col("new").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("row.n_chars").isNotNull(), F.length("new")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(F.when(F.col("hit"), changed[c]).otherwise(F.col("row")[c]).alias(c) if c in changed else F.col("row")[c].alias(c) for c in docs.columns))
