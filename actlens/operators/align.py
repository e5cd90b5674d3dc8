"""N-way alignment of token sequences by their text.

Several tokenizers cut one text differently. The alignment walks all sequences at once: content tokens
whose normalised texts are equal match one to one; else windows grow, the one with the shortest text
first, until their texts are equal, and each stream's last token stands for its window. A window that
outgrows ``max_window`` ends the chunk: what came before stays, and the chunk is incomplete.

``align_exact`` states this for any tokenizer. For tokenizers whose pieces join to the text,
``align_boundaries`` gives the same answer from the number of solid characters after each token: the
streams match exactly where these numbers meet. ``meet_texts`` is the same for the tokenizers of :data:`PIECES` and many
chunks at once, in arrays over their characters. All work on one chunk in one row, so none shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens.functions.text import PIECES, normalize, piece_starts
from actlens.operators import chunk

MAX_WINDOW = 16


@dataclass
class Aligned:
    """``ends[i]`` has, for each match, the position of stream i's last token; ``starts`` that of its first."""

    starts: list[list[int]]
    ends: list[list[int]]
    completed: bool


def align_exact(streams: Sequence[Sequence[int]], decode: Sequence[Callable[[Sequence[int]], str]], content: Sequence[Callable[[int], bool]], max_window: int = MAX_WINDOW, norm: Callable[[str], str] = normalize, tie: str = "first") -> Aligned:
    """Aligns token ids. ``tie`` says which of equally short windows grows: the first stream's or the last one's."""
    n = len(streams)
    if n < 2:
        raise ValueError("alignment needs two streams")
    at = [0] * n
    out = Aligned([[] for _ in streams], [[] for _ in streams], True)

    def text(i: int, end: int) -> str:
        return norm(decode[i](streams[i][at[i] : end]))

    while True:
        for i, s in enumerate(streams):
            while at[i] < len(s) and not content[i](s[at[i]]):
                at[i] += 1
        if any(at[i] >= len(s) for i, s in enumerate(streams)):
            return out
        ends = [p + 1 for p in at]
        texts = [text(i, ends[i]) for i in range(n)]
        while len(set(texts)) > 1:
            order = sorted(range(n), key=lambda i: (len(texts[i]), i if tie == "first" else -i))
            grow = next((i for i in order if ends[i] < len(streams[i])), None)
            if grow is None or any(e - p > max_window for e, p in zip(ends, at, strict=True)):
                out.completed = False
                return out
            ends[grow] += 1
            texts[grow] = text(grow, ends[grow])
        for i in range(n):
            out.starts[i].append(at[i])
            out.ends[i].append(ends[i] - 1)
        at = ends


def align_boundaries(pieces: Sequence[Sequence[str]], max_window: int = MAX_WINDOW) -> Aligned:
    """Aligns token pieces that join to one text."""
    starts, ends, completed = meet(pieces, max_window)
    return Aligned([s.tolist() for s in starts], [e.tolist() for e in ends], completed)


#: Which code points, of the first 2**16, are no white space; none beyond is.
SOLID = np.frombuffer(bytes(not chr(i).isspace() for i in range(1 << 16)), bool)


def solid_counts(pieces: Sequence[str]) -> np.ndarray:
    """Characters of each piece that aren't white space."""
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    code = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    sums = np.concatenate(([0], np.cumsum(SOLID[np.minimum(code, (1 << 16) - 1)])))[np.concatenate(([0], ends)).astype(np.int64)]
    return np.diff(sums)


def meet(pieces: Sequence[Sequence[str]], max_window: int) -> tuple[list[np.ndarray], list[np.ndarray], bool]:
    """For each stream the first and last tokens of the windows that match, and whether the walk came to the end."""
    solid = [solid_counts(s) for s in pieces]
    places = [np.flatnonzero(x) for x in solid]
    marks = [np.cumsum(x)[p] for x, p in zip(solid, places, strict=True)]
    common = marks[0]
    for m in marks[1:]:
        common = np.intersect1d(common, m, assume_unique=True)
    index = [np.searchsorted(m, common) for m in marks]
    ends = [p[i] for p, i in zip(places, index, strict=True)]
    starts = [p[np.concatenate(([0], i[:-1] + 1))] if len(i) else p[:0] for p, i in zip(places, index, strict=True)]
    sizes = np.array([e - s + 1 for s, e in zip(starts, ends, strict=True)])
    over = np.flatnonzero((sizes > max_window).any(axis=0)) if len(common) else []
    keep, completed = len(common), all(len(m) == 0 or len(common) and m[-1] == common[-1] for m in marks) or any(len(m) == 0 for m in marks)
    for k in over:
        wide = [i for i in range(len(pieces)) if sizes[i, k] > max_window]
        last = max((i for i in range(len(pieces)) if sizes[i, k] > 1), key=lambda i: (len(normalize("".join(pieces[i][starts[i][k] : ends[i][k]]))), i))
        if len(wide) > 1 or sizes[wide[0], k] > max_window + 1 or wide[0] != last:
            keep, completed = int(k), False
            break
    return [s[:keep] for s in starts], [e[:keep] for e in ends], bool(completed)


#: Characters of the chunks that are aligned at once: few enough for a processor's cache.
AT_ONCE = 1 << 17


@dataclass
class Met:
    """Matches of several chunks, in order. Arrays: a match's chunk; by stream, its first and last tokens and, in the joined
    text, where its window begins and ends. By chunk: tokens by stream, matches, and whether the walk came to the end."""

    owner: np.ndarray
    starts: list[np.ndarray]
    ends: list[np.ndarray]
    begins: list[np.ndarray]
    stops: list[np.ndarray]
    n_tokens: list[np.ndarray]
    n_aligned: np.ndarray
    completed: np.ndarray

    def place(self) -> np.ndarray:
        """A match's number in its chunk."""
        return np.arange(len(self.owner)) - np.repeat(np.cumsum(self.n_aligned) - self.n_aligned, self.n_aligned)


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts, joined, and where each begins, with the end of the last."""
    first = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), first


def meet_texts(code: np.ndarray, first: np.ndarray, streams: Sequence[int], max_window: int) -> Met:
    """:func:`meet` for each text by itself, of pieces that join to it. One stream alone matches itself at every content token."""
    upto = np.zeros(len(code) + 1, np.int64)  # solid characters before each place
    np.cumsum(SOLID[np.minimum(code, (1 << 16) - 1)], out=upto[1:])
    before = upto[first]
    cut, seen = [], []
    for s in streams:
        at = piece_starts(code, first, s)
        after = upto[np.append(at[1:], len(code))]
        content = np.flatnonzero(after > upto[at])
        here = np.zeros(upto[-1] + 1, bool)
        here[after[content]] = True
        cut.append((at, content))
        seen.append(here)
    common = np.flatnonzero(np.logical_and.reduce(seen))
    owner = np.searchsorted(before, common) - 1
    new = np.ones(len(common), bool)
    new[1:] = owner[1:] != owner[:-1]
    starts, ends, begins, stops, n_tokens = [], [], [], [], []
    for (at, content), here in zip(cut, seen, strict=True):
        rank = np.cumsum(here)  # content tokens up to each mark
        index = rank[common] - 1
        since = np.zeros(len(common), np.int64)
        since[1:] = index[:-1] + 1
        since[new] = rank[before[owner[new]]]
        own = np.searchsorted(at, first)
        starts.append(content[since] - own[owner])
        ends.append(content[index] - own[owner])
        begins.append(at[content[since]])
        stops.append(np.append(at[1:], len(code))[content[index]])
        n_tokens.append(np.diff(own))
    sizes = np.array([e - s + 1 for s, e in zip(starts, ends, strict=True)])
    completed, gone = np.ones(len(first) - 1, bool), np.zeros(len(common), bool)
    for k in np.flatnonzero((sizes > max_window).any(axis=0)).tolist() if len(streams) > 1 else ():
        if not completed[owner[k]]:
            continue
        wide = np.flatnonzero(sizes[:, k] > max_window)
        inner = {i: code[begins[i][k] : at[np.searchsorted(at, stops[i][k]) - 1]] for i, (at, _) in enumerate(cut) if sizes[i, k] > 1}
        last = max(inner, key=lambda i: (len(normalize(inner[i].tobytes().decode("utf-32-le", "surrogatepass"))), i))
        if len(wide) > 1 or sizes[wide[0], k] > max_window + 1 or wide[0] != last:
            completed[owner[k]] = False
            gone[k : np.searchsorted(owner, owner[k], "right")] = True
    if gone.any():
        owner, starts, ends, begins, stops = owner[~gone], *([x[~gone] for x in each] for each in (starts, ends, begins, stops))
    return Met(owner, starts, ends, begins, stops, n_tokens, np.bincount(owner, minlength=len(first) - 1), completed)


def met_parts(texts: pa.Array, streams: Sequence[int], max_window: int) -> Iterator[tuple[int, int, np.ndarray, Met]]:
    """(from, to, code points, matches) of the chunks of a batch, some at once; null counts as empty."""
    held = [t or "" for t in texts.to_pylist()]
    low = size = 0
    for high, text in enumerate(held, 1):
        size += len(text)
        if size >= AT_ONCE or high == len(held):
            code, first = code_points(held[low:high])
            yield low, high, code, meet_texts(code, first, streams, max_window)
            low, size = high, 0


def window_texts(code: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The texts of windows that follow each other without overlap."""
    step = np.zeros(len(code) + 1, np.int8)
    step[begins] += 1
    step[stops] -= 1
    data = code[np.cumsum(step[:-1], dtype=np.int8).astype(bool)].tobytes().decode("utf-32-le", "surrogatepass").encode()
    upto = np.zeros(len(code) + 1, np.int64)
    np.cumsum(1 + (code >= 0x80).astype(np.int8) + (code >= 0x800) + (code >= 0x10000), out=upto[1:])
    offsets = np.concatenate(([0], np.cumsum(upto[stops] - upto[begins]))).astype(np.int32)
    return pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(data))


ALIGNED = "doc_id long, chunk_idx int, k int, starts array<int>, ends array<int>, windows array<string>, completed boolean"
SUMMARY = "doc_id long, chunk_idx int, n_tokens array<int>, n_aligned int, completed boolean"


def tokenizers(streams: Sequence[int]) -> list[Callable[[str], list[str]]]:
    return [re.compile(PIECES[i]).findall for i in streams]


def align_chunks(chunks: DataFrame, streams: Sequence[int] = (0, 1, 2), max_window: int = MAX_WINDOW) -> DataFrame:
    """One row for each match of each chunk (doc_id, chunk_idx, chunk_text): windows of all streams.

    With one stream nothing is aligned: every content token is a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(streams)
        names = ["doc_id", "chunk_idx", "k", "starts", "ends", "windows", "completed"]
        for b in batches:
            for low, _, code, met in met_parts(b.column("chunk_text"), streams, max_window):
                owner, m = pa.array(low + met.owner), len(met.owner)
                lists = pa.array(np.arange(m + 1, dtype=np.int32) * n)
                columns = [pa.ListArray.from_arrays(lists, pa.array(np.stack(x, axis=1).reshape(-1).astype(np.int32))) for x in (met.starts, met.ends)]
                texts = pa.concat_arrays([window_texts(code, x, y) for x, y in zip(met.begins, met.stops, strict=True)])
                windows = texts.take(pa.array(np.arange(n * m).reshape(n, m).T.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(owner), b.column("chunk_idx").take(owner), pa.array(met.place().astype(np.int32)), *columns, pa.ListArray.from_arrays(lists, windows), pa.array(met.completed[met.owner])], names=names)

    return chunks.select("doc_id", "chunk_idx", "chunk_text").mapInArrow(run, ALIGNED)


def align_ends(chunks: DataFrame, streams: Sequence[int] = (0, 1, 2), windows: Sequence[int] = (), max_window: int = MAX_WINDOW) -> DataFrame:
    """(doc_id, chunk_idx, k, end0, end1, ..., window<i>, ..., completed): the rows of :func:`align_chunks`, in plain columns.

    Each stream of ``streams`` has its last token, and each of their places in ``windows`` the window's text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "chunk_idx", "k", *(f"end{i}" for i in range(len(streams))), *(f"window{i}" for i in windows), "completed"]
        for b in batches:
            for low, _, code, met in met_parts(b.column("chunk_text"), streams, max_window):
                owner = pa.array(low + met.owner)
                ends = [pa.array(e.astype(np.int32)) for e in met.ends]
                texts = [window_texts(code, met.begins[i], met.stops[i]) for i in windows]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(owner), b.column("chunk_idx").take(owner), pa.array(met.place().astype(np.int32)), *ends, *texts, pa.array(met.completed[met.owner])], names=names)

    fields = "".join(f"end{i} int, " for i in range(len(streams))) + "".join(f"window{i} string, " for i in windows)
    return chunks.select("doc_id", "chunk_idx", "chunk_text").mapInArrow(run, f"doc_id long, chunk_idx int, k int, {fields}completed boolean")


def align_summary(chunks: DataFrame, streams: Sequence[int] = (0, 1, 2), max_window: int = MAX_WINDOW) -> DataFrame:
    """One row for each chunk: tokens of each stream, matches, and whether the walk came to the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(streams)
        for b in batches:
            for low, high, _, met in met_parts(b.column("chunk_text"), streams, max_window):
                tokens = pa.ListArray.from_arrays(pa.array(np.arange(high - low + 1, dtype=np.int32) * n), pa.array(np.stack(met.n_tokens, axis=1).reshape(-1).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[low:high], b.column("chunk_idx")[low:high], tokens, pa.array(met.n_aligned.astype(np.int32)), pa.array(met.completed)], names=["doc_id", "chunk_idx", "n_tokens", "n_aligned", "completed"])

    return chunks.select("doc_id", "chunk_idx", "chunk_text").mapInArrow(run, SUMMARY)


Extract = Callable[[int, list[str]], np.ndarray]


def gathered(text: str, ends: Sequence[np.ndarray], streams: Sequence[int], cut: Sequence[Callable[[str], list[str]]], extract: Extract, token_id: Extract) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of one chunk: the numbers of the tokens at ``ends``, a column for each stream, and each stream's vectors there."""
    pieces = [f(text) for f in cut]
    tokens = [np.asarray(token_id(s, p))[e] for s, p, e in zip(streams, pieces, ends, strict=True)]
    return np.stack(tokens, axis=1).astype(np.int64), [np.asarray(extract(s, p), np.float32)[e] for s, p, e in zip(streams, pieces, ends, strict=True)]


def gathered_columns(parts: Sequence[tuple[np.ndarray, list[np.ndarray]]], streams: Sequence[int]) -> list[pa.Array]:
    """The columns last_tok and vectors of several chunks."""

    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))

    vectors = [lists(np.concatenate(v)) for v in zip(*(v for _, v in parts), strict=True)]
    return [lists(np.concatenate([t for t, _ in parts])), pa.StructArray.from_arrays(vectors, [f"v{s}" for s in streams])]


def gathered_fields(streams: Sequence[int]) -> str:
    return f"last_tok array<long>, vectors struct<{', '.join(f'v{s}: array<float>' for s in streams)}>"


def gather_aligned(chunks: DataFrame, streams: Sequence[int], extract: Extract, token_id: Extract, max_window: int = MAX_WINDOW) -> DataFrame:
    """(doc_id, chunk_idx, k, last_tok, vectors): what each stream has at the last token of each match's window.

    ``extract`` gives the vectors of all tokens of a chunk in a stream, a row each, and ``token_id`` their numbers: here a
    model takes its place. Chunks are whole rows, so nothing is shuffled. Chunks without a match have no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = tokenizers(streams)
        for b in batches:
            for low, _, _, met in met_parts(b.column("chunk_text"), streams, max_window):
                until = np.cumsum(met.n_aligned)
                for i in np.flatnonzero(met.n_aligned).tolist():
                    n, own = int(met.n_aligned[i]), slice(until[i] - met.n_aligned[i], until[i])
                    part = gathered(b.column("chunk_text")[low + i].as_py(), [e[own] for e in met.ends], streams, cut, extract, token_id)
                    same = pa.array(np.full(n, low + i))
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(same), b.column("chunk_idx").take(same), pa.array(np.arange(n, dtype=np.int32)), *gathered_columns([part], streams)], names=["doc_id", "chunk_idx", "k", "last_tok", "vectors"])

    return chunks.select("doc_id", "chunk_idx", "chunk_text").mapInArrow(run, f"doc_id long, chunk_idx int, k int, {gathered_fields(streams)}")


#: Bytes of vectors that go to Spark at once.
VECTOR_BYTES = 4 << 20


def gather_positions(docs: DataFrame, max_tokens: int, streams: Sequence[int], extract: Extract, token_id: Extract, max_window: int = MAX_WINDOW, low: int = 0, high: int | None = None) -> DataFrame:
    """(pos_id, last_tok, vectors): the rows of :func:`gather_aligned` for all documents' chunks, numbered in order of document,
    chunk and match, from position ``low`` up to ``high``.

    All documents are aligned and their matches counted, a number for each range of doc_id; there are as many ranges as the
    texts' bytes are worth. Ranges with a position that is wanted are aligned once more: their chunks are shuffled, sorted
    and numbered one by one, and ``extract`` sees those with such a position. Chunks that doc_id and chunk_idx don't tell
    apart come in an order of their texts.
    """
    docs = docs.where("text IS NOT NULL AND text <> ''").select("doc_id", "text")
    spans = chunk.ranges(docs, "doc_id", F.octet_length("text"))
    counts = align_summary(chunk.paragraph_chunks(docs, max_tokens), streams, max_window)
    before = list(accumulate(chunk.sums(counts, "doc_id", "n_aligned", spans), initial=0))
    end = before[-1] if high is None else min(high, before[-1])
    wanted = [i for i in range(len(spans)) if before[i] < end and before[i + 1] > low]
    one, last = (wanted[0], wanted[-1]) if wanted else (0, 0)
    base = before[one : last + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, now, at = tokenizers(streams), None, 0
        held, places, size = [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(places)), *gathered_columns(held, streams)], names=["pos_id", "last_tok", "vectors"])

        for b in batches:
            span = b.column("_b").to_pylist()
            for start, _, _, met in met_parts(b.column("chunk_text"), streams, max_window):
                done = 0
                for i, n in enumerate(met.n_aligned.tolist(), start):
                    if span[i] != now:
                        now, at = span[i], base[span[i]]
                    first, stop = max(low - at, 0), min(end - at, n)
                    if first < stop:
                        part = gathered(b.column("chunk_text")[i].as_py(), [e[done + first : done + stop] for e in met.ends], streams, cut, extract, token_id)
                        held.append(part)
                        places.append(np.arange(at + first, at + stop))
                        size += part[0].nbytes + sum(v.nbytes for v in part[1])
                        if size >= VECTOR_BYTES:
                            yield flush()
                            held, places, size = [], [], 0
                    at, done = at + n, done + n
        if held:
            yield flush()

    chunks = chunk.paragraph_chunks(docs.where(spans.within(F.col("doc_id"), one, last) if wanted else F.lit(False)), max_tokens)
    rows = chunks.select("doc_id", "chunk_idx", "chunk_text", (spans.of(F.col("doc_id")) - one).alias("_b"))
    rows = rows.repartitionById(len(base), F.col("_b")).sortWithinPartitions("_b", "doc_id", "chunk_idx", "chunk_text")
    return rows.mapInArrow(run, f"pos_id long, {gathered_fields(streams)}")
