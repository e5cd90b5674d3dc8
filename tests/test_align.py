import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from actlens.functions import text as T
from actlens.functions.text import PIECES, normalize
from actlens.operators import align, chunk
from actlens.operators.align import align_boundaries, align_exact, tokenizers


def mock(vocab, special=()):
    def decode(ids):
        return "".join(vocab.get(i, "") for i in ids)

    return decode, lambda i: i not in special and vocab.get(i, "").strip() != ""


def run(cases, tie="first", max_window=16):
    pairs = [mock(v, s) for v, s, _ in cases]
    return align_exact([t for _, _, t in cases], [d for d, _ in pairs], [c for _, c in pairs], max_window, tie=tie)


ABC = {0: "a", 1: "b", 2: "c"}
CASES = [
    ([(ABC, (), [0, 1, 2])] * 2, [[0, 1, 2]] * 2, True),
    ([({100: "1989"}, (), [100]), ({200: "198", 201: "9"}, (), [200, 201])], [[0], [1]], True),
    ([({10: "hello", 11: " world"}, (), [10, 11]), ({20: "hel", 21: "lo", 22: " world"}, (), [20, 21, 22])], [[0, 1], [1, 2]], True),
    ([({999: "<bos>", 10: "hello"}, (999,), [999, 10]), ({10: "hello"}, (), [10])], [[1], [0]], True),
    ([({10: "hello"}, (), [10]), ({20: "xyz"}, (), [20])], [[], []], False),
    ([({10: "hello", 30: "QQ"}, (), [10, 30]), ({10: "hello", 40: "PP"}, (), [10, 40])], [[0], [0]], False),
    ([({i: "a" for i in range(20)}, (), list(range(20))), ({100: "a" * 20}, (), [100])], [[], []], False),
    ([(ABC, (), [0, 1, 2])] * 3, [[0, 1, 2]] * 3, True),
    ([({100: "1989"}, (), [100]), ({200: "198", 201: "9"}, (), [200, 201]), ({300: "1", 301: "989"}, (), [300, 301])], [[0], [1], [1]], True),
    ([({10: "hello"}, (), [10]), ({20: "hello"}, (), [20]), ({30: "xyz"}, (), [30])], [[], [], []], False),
]


@pytest.mark.parametrize("streams,ends,completed", CASES)
def test_cases(streams, ends, completed):
    out = run(streams)
    assert (out.ends, out.completed) == (ends, completed)


def test_window_cap_allows_one_more():
    for n, ok in ((16, True), (17, True), (18, False)):
        out = run([({0: "a"}, (), [0] * n), ({1: "a" * n}, (), [1])])
        assert out.completed is ok and len(out.ends[0]) == int(ok)


def test_tie_rule():
    streams = [({0: "é", 1: "x"}, (), [0, 1]), ({0: "e", 1: "́", 2: "x"}, (), [0, 1, 2])]
    assert run(streams).ends == [[1], [2]]
    assert run(streams, tie="last").ends == [[0, 1], [1, 2]]


def test_needs_two_streams():
    with pytest.raises(ValueError):
        run([(ABC, (), [0])])


def test_empty_stream_gives_nothing():
    assert run([(ABC, (), [0]), (ABC, (), [])]).ends == [[], []]
    assert align_boundaries([["a"], []]).ends == [[], []]


def exact_pieces(pieces, max_window):
    decode = [lambda ids, p=p: "".join(p[i] for i in ids) for p in pieces]
    content = [lambda i, p=p: p[i].strip() != "" for p in pieces]
    return align_exact([list(range(len(p))) for p in pieces], decode, content, max_window)


def test_boundaries_equal_the_walk():
    r = random.Random(5)
    for _ in range(3000):
        text = "".join(r.choice("abAB \n") for _ in range(r.randint(0, 24)))
        pieces = []
        for _ in range(r.randint(2, 4)):
            cuts = sorted({0, len(text), *(r.randint(0, len(text)) for _ in range(r.randint(0, 12)))})
            pieces.append([text[a:b] for a, b in zip(cuts, cuts[1:])])
        cap = r.choice((1, 2, 3, 5, 16))
        a, b = exact_pieces(pieces, cap), align_boundaries(pieces, cap)
        assert (a.ends, a.completed) == (b.ends, b.completed), (pieces, cap)
        assert a.starts == b.starts


def test_tokenizers_join_to_the_text():
    text = "Ünï 12 été,\n ok--x 漢字\t!"
    for f in tokenizers(range(len(PIECES))):
        assert "".join(f(text)) == text


def test_normalize():
    assert [normalize(x) for x in ("HELLO", "  hello   world  ", "ﬁle")] == ["hello", "hello world", "file"]


def texts_of(r, n):
    parts = ["a", "B", "19", ".", "-", " ", " ", "\n", "é", "漢", "\u3000", "\xa0", "😀", "\t", "ß", "ﬁ", "\u0301", "x" * 30, "y" * 51]
    return ["".join(r.choice(parts) for _ in range(r.choice((0, 3, 20, 60)))) for _ in range(n)]


def test_many_chunks_in_plain_columns(spark):
    """Ends and windows of many chunks at once are those of the walk over one."""
    texts = texts_of(random.Random(3), 300)
    chunks = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, chunk_text string").selectExpr("doc_id", "1 AS chunk_idx", "chunk_text").coalesce(1)
    got = {}
    for r in align.align_ends(chunks, windows=(1,)).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_idx, r.k, [r.end0, r.end1, r.end2], r.window1, r.completed))
    broken = 0
    for i, text in enumerate(texts):
        pieces = [f(text) for f in tokenizers((0, 1, 2))]
        want = exact_pieces(pieces, align.MAX_WINDOW)
        broken += not want.completed
        rows = zip(want.starts[1], *want.ends, strict=True)
        assert got.get(i, []) == [(1, k, list(e), "".join(pieces[1][s : e[1] + 1]), want.completed) for k, (s, *e) in enumerate(rows)]
    assert broken > 10 and 300 not in got


def test_pieces_begin_where_the_patterns_say(spark):
    texts = texts_of(random.Random(9), 400)
    code, first = align.code_points(texts)
    for i, f in enumerate(tokenizers((0, 1, 2))):
        want = [at + sum(map(len, p[:k])) for at, p in zip(first.tolist(), map(f, texts)) for k in range(len(p))]
        assert T.piece_starts(code, first, i).tolist() == want
    assert T.piece_starts(*align.code_points(["", ""]), 1).tolist() == []
    chunks = spark.createDataFrame([(5, 2, "ab cd")], "doc_id long, chunk_idx int, chunk_text string")
    assert [tuple(r) for r in align.align_ends(chunks, (0, 1)).collect()] == [(5, 2, 0, 0, 0, True), (5, 2, 1, 1, 1, True)]


def test_summary_of_many_chunks(spark, monkeypatch):
    """Whatever number of characters is aligned at once, also beside empty, null and long chunks."""
    texts = [*texts_of(random.Random(4), 200), None, "z" * 5000, ""]
    rows = [(i, 0, t) for i, t in enumerate(texts)]
    want = []
    for i, t in enumerate(texts):
        pieces = [f(t or "") for f in tokenizers((0, 1, 2))]
        met = exact_pieces(pieces, align.MAX_WINDOW)
        want.append((i, [len(p) for p in pieces], len(met.ends[0]), met.completed))
    for size in (1, 500, 1 << 17):
        monkeypatch.setattr(align, "AT_ONCE", size)
        chunks = spark.createDataFrame(rows, "doc_id long, chunk_idx int, chunk_text string").coalesce(1)
        assert [(r.doc_id, r.n_tokens, r.n_aligned, r.completed) for r in align.align_summary(chunks).collect()] == want


def test_positions_of_all_matches(spark, monkeypatch):
    """Numbered over documents, chunks and matches in bounded parts; vectors are made for the wanted chunks alone."""
    monkeypatch.setattr(chunk, "PART", 2_000, raising=False)
    r = random.Random(8)
    docs = [(i * 3 - 90, "\n".join(t for t in texts_of(r, r.choice((0, 1, 9))))) for i in range(120)]
    docs += [(None, "n o"), (500, "p q"), (500, "p q"), (500, "r s"), (501, None)]
    table = spark.createDataFrame(r.sample(docs, len(docs)), "doc_id long, text string")

    def number(stream, toks):
        return np.array([ord(t[0]) for t in toks])

    def vectors(stream, toks):
        return np.stack([np.arange(len(toks)) + stream, list(map(len, toks))], axis=1)

    def strict(stream, toks):
        assert len(toks) < 0, "not wanted"

    def plain(rows):
        return [(p.pos_id, p.last_tok, [p.vectors.v0, p.vectors.v2]) for p in rows.orderBy("pos_id").collect()]

    chunks = sorted(((-1000 if c.doc_id is None else c.doc_id, c.chunk_idx, c.chunk_text) for c in chunk.paragraph_chunks(table, 16).collect()))
    cut, want = tokenizers((0, 2)), []
    for *_, text in chunks:
        pieces = [f(text) for f in cut]
        for ends in zip(*exact_pieces(pieces, align.MAX_WINDOW).ends, strict=True):
            want.append((len(want), [ord(p[e][0]) for p, e in zip(pieces, ends)], [[e + s, len(p[e])] for s, p, e in zip((0, 2), pieces, ends)]))
    every = align.gather_positions(table, 16, (0, 2), vectors, number)
    held = every.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert plain(every) == want and len(held) > 4 and max(t["count"] for t in held) < len(want) / 2
    assert plain(align.gather_positions(table, 16, (0, 2), vectors, number, low=7, high=1000)) == want[7:1000]
    assert plain(align.gather_positions(table, 16, (0, 2), strict, number, low=len(want), high=len(want) + 9)) == []
    assert plain(align.gather_positions(table.where("doc_id = 501"), 16, (0, 2), strict, number)) == []
