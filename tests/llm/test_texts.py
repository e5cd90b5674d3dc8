"""Text operators against brute force, and models on held-out rows."""

import collections
import importlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from actlens.llm import decontaminate, language, mixing, partenum, quality, substring
from actlens.llm.components import components
from actlens.llm.samples import held_out
from actlens.llm.scratch import Scratch
from actlens.llm.words import Hasher, text_parts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def shingles(t, k=5):
    w = words(t)
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def vocabulary(n=400, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n)]


def corpus(seed=3, n=60):
    """Texts with exact and near copies, shared passages, short, empty and null ones."""
    r, v = random.Random(seed), vocabulary()
    passage = " ".join(r.choice(v) for _ in range(70))
    out = []
    for _ in range(n):
        out.append(" ".join(r.choice(v) for _ in range(r.randint(1, 160))))
    for i in range(0, 30, 2):
        w = out[i].split()
        for _ in range(r.randint(1, 3)):
            x = list(w)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                x[r.randrange(len(x))] = r.choice(v)
            out.append(" ".join(x).upper() if r.random() < 0.3 else "  ".join(x))
    for i in range(8):
        out.append(out[40 + i] + " " + passage + "\n" + out[50 + i])
    return out + ["", None, " \t\n", "one", "ONE", "one two", "a b c d", "A b\vc d", "caf\u00e9 \u00a0x", "x " * 300, "x " * 200]


def frame(spark, texts, extra=False):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"n": F.lit(1), "sid": F.lit("s")}) if extra else df


def test_words_and_shingles():
    texts = corpus() + ["tail"]
    h = Hasher()
    seen = {}
    for limit in (1 << 20, 50):
        for at, data, offsets in text_parts(pa.array(texts), limit):
            w = h.words(data, offsets)
            for i, s in enumerate(h.shingle_sets(w)):
                assert len(s) == len(shingles(texts[at + i])) and w.counts[i] == len(words(texts[at + i]))
                assert seen.setdefault(frozenset(shingles(texts[at + i])), tuple(s)) == tuple(s)


def test_words_take_little_memory():
    """Many texts of a batch are hashed in small pieces: six workers share an executor's memory with its JVM."""
    texts, hasher = pa.array(["some words of a text " * 100] * 2000), Hasher()
    tracemalloc.start()
    try:
        n = sum(len(hasher.words(data, offsets).digest) for _, data, offsets in text_parts(texts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 1_000_000 and peak < 32 << 20


def brute_components(texts, ids=None):
    sets, ids = [shingles(t) for t in texts], ids or list(range(len(texts)))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(sets)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [(ids[i], len(sets[i]), least.get(find(i)) if sets[i] else ids[i]) for i in range(len(sets))]


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("group", [64, 3])
def test_near_copies(spark, monkeypatch, group):
    monkeypatch.setattr(partenum, "GROUP", group)  # with 3, most groups count as frequent
    monkeypatch.setattr(partenum, "BLOCK", 4)
    texts = corpus() + corpus()[:5]
    got = partenum.near_copies(frame(spark, texts, True), Scratch(spark, "t")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(texts))


def test_near_copies_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert partenum.near_copies(empty, Scratch(spark, "t")).count() == 0
    rows = [(None, "a b c d e f"), (7, "A b c d e f"), (7, "a b c d e f"), (3, None), (None, None), (None, "q r s"), (4, "z"), (4, "y")]
    got = partenum.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()
    want = brute_components([t for _, t in rows], [i for i, _ in rows])
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(want, key=key)
    kept = partenum.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()
    assert sorted(((r.doc_id, r.text is None) for r in kept), key=key) == sorted([(7, False), (3, True), (None, True), (None, False), (4, False), (4, False)], key=key)


@pytest.mark.parametrize("group", [64, 3])
def test_all_links(spark, monkeypatch, group):
    """Every link counts, also those between texts that others connect, and copies."""
    monkeypatch.setattr(partenum, "GROUP", group)
    monkeypatch.setattr(partenum, "LINK_BLOCK", 3 if group == 3 else 1024)
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    near = [" ".join([*base[: 55 - r.randint(0, 12)], *(f"v{r.randint(0, 9)}" for _ in range(r.randint(0, 3)))]) for _ in range(25)]
    texts = near + near[:4] + corpus() + ["x y", "X y", "", None]
    sets = [shingles(t) for t in texts]
    links = [sum(i != j and bool(a) and 100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    assert sum(links[:25]) > 100
    got = partenum.near_copies(frame(spark, texts, True), Scratch(spark, "t")).collect()
    assert {x.doc_id: x.n_links for x in got} == dict(enumerate(links))


def test_keep_one(spark):
    texts = corpus()
    kept = partenum.keep_one(frame(spark, texts, True), Scratch(spark, "t"))
    assert kept.columns == ["doc_id", "text", "n", "sid"]
    want = {i for i, (_, n, c) in enumerate(brute_components(texts)) if not n or c == i}
    assert {r.doc_id for r in kept.collect()} == want


def test_signatures_meet():
    r, plan = random.Random(1), partenum.Plan()
    for _ in range(1500):
        n = r.randint(1, 300)
        base = [r.getrandbits(64) for _ in range(n + 100)]
        a = set(base[:n])
        b = set(r.sample(base[:n], n - r.randint(0, n // 6))) | set(base[n : n + r.randint(0, n // 6)])
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        if 4 * len(a & b) >= 3 * len(a | b):
            assert set(plan.signatures(x)) & set(plan.signatures(y))
        u, v = partenum.sketch(x), partenum.sketch(y)
        assert partenum.apart(pa.array([u]), pa.array([v]))[0] <= len(a ^ b)


def test_components(spark):
    r = random.Random(4)
    pairs = [(r.randrange(120), r.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 230)] + [(500, 500 + i) for i in range(1, 40)]
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t")).collect()}
    parent = {x: x for p in pairs for x in p}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_components_dense(spark, monkeypatch):
    """Dense components cost as many edges as they have nodes, not as many as they have pairs."""
    monkeypatch.setattr(importlib.import_module("actlens.llm.components"), "HELD", 50)
    r = random.Random(6)
    groups = [r.sample(range(10_000 * g - 5000, 10_000 * g + 5000), 40) for g in range(4)]
    edges = [(a, b) for g in groups for a in g for b in g] + [(x, x + 1) for x in range(90_000, 90_120)]
    want = {x: min(g) for g in groups for x in g} | dict.fromkeys(range(90_000, 90_121), 90_000)
    scratch, sizes = Scratch(spark, "t"), []
    save = scratch.save
    monkeypatch.setattr(scratch, "save", lambda df, *a, **k: (out := save(df, *a, **k), sizes.append(out.count()))[0])
    r.shuffle(edges)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long").coalesce(2), scratch).collect()}
    assert got == want and max(sizes) < 2000 < len(edges) / 3


def test_passages(spark):
    texts = corpus()
    r, v = random.Random(9), vocabulary(300, 5)
    fuzzy = [r.choice(v) for _ in range(80)]
    for k in range(4):
        x = list(fuzzy)
        x[20 + k] = "changed"
        del x[50 + k]
        texts.append(" ".join(["start", str(k), *(r.choice(v) for _ in range(30)), *x, *(r.choice(v) for _ in range(30))]))
    rows = substring.passages(frame(spark, texts, True), Scratch(spark, "t")).collect()
    covered = collections.defaultdict(set)
    for s in rows:
        mine, theirs = words(texts[s.doc_id]), words(texts[s.source_doc_id])
        assert s.source_doc_id < s.doc_id and s.n_words >= 50 and s.matched >= 0.6 * s.n_words
        assert mine[s.start_word] == theirs[s.source_start_word] and mine[s.start_word + s.n_words - 1] == theirs[s.source_start_word + s.source_words - 1]
        covered[s.doc_id] |= set(range(s.start_word, s.start_word + s.n_words))
    first = {}
    for i, t in enumerate(texts):  # every exact run of 50 words that an earlier document has is covered
        w = words(t)
        for j in range(len(w) - 49):
            if first.setdefault(tuple(w[j : j + 50]), i) != i and len(set(w[j : j + 50])) > 1:
                assert set(range(j, j + 50)) <= covered[i], i
    for i in range(len(texts) - 3, len(texts)):  # fuzzy copies of the first one
        assert len(covered[i]) >= 70
    clean = [i for i in range(60) if i % 2 and i not in range(40, 60)]
    assert not any(covered[i] for i in clean)


def test_passages_hot_seeds(spark):
    r, v = random.Random(2), vocabulary(2000, 8)
    shared = " ".join(r.choice(v) for _ in range(60))
    texts = [" ".join(r.choice(v) for _ in range(40)) + (" " + shared if i % 2 else "") for i in range(120)]
    rows = substring.passages(frame(spark, texts), Scratch(spark, "t")).collect()
    # Where the word before the passage happens to be another document's too, that one is a source as well.
    assert {s.doc_id for s in rows} == set(range(3, 120, 2)) and {s.doc_id for s in rows if s.source_doc_id == 1 and s.n_words == 60} == set(range(3, 120, 2))
    assert not uncovered(texts, rows)


def uncovered(texts, rows, spare=None):
    """(doc, word) of each exact run of 50 words that an earlier text has and no row's span holds.

    With ``spare``, those with more words than that outside all spans.
    """
    held, inside, first, out = collections.defaultdict(set), collections.defaultdict(set), {}, []
    for s in rows:
        held[s.doc_id] |= set(range(s.start_word, s.start_word + s.n_words - 49))
        inside[s.doc_id] |= set(range(s.start_word, s.start_word + s.n_words))
    for i, t in enumerate(texts):
        w = words(t)
        for j in range(len(w) - 49):
            if first.setdefault(tuple(w[j : j + 50]), i) != i and (j not in held[i] if spare is None else len(set(range(j, j + 50)) - inside[i]) > spare):
                out.append((i, j))
    return out


@pytest.mark.parametrize("others", [0, 120])
def test_passages_repeated_more_often_than_in_the_source(spark, others):
    r, v = random.Random(11), vocabulary(2000, 8)
    new = lambda n: " ".join(r.choice(v) for _ in range(n))
    p = new(55)
    texts = [new(40), f"{new(3)} {p} {new(20)}", " ".join(f"{p} {new(k % 3)}" for k in range(13)), f"{p} {new(9)} {p}"]
    texts += [f"{new(5)} {p} {new(5)} {p}" for _ in range(others)]  # with others, the seeds are hot
    rows = substring.passages(frame(spark, texts), Scratch(spark, "t")).collect()
    assert not [x for x in uncovered(texts, rows) if x[0] < 4]
    assert sum(s.doc_id == 2 and s.source_doc_id == 1 for s in rows) >= 13
    out = substring.remove_passages(frame(spark, texts), substring.passages(frame(spark, texts), Scratch(spark, "t"))).collect()
    kept = {x.doc_id: x.text for x in out}
    assert not any(p in kept.get(i, "") for i in (2, 3))


def test_passages_of_several_sources(spark):
    r, v = random.Random(12), vocabulary(2000, 8)
    new = lambda n: " ".join(r.choice(v) for _ in range(n))
    a, b = new(45), new(45)
    texts = [new(30), f"{new(7)} {a}", f"{b} {new(9)}", f"{a} {b}", f"{new(5)} {a} {b} {new(4)}"]
    for _ in range(6):  # runs whose parts are each in a smaller document
        parts = [new(20) for _ in range(5)]
        texts += [f"{new(6)} {x} {new(6)}" for x in parts] + [" ".join(parts), f"{new(3)} {' '.join(parts)} {new(3)}"]
    texts += ["x " * 130, "x " * 120 + "y", "a b " * 80, "c " + "a b " * 200]  # and one word, without exemption
    rows = substring.passages(frame(spark, texts), Scratch(spark, "t")).collect()
    assert not uncovered(texts, rows, 5)
    for s in rows:
        mine, theirs = words(texts[s.doc_id]), words(texts[s.source_doc_id])
        assert s.source_doc_id < s.doc_id and s.n_words >= 50 and mine[s.start_word] == theirs[s.source_start_word]
        assert s.matched < s.n_words or mine[s.start_word : s.start_word + s.n_words] == theirs[s.source_start_word : s.source_start_word + s.n_words]
    assert {s.source_doc_id for s in rows if s.doc_id == 4} == {3} and not any(s.doc_id == 3 for s in rows)
    texts = corpus()
    assert not uncovered(texts, substring.passages(frame(spark, texts), Scratch(spark, "t")).collect(), 0)


def test_remove_passages(spark):
    r, v = random.Random(3), vocabulary(2000, 4)
    p = " ".join(r.choice(v) for _ in range(60))
    texts = ["a b\n" + p + " c", "d  e\t" + p + "\n f g", p, None, "", "h"]
    docs = frame(spark, texts).withColumn("n_chars", F.length("text").cast("long"))
    out = substring.remove_passages(docs, substring.passages(docs, Scratch(spark, "t")))
    assert {x.doc_id: (x.text, x.n_chars) for x in out.collect()} == {0: (texts[0], len(texts[0])), 1: ("d  e\tf g", 8), 3: (None, None), 4: ("", 0), 5: ("h", 1)}
    empty = docs.limit(0)
    assert substring.remove_passages(empty, substring.passages(empty, Scratch(spark, "t"))).count() == 0


def test_chain_prefers_collinear():
    rules = substring.Rules()
    pieces = np.array([[0, 10, 100], [5, 9, 0], [12, 30, 112], [31, 40, 131], [35, 60, 5]])
    assert substring.chain(pieces, rules)[0].tolist() == [[0, 10, 100], [12, 30, 112], [31, 40, 131]]


def bag(w, k=5):
    k = min(k, len(w))
    return collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute_contamination(docs, items):
    want = {}
    for d, t in enumerate(docs):
        w = words(t)
        for i, it in enumerate(items):
            x = words(it)
            if not x or not w:
                continue
            best = (0.0, 0)
            for s in range(max(1, len(w) - len(x) + 1)):
                a, b = bag(w[s : s + len(x)]), bag(x)
                best = max(best, (sum((a & b).values()) / sum((a | b).values()), -s))
            if best[0] >= 0.75:
                want[d, i] = (-best[1], round(best[0], 9))
    return want


@pytest.mark.parametrize("part_bytes", [24 << 20, 60_000])
def test_contamination(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(decontaminate, "PART_BYTES", part_bytes)  # with the small one, there are many parts of one or two items
    r, v = random.Random(6), vocabulary(500, 9)
    items = [" ".join(r.choice(v) for _ in range(r.randint(5, 60))) for _ in range(25)] + ["too short", None, "", "x " * 30, " One ", "k l m n"]
    docs = [" ".join(r.choice(v) for _ in range(r.randint(0, 150))) for _ in range(60)]
    for i in range(40):
        w = items[r.randrange(25)].split()
        for _ in range(r.choice((0, 0, 1, 2))):
            w[r.randrange(len(w))] = "other"
        docs[i] += " " + " ".join(w).upper() + " " + docs[59 - i]
    docs += [items[3], " ".join(items[4].split()[:-2]), None, "", "x " * 40, "it is too short to tell", "ONE", "one one two", "k l m", "k l m n", " \t"]
    item_df = spark.createDataFrame(list(enumerate(items)) + [(None, items[0]), (0, items[0])], "item_id long, text string").withColumn("doc_id", F.lit(5))
    frames = frame(spark, docs, True).union(frame(spark, docs[:9], True))  # some documents twice
    got = {(x.doc_id, x.item_id): (x.start_word, round(x.similarity, 9)) for x in decontaminate.contaminated(frames, item_df, Scratch(spark, "t")).collect()}
    want = brute_contamination(docs, items)
    assert got == want and len(want) > 25
    assert decontaminate.contaminated(frame(spark, docs), item_df.limit(0), Scratch(spark, "t")).count() == 0
    assert decontaminate.contaminated(frame(spark, docs).limit(0), item_df, Scratch(spark, "t")).count() == 0


def test_contamination_by_many_items(spark):
    r, v = random.Random(7), vocabulary(3000, 9)
    items = [" ".join(r.choice(v) for _ in range(r.randint(3, 40))) for _ in range(5000)]
    docs = []
    for i in range(80):
        w = items[r.randrange(5000)].split()
        if len(w) > 36:
            w[r.randrange(len(w))] = "other"
        docs.append(" ".join([*(r.choice(v) for _ in range(20)), *w, *(r.choice(v) for _ in range(20))]))
    df = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.start_word, round(x.similarity, 9)) for x in decontaminate.contaminated(frame(spark, docs), df, Scratch(spark, "t")).collect()}
    have = [set(words(t)) for t in docs]
    some = [i for i, t in enumerate(items) if any(len(set(words(t)) & h) >= len(set(words(t))) - 4 for h in have)]
    want = {(d, some[i]): x for (d, i), x in brute_contamination(docs, [items[i] for i in some]).items()}
    assert got == want and len(want) >= 60


def test_hamming_index():
    """All within the radius meet; few others do; the radius holds nearly all similar windows."""
    r = np.random.default_rng(0)
    items = r.integers(0, 1 << decontaminate.WIDTH, (200, decontaminate.BLOCKS)).astype(np.int32)
    index = decontaminate.Index(items)
    bits = lambda k: np.isin(np.arange(decontaminate.BITS), r.choice(decontaminate.BITS, k, replace=False)).reshape(decontaminate.BLOCKS, -1) @ (1 << np.arange(decontaminate.WIDTH))
    near = np.array([items[i] ^ bits(r.integers(0, decontaminate.RADIUS + 1)) for i in range(200)], np.int32)
    assert {(i, i) for i in range(200)} <= set(map(tuple, index.near(near).tolist()))
    others = r.integers(0, 1 << decontaminate.WIDTH, (200, decontaminate.BLOCKS)).astype(np.int32)
    assert len(index.meeting(others)) < 0.1 * 200 * 200 and not len(index.near(others))
    lost = total = 0
    for _ in range(1500):  # pairs just above the threshold
        n = int(r.integers(8, 120))
        shared = int(np.ceil(n * 6 / 7))
        both = r.integers(0, 1 << 63, 2 * n - shared).astype(np.uint64)
        a, b = both[:n], both[n - shared :]
        prints = [decontaminate.window_fingerprints(x, np.zeros(1, np.int64), n) for x in (a, b)]
        lost, total = lost + int(decontaminate.distance(*prints)[0] > decontaminate.RADIUS), total + 1
    assert lost <= 0.01 * total


def test_mixing(spark):
    r = random.Random(5)
    sizes = {"a": 5, "b": 300, "C": 80, None: 40, "é": 1, "empty": 4}
    rows = []
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((len(rows), "w " * (0 if s == "empty" else r.randint(0, 30)), s, 9))
    rows += [(0, rows[0][1], "a", 9), (None, "x y", "b", 9), (900, None, "b", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int")
    got = mixing.mix_sources(df, Scratch(spark, "t")).collect()
    assert len(got) == len(rows)
    total = collections.Counter()
    for i, t, s, _ in rows:
        total[s] += len(words(t))
    order = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in full)
        share = sum(weight[s] for s in total if s not in full)
        target = {s: 3 * total[s] if s in full else left * weight[s] / share for s in total}
        over = {s for s in total if s not in full and target[s] > 3 * total[s]}
        if not over:
            break
        full |= over
    taken = collections.Counter()
    for x in got:
        assert x.source_size == total[x.source] and x.target == pytest.approx(target[x.source], rel=1e-9) and x.taken == x.copies * x.size <= 3 * x.size
        taken[x.source] += x.taken
    for s in total:
        assert abs(taken[s] - target[s]) <= 31, s
    again = mixing.mix_sources(df.repartition(7), Scratch(spark, "t")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix_sources(df.limit(0), Scratch(spark, "t")).count() == 0
    kept = mixing.mix_sources(df, Scratch(spark, "t"), keep_text=True).collect()
    assert sorted((str(x.doc_id), str(x.text)) for x in kept) == sorted((str(i), str(t)) for i, t, _, _ in rows)
    assert sorted((str(x.doc_id), str(x.source), x.size, x.copies) for x in kept) == sorted((str(x.doc_id), str(x.source), x.size, x.copies) for x in got)
    with pytest.raises(ValueError):
        mixing.mix_sources(df, Scratch(spark, "t"), cap=2.5)


def test_mixing_with_priors(spark):
    rows = [(i, "w " * (1 + i % 7), "ab"[i % 2], 0.5 + (i % 5) / 2) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
    got = mixing.mix_sources(df.select("doc_id", "text", "source", "q"), Scratch(spark, "t"), weights=(1, 1), prior=F.col("q")).collect()
    for s in "ab":
        mine = [x for x in got if x.source == s]
        assert sum(x.rate * x.size for x in mine) == pytest.approx(mine[0].target, rel=1e-6)
        assert abs(sum(x.taken for x in mine) - mine[0].target) <= 8


def labelled(n=500, seed=1):
    r, v = random.Random(seed), vocabulary(200, 2)
    rows = []
    for i in range(n):
        good = r.random() < 0.7
        w = [r.choice(v) for _ in range(r.randint(20, 80))]
        rows.append((i, " ".join(w) if good else " ".join(x.upper() + r.choice(("!!", "$$")) for x in w), int(good)))
    return rows


def test_quality(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(1000, "", "x"), (1001, None, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (77777, 0)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    out = quality.score_quality(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held"), "score").collect()
    assert len(out) == len(rows) + 2 and all(0 <= x.score <= 1 for x in out)
    truth = {i: y for i, _, y in rows}
    kept_out = [x for x in out if x.held and x.doc_id in truth]
    assert len(kept_out) > 50 and np.mean([(x.score >= 0.3) == truth[x.doc_id] for x in kept_out]) > 0.97
    assert quality.score_quality(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        quality.fit_quality(docs, labels.limit(0))


def test_language(spark):
    r = random.Random(2)
    parts = {"xx": vocabulary(80, 11), "yy": [w[::-1].replace("a", "u") for w in vocabulary(80, 12)], "zz": ["éà" + w for w in vocabulary(80, 13)]}
    rows = []
    for i in range(450):
        lang = r.choice(list(parts))
        rows.append((i, " ".join(r.choice(parts[lang]) for _ in range(r.randint(8, 60))), lang))
    rows += [(900, None, "xx"), (901, "123 $$ !", "xx"), (902, "", None), (903, "abc", None)]
    docs = spark.createDataFrame([(i, t, l, 1) for i, t, l in rows], "doc_id long, text string, lang string, score int")
    model = language.fit_language(docs.select("doc_id", "text", "lang"))
    out = {x.doc_id: x for x in language.identify(docs, model).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (900, 901, 902)) and out[903].lang_pred in parts
    fresh = [x for x in language.identify(docs, model).where(held_out(F.col("doc_id"))).collect() if x.doc_id < 450]
    assert len(fresh) > 50 and np.mean([x.lang_pred == x.lang for x in fresh]) > 0.97 and all(0 <= x.score <= 1 for x in fresh)
    assert language.identify(docs.limit(0), model).count() == 0
    sub = language.Subwords(len(model.embedding))
    for t in ("ab cd, " * 60_000, "x" * 450_000, ""):  # cut into pieces, a text has the same subwords
        (ids, _), (own, _) = sub.ids([t]), sub.ids(list(language.pieces(t)))
        assert max(map(len, language.pieces(t))) <= language.PIECE and (sorted(ids) == sorted(own) or " " not in t)
    with pytest.raises(ValueError):
        language.fit_language(docs.limit(0))
