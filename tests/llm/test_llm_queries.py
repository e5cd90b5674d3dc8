"""The registered queries: those with SQL against DuckDB, the others against brute force, on the small tables."""

import os
import re
import zlib
from collections import defaultdict

import duckdb
import pandas as pd
import pytest

from actlens.llm import registry

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


@pytest.fixture(scope="module")
def tables():
    return {t: pd.read_parquet(f"{SF}/{t}.parquet") for t in TABLES}


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(map(str, cursor.fetchall()))
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == want


def test_op2(spark, tables):
    docs = tables["documents"]
    got = registry.queries()["op2_mixing"](spark, SF).toPandas()
    size = {r.doc_id: len(words(r.text)) for r in docs.itertuples()}
    source = {r.doc_id: r.source for r in docs.itertuples()}
    total = defaultdict(int)
    for i, n in size.items():
        total[source[i]] += n
    order = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full = set()
    while True:
        left, share = sum(total.values()) - sum(3 * total[s] for s in full), sum(weight[s] for s in total if s not in full)
        target = {s: 3.0 * total[s] if s in full else left * weight[s] / share for s in total}
        over = {s for s in total if s not in full and target[s] > 3 * total[s]}
        if not over:
            break
        full |= over
    taken = defaultdict(int)
    for r in got.itertuples():
        assert (r.size, r.source_size) == (size[r.doc_id], total[source[r.doc_id]]) and r.taken <= 3 * r.size
        assert r.target == pytest.approx(target[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    most = max(size.values())
    assert len(got) == len(docs) and all(abs(taken[s] - target[s]) <= most for s in total)


def test_op3(spark, tables):
    got = registry.queries()["op3_quality"](spark, SF).toPandas().set_index("doc_id")
    assert len(got) == len(tables["documents"]) and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.3)).all() and all(r.held_out == held(i) for i, r in got.iterrows())
    truth = tables["labels"].dropna(subset=["quality"]).set_index("doc_id").quality
    mine = got[got.held_out & got.index.isin(truth.index)]
    assert len(mine) > 5 and (mine.predicted == truth[mine.index]).mean() >= 0.9


def test_op4(spark, tables):
    got = registry.queries()["op4_html_text"](spark, SF).toPandas().set_index("page_id")
    assert len(got) == len(tables["pages"]) and (got.n_chars == got.text.str.len()).all()
    for r in tables["pages"].itertuples():
        inner = " ".join(re.sub("<[^>]+>", " ", re.search("<article>(.*)</article>", r.html, re.S)[1]).split())
        assert re.sub(r"&\w+;|\W", "", inner) == re.sub(r"\W", "", got.text[r.page_id])


def test_op5(spark, tables):
    docs = tables["documents"].set_index("doc_id")
    got = registry.queries()["op5_language_id"](spark, SF).toPandas().set_index("doc_id")
    assert len(got) == len(docs) and got.score.between(0, 1).all() and all(r.held_out == held(i) for i, r in got.iterrows())
    empty = [i for i, t in docs.text.items() if not any(c.isalpha() for c in t or "")]
    assert set(got.lang_pred) <= {*docs.lang.dropna(), "und"} and (got.lang_pred[empty] == "und").all()
    mine = got[got.held_out & docs.lang[got.index].notna()]
    assert (mine.lang_pred == docs.lang[mine.index]).mean() >= 0.95


def bag(w):
    k, out = min(5, len(w)), defaultdict(int)
    for i in range(len(w) - k + 1):
        out[tuple(w[i : i + k])] += 1
    return out


def test_op6(spark, tables):
    got = {(r.doc_id, r.item_id): (r.start_word, round(r.similarity, 9)) for r in registry.queries()["op6_decontamination"](spark, SF).collect()}
    want, index = {}, defaultdict(set)
    items = {r.item_id: words(r.text) for r in tables["benchmark"].itertuples()}
    for i, x in items.items():
        for s in bag(x):
            index[s].add(i)
    for r in tables["documents"].itertuples():
        w = words(r.text)
        for i in {i for s in bag(w) for i in index.get(s, ())}:
            x, b = items[i], bag(items[i])
            best = (0.0, 0)
            for at in range(max(1, len(w) - len(x) + 1)):
                a = bag(w[at : at + len(x)])
                shared = sum(min(n, b.get(s, 0)) for s, n in a.items())
                best = max(best, (shared / (sum(a.values()) + sum(b.values()) - shared), -at))
            if best[0] >= 0.75:
                want[r.doc_id, i] = (-best[1], round(best[0], 9))
    assert got == want and want


def test_op9(spark, tables):
    texts = {r.doc_id: words(r.text) for r in tables["documents"].itertuples()}
    inside, first = defaultdict(set), {}
    for r in registry.queries()["op9_substring_dedup"](spark, SF).collect():
        mine, theirs = texts[r.doc_id], texts[r.source_doc_id]
        assert r.source_doc_id < r.doc_id and r.n_words >= 50 and mine[r.start_word] == theirs[r.source_start_word]
        inside[r.doc_id] |= set(range(r.start_word, r.start_word + r.n_words))
    for i in sorted(texts):
        w = texts[i]
        for j in range(len(w) - 49):
            if first.setdefault(tuple(w[j : j + 50]), i) != i:
                assert inside[i] >= set(range(j, j + 50)), (i, j)
