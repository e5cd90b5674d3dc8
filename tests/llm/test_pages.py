"""URL filter, HTML extraction, WARC archives and media columns against brute force and round trips."""

import base64
import gzip
import hashlib
import io
import math
import os
import re
import struct
import time
import zipfile
import zlib
from html import unescape as html_unescape

import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from actlens.llm import htmltext, urlfilter
from actlens.llm.htmltext import extract_text, main_text
from actlens.llm.media import describe_stored, encode_text, make_sniffer, sniff_media, to_payload, wav_bytes, wav_samples
from actlens.llm.queries_urlfilter import RULES
from actlens.llm.scratch import Scratch
from actlens.llm.warc import read_archives, read_records, write_archives

URLS = [
    "http://A.Example.ORG/es/x?y", "https://example.org/en/12#z", "https://example.org/en/2", "http://x.com/fr/a", "http://com/de/", "http://xcom/de/", "http://org", "http://org?x/", "no-scheme/de/", None, "",
    "x://y://Z.com/de/q", "http://ÄB.org/", "http://example.org/es", "http://notexample.org/es/", "http://a.com:80/fr/", "http://a.com/de/\nb", "http://.org/",
]


def brute_filter(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
        rest = rest[n:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = []
    for rule, verdict in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_filter_equals_brute_force(spark):
    rows = [(i, u, "old", "kept", i) for i, u in enumerate(URLS + URLS + ["http://a.org/" + "es/" * 200_000])]
    got = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id int, url string, rule string, _h string, row int"), RULES).collect()
    assert len(got) == len(rows) and all(r["_h"] == "kept" and r["row"] == r.page_id for r in got)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute_filter(r.url), r.url
    assert urlfilter.filter_urls(spark.createDataFrame([], "url string"), RULES).count() == 0
    assert {r.verdict for r in urlfilter.filter_urls(spark.createDataFrame([("http://a.com/",)], "url string"), [], default="block").collect()} == {"block"}


def test_collisions_are_confirmed(tmp_path):
    (tmp_path / "i").write_bytes(urlfilter.build_index(RULES, digest=lambda b: len(b) % 3))
    array = urlfilter.DigestArray(str(tmp_path / "i"), digest=lambda b: len(b) % 3)
    want = [brute_filter(u) for u in URLS if u]
    rule, verdict = array.lookup([w[0] for w in want], [w[1] for w in want])
    assert rule == [w[2] for w in want] and [v or "allow" for v in verdict] == [w[3] for w in want]


def test_rules_are_checked():
    with pytest.raises(ValueError):
        urlfilter.build_index([("nohost", "allow")])
    with pytest.raises(ValueError):
        urlfilter.build_index([("a/", "maybe")])


LONG = "The quick brown fox jumps over the lazy dog while the band plays on. "
PAGES = [
    ("", ""),
    ("just text", "just text"),
    ("<p>a &lt; b&nbsp;&#65;\n  c</p>", "a < b A c"),
    ("<body><nav><a href=x>menu</a></nav><article><h1>T</h1><p>" + LONG + "<p>short<br>er</article><footer>f</footer>", "T\n" + LONG.strip() + "\nshort er"),
    ("<div class='ad banner'>" + LONG + "</div><div><p>" + LONG + "</p><p>x</p></div><script>var a='<p>no</p>'</script><form>f</form>", LONG.strip() + "\nx"),
    ("<main><p>" + LONG + "</p><section id=comments><p>" + LONG * 3 + "</p></section></main>", LONG.strip()),
    ("<!-- <p>x</p> --><p>y", "y"),
    ("<div hidden><p>" + LONG + "</p></div>", ""),
]


def test_main_text(spark):
    for page, text in PAGES:
        assert main_text(page) == text, page
    rows = [(i, h, "old") for i, (h, _) in enumerate(PAGES)] + [(99, None, "old"), (0, "", "old")]
    got = extract_text(spark.createDataFrame(rows, "page_id int, html string, text string")).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == sorted([(i, t, len(t)) for i, (_, t) in enumerate(PAGES)] + [(99, "", 0), (0, "", 0)])


def test_flat_pages():
    parts = ["h" * 30, *("p" * 99 + str(i) for i in range(10)), "q" * 1000]
    blocks = "<h1>" + parts[0] + "</h1>" + "".join(f"<p>{x}</p>" for x in parts[1:])
    links = "<ul>" + "".join(f"<li><a href=x>link {i}</a></li>" for i in range(9)) + "</ul>"
    for page in (f"<body>{blocks}</body>", f"<html><head><title>t</title></head><body>{links}{blocks}<footer>f</footer></body></html>", blocks):
        assert main_text(page) == "\n".join(parts), page


P = "".join(f"<p>{LONG * k}</p>" for k in (2, 3, 1, 4))
PT = "\n".join((LONG * k).strip() for k in (2, 3, 1, 4))
LAYOUTS = [
    (f'<body><nav><a href=x>a</a></nav><div class="content has-sidebar"><h1>T</h1>{P}</div><div class=sidebar><p>{LONG}</p></div></body>', "T\n" + PT),
    (f'<body><div class="with-nav"><h1>T</h1>{P}</div><footer>x y</footer>', "T\n" + PT),
    (f'<body><div class="search-results-page">{P}</div>', PT),
    (f"<body><form action=x><div id=page><h1>T</h1>{P}<input name=q><button>Go</button></div></form>", "T\n" + PT),
    (f'<body><article><h1>T</h1>{P}<blockquote class="alert notice">{LONG}</blockquote></article>', "T\n" + PT + "\n" + LONG.strip()),
    (f"<body><article><h1>T</h1>{P}<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></article>", "T\n" + PT + "\nso x=1 holds"),
    (f"<body><article><h1><a href=x>Title of it</a></h1>{P}<ul><li><a href=1>ref one</a></li><li><a href=2>ref two</a></li></ul></article><footer>f</footer>", "Title of it\n" + PT + "\nref one\nref two"),
    (f"<body><div class=wrap><div class=menu><a href=1>x</a><a href=2>y</a></div><div class=c><h1>T</h1><section>{P}</section><section>{P}</section></div></div><footer>foo bar</footer>", "T\n" + PT + "\n" + PT),
    (f"<body><header><a href=/>Site</a></header><div class=page><h1>T</h1><div class=text>{P}</div><div class=share><a href=a>Tw</a></div></div>", "T\n" + PT),
    (f'<body><article class="post has-comments"><h1>T</h1>{P}<div class="comment-list"><div class=comment><p>{LONG * 9}</p></div></div></article>', "T\n" + PT),
    (f"<body><div class=cookie-notice><p>{LONG}</p></div><article><h1>T</h1>{P}</article>", "T\n" + PT),
    (f"<body><main><article><h2>A</h2>{P}</article><article><h2>B</h2>{P}</article></main><aside><p>{LONG}</p></aside>", "A\n" + PT + "\nB\n" + PT),
    (f"<body><article><h1>T</h1><p>short</p></article><footer>{LONG * 3}</footer>", "T\nshort"),
]


@pytest.mark.parametrize("page,text", LAYOUTS)
def test_layouts(page, text):
    assert main_text(page) == text


def brute_density(node, body):
    """Characters, tags and density of a node by walking its whole subtree."""
    chars = tags = link_chars = link_tags = 0
    todo = [(node, node.name == "a")]
    while todo:
        x, linked = todo.pop()
        for y in x.items:
            if isinstance(y, str):
                chars += len("".join(y.split()))
                link_chars += len("".join(y.split())) * linked
            elif not y.drop:
                tags, link_tags = tags + 1, link_tags + (y.name == "a")
                todo.append((y, linked or y.name == "a"))
    if node is body:
        return chars, link_chars
    total, in_links = brute_density(body, body)
    if not chars:
        return 0.0
    rest, t, lt = max(1, chars - link_chars), max(1, tags), max(1, link_tags)
    base = math.log(chars / rest * link_chars + in_links / max(1, total) * chars + math.e)
    return chars / t * math.log(max(chars / max(1, link_chars) * t / lt, 1.0000001)) / base


def test_density_equals_brute_force():
    for page, _ in LAYOUTS:
        nodes = htmltext.measure(htmltext.parse(page), hints=False)
        body = htmltext.body_of(nodes)
        for x in nodes:
            if x is not body:
                assert x.density == pytest.approx(brute_density(x, body)), page
            assert x.total == pytest.approx(sum(y.density for y in x.items if not isinstance(y, str) and not y.drop and y.block))
            below = [y for y in nodes if y is x or any(z is x for z in above(y))]
            assert x.top.total == max(y.total for y in below)


def above(x):
    while x.parent is not None:
        x = x.parent
        yield x


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_text_with_and_without_names():
    """On pages whose text is their ``article``: exact with the names of elements and classes, nearly so by densities alone."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column("html").to_pylist()
    exact = dense = 0
    for page in pages:
        inner = re.search("<article>(.*)</article>", page, re.S)[1]
        parts = (" ".join(html_unescape(re.sub("<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", inner))
        want = "\n".join(x for x in parts if x)
        exact, dense = exact + (main_text(page) == want), dense + (main_text(page, hints=False) == want)
    assert exact == len(pages) and dense >= 0.95 * len(pages)


def test_time_is_linear():
    took = []
    for n in (2000, 16000):
        began = time.perf_counter()
        for page in ("<div>" * n + "</b>" * n, "<b><article>" + "<div>" * n + "</b>" * n, "<p>" * n + "</q>" * n):
            main_text(page)
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0] + 1


@pytest.mark.parametrize("page", ["<div>" * 20000 + "deep", "<p>" * 5000 + "x", "<a <b <c \"", "<", "</", "&", "<table><tr><td>a<td>b", "<!--", "<script>", "\x00<p>\x00"])
def test_broken_pages(page):
    assert isinstance(main_text(page), str)


def test_warc_round_trip(spark):
    html = ["<p>one</p>" + LONG, "<p>two</p>", "<p>one</p>" + LONG, None, "", "é" * 5000, "<p>one</p>" + LONG]
    rows = [(i * 2, f"http://h/{i}\r\nX: y", h, 1) for i, h in enumerate(html)] + [(None, None, "<p>two</p>", 1), (2, "http://again", "<p>two</p>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    index = write_archives(pages, Scratch(spark, "t"), archive_bytes=2000)
    got = read_archives(index)
    assert got.count() == len(rows)
    first = {}
    for i, _, h, _ in rows:
        h = h or ""
        first[h] = min([x for x in (first.get(h), i) if x is not None], default=None)
    for r in got.collect():
        match = [x for x in rows if x[0] == r.page_id and hashlib.sha1((x[2] or "").encode()).digest() == base64.b32decode(r.payload_digest)]
        assert match
        h = (match[0][2] or "").encode()
        assert r.payload_bytes == len(h)
        if r.page_id == first[h.decode()]:
            assert r.record_type == "response" and r.refers_to is None and r.payload == h
        else:
            assert r.record_type == "revisit" and r.refers_to == first[h.decode()] and r.payload is None
    all_kept = read_archives(write_archives(pages, Scratch(spark, "t"), min_revisit_bytes=10**6))
    assert {r.record_type for r in all_kept.collect()} == {"response"}
    none = write_archives(pages.limit(0), Scratch(spark, "t"))
    assert none.count() == 0 and read_archives(none).count() == 0


def test_warc_layout(spark):
    rows = [(i, f"http://h/{i}", f"<p>page number {i} {LONG * (i % 5)}</p>") for i in range(60)]
    index = write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), Scratch(spark, "t")).orderBy("archive", "at").collect()
    path = index[0].archive.removeprefix("file:")
    raw = open(path[path.index("/tmp") :] if "/tmp" in path else path, "rb").read()
    magic, n = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D and n > 0
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + n]))
    mine = [r for r in index if r.archive == index[0].archive]
    for r in mine:  # each record alone
        assert unpack.decompress(raw[r["at"] : r["at"] + r.n_bytes]).startswith(b"WARC/1.1\r\nWARC-Type: response")
    assert len(list(read_records(io.BytesIO(raw), chunk=100))) == len(mine)
    with pytest.raises(ValueError):
        list(read_records(io.BytesIO(raw[:-3])))


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def zipped():
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("a", "b")
    return f.getvalue()


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff!\xf9\x04\x00\x00\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02\x12\xff\x00\x34\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF"
BMP = b"BM" + struct.pack("<IIIIiiHHIIIIII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
MP4 = struct.pack(">I4s8s", 16, b"ftyp", b"isom\0\0\0\0") + struct.pack(">I4s4s", 12, b"mdat", b"data")
OGG = b"OggS\0\x06" + b"\0" * 8 + b"\1\2\3\4" + b"\0" * 8 + b"\1\3abc"
FLAC = b"fLaC\x80\x00\x00\x22" + b"\0" * 34
WEBP = b"RIFF" + struct.pack("<I4s4sI", 16, b"WEBP", b"VP8 ", 4) + b"abcd"
FORMATS = {"image/png": png(), "application/zip": zipped(), "application/gzip": gzip.compress(b"hello"), "image/gif": GIF, "image/jpeg": JPEG, "application/pdf": PDF, "image/bmp": BMP, "video/mp4": MP4, "audio/ogg": OGG, "audio/flac": FLAC, "image/webp": WEBP, "audio/wav": wav_bytes(b"ab" * 32)}


@pytest.mark.parametrize("kind", sorted(FORMATS))
def test_formats(kind):
    sniff, b = make_sniffer(), FORMATS[kind]
    assert sniff(b) == [(0, len(b), kind)]
    assert sniff(b"some text " + b + b" more")[0][0] == 10 and sniff(b"some text " + b + b" more")[0][2] == kind
    assert sniff(b[: len(b) // 2]) == [] or kind in ("application/pdf",)


def test_sniff_corrects_and_carves(spark):
    rows = [(1, png(), "image/jpeg"), (2, b"--" + GIF + b"--" + JPEG, None), (3, b"RIFF and BM and PK", "text/plain"), (4, None, "x/y"), (5, b"", None)]
    got = {r.id: r.sniffed for r in sniff_media(spark.createDataFrame(rows, "id int, media binary, declared_type string")).collect()}
    assert got[1].media_type == "image/png" and got[1].corrected and got[1].valid_bytes == len(png())
    assert [(e["at"], e["media_type"]) for e in got[2].embedded] == [(2, "image/gif"), (4 + len(GIF), "image/jpeg")] and bytes(got[2].embedded[0]["content"]) == GIF
    assert (got[3].media_type, got[3].corrected, got[3].valid_bytes) == ("text/plain", False, 0)
    assert got[4].media_type == "x/y" and got[5].media_type == "application/octet-stream"


def test_media_columns(spark):
    texts = ["abc", "", None, "é" * 40, "RIFF" * 100, "x" * 64, "abc"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id int, text string, media int")
    got = {r.doc_id: r for r in describe_stored(sniff_media(encode_text(df))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert to_payload(raw) == payload and wav_samples(wav_bytes(payload)) == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(payload) + 44 and r.media_sha256 == hashlib.sha256(wav_bytes(payload)).hexdigest() and r.feature.startswith("audio/wav;bits=8;channels=1;")
    assert got[0].feature == got[6].feature
    odd = spark.createDataFrame([(1, None), (2, b"plain"), (3, png())], "doc_id int, media binary").withColumn("declared_type", F.lit("audio/wav"))
    assert all(r.payload_sha256 is None and r.feature is None for r in describe_stored(sniff_media(odd)).collect())
    assert describe_stored(sniff_media(encode_text(df.where(F.lit(False))))).count() == 0
