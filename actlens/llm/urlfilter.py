"""URL filter: a sorted array of 64-bit digests, memory-mapped on every executor.

A rule is a host with a path prefix (``example.org/es/``) and a verdict. The index file holds the
rules' xxh64 digests in ascending order and, in the same order, the full rule strings. A url's
candidate rules are every suffix of its host at a dot, with every prefix of its path whose length
occurs among the rules; their digests are probed by one vectorised binary search per batch, and a
hit counts only if the stored string equals the candidate, so colliding digests never decide.

The file goes to executors through ``SparkContext.addFile``: each fetches it once from the shared
folder and maps it, so its size is bounded by an executor's disk, not by its heap, and workers of
one executor share its pages.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actlens.llm.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HEAD = "<8sQQQ"
_MAGIC = b"URLDIGS1"
ALLOW, BLOCK = "allow", "block"


def build_index(rules: Iterable[tuple[str, str]], digest=None) -> bytes:
    """The index file of (rule, verdict) pairs.

    Repeated rules count once; of two verdicts for one rule, block holds. ``digest`` replaces the
    hash in tests of collisions.
    """
    digest = digest or xxhash.xxh64_intdigest
    by_rule: dict[str, str] = {}
    for rule, verdict in rules:
        if "/" not in rule or verdict not in (ALLOW, BLOCK):
            raise ValueError(f"not a rule: {rule!r}, {verdict!r}")
        host, _, path = rule.partition("/")
        rule = host.translate(str.maketrans(UPPER, LOWER)) + "/" + path
        by_rule[rule] = BLOCK if BLOCK in (verdict, by_rule.get(rule)) else ALLOW
    rows = sorted((digest(r.encode()), r) for r in by_rule)
    texts = [r.encode() for _, r in rows]
    lengths = np.array(sorted({len(r.partition("/")[2]) + 1 for _, r in rows}), "<u8")
    ends = np.cumsum([0, *map(len, texts)], dtype="<u8")
    verdicts = np.array([by_rule[r] == BLOCK for _, r in rows], "u1")
    keys = np.array([k for k, _ in rows], "<u8")
    return b"".join([struct.pack(_HEAD, _MAGIC, len(rows), len(lengths), int(ends[-1])), keys.tobytes(), ends.tobytes(), lengths.tobytes(), verdicts.tobytes(), *texts])


class DigestArray:
    """A mapped index file."""

    def __init__(self, path: str, digest=None):
        self.digest = digest or xxhash.xxh64_intdigest
        with open(path, "rb") as f:
            magic, n, m, size = struct.unpack(_HEAD, f.read(struct.calcsize(_HEAD)))
        if magic != _MAGIC:
            raise ValueError(f"not an index: {path}")
        at = struct.calcsize(_HEAD)

        def view(dtype: str, count: int):
            nonlocal at
            out = np.memmap(path, dtype, "r", at, (count,)) if count else np.zeros(0, dtype)
            at += count * np.dtype(dtype).itemsize
            return out

        self.keys, self.ends, lengths = view("<u8", n), view("<u8", n + 1), view("<u8", m)
        self.lengths = [int(x) for x in lengths]
        self.blocks, self.text = view("u1", n), view("u1", size)

    def lookup(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str | None]]:
        """The longest fitting rule of each url and its verdict, else None twice.

        Of rules of one length, that with the longer host is taken.
        """
        owner: list[int] = []
        cands: list[bytes] = []
        seen: dict[bytes, int] = {}
        uniq: list[bytes] = []
        slot: list[int] = []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            if not host or not path:
                continue
            tails, dot = [host], host.find(".")
            while dot >= 0:
                tails.append(host[dot + 1 :])
                dot = host.find(".", dot + 1)
            heads = [path[:k] for k in self.lengths if k <= len(path)]
            for tail in tails:
                for head in heads:
                    c = (tail + head).encode("utf-8", "surrogatepass")
                    if c not in seen:
                        seen[c] = len(uniq)
                        uniq.append(c)
                    owner.append(i)
                    cands.append(c)
                    slot.append(seen[c])
        rule: list[str | None] = [None] * len(hosts)
        verdict: list[str | None] = [None] * len(hosts)
        if not uniq or not len(self.keys):
            return rule, verdict
        probe = np.fromiter((self.digest(c) for c in uniq), "<u8", len(uniq))
        low, high = np.searchsorted(self.keys, probe, "left"), np.searchsorted(self.keys, probe, "right")
        hit: dict[int, int] = {}
        for u in np.flatnonzero(high > low):
            for k in range(low[u], high[u]):  # equal digests stand side by side
                if self.text[self.ends[k] : self.ends[k + 1]].tobytes() == uniq[u]:
                    hit[int(u)] = k
        best = [-1] * len(hosts)
        for i, c, u in zip(owner, cands, slot, strict=True):
            if u in hit and len(c) > best[i]:  # candidates come with the longest host first
                best[i], rule[i] = len(c), c.decode()
                verdict[i] = BLOCK if self.blocks[hit[u]] else ALLOW
        return rule, verdict


_open: dict[str, DigestArray] = {}


def _mapped(name: str) -> DigestArray:
    path = SparkFiles.get(name)
    if path not in _open:
        _open[path] = DigestArray(path)
    return _open[path]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(df: DataFrame, rules: Iterable[tuple[str, str]], url: str = "url", default: str = ALLOW) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``df``.

    A rule fits its host and all its subdomains if the url's path starts with the rule's path; the
    longest fitting rule decides, and ``default`` where none fits. A null url, or one without
    ``://``, has an empty host and path and gets ``default``, as does an empty path. Columns of
    ``df`` with one of the four names are replaced, others stay whatever their names. Repeated rows are judged alike; of
    fitting rules of one length, that with the longer host decides. Urls of any length are read whole; an empty table
    stays empty. Only hosts and paths go to Python.
    """
    spark: SparkSession = df.sparkSession
    scratch = Scratch(spark, "urlfilter")
    name = f"urls-{scratch.root.rsplit('-', 1)[1]}.idx"
    spark.sparkContext.addFile(scratch.write_bytes(name, [build_index(rules)]))
    made = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def judge(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        index = _mapped(name)
        for hosts, paths in batches:
            rule, verdict = index.lookup(hosts.to_pylist(), paths.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(rule, pa.string()), pa.array([v or default for v in verdict], pa.string())], ["rule", "verdict"])

    new = ("host", "path", "rule", "verdict")
    own = [c for c in df.columns if c not in new]
    rows = df.select(F.struct(*own, F.lit(None).alias("none")).alias("row"), host_of(F.col(url).cast("string")).alias("host"), path_of(F.col(url).cast("string")).alias("path"))
    rows = rows.withColumn("judged", F.arrow_udf(judge, made)("host", "path"))
    return rows.select(*(F.col("row")[c].alias(c) for c in own), "host", "path", "judged.rule", "judged.verdict")
