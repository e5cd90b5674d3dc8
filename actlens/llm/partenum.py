"""N-gram Jaccard join by PartEnum signatures.

Every text becomes the set of its distinct word shingles. Two sets a, b with Jaccard similarity of
at least p/q differ in at most r(q-p)/(q+p) elements, r = \\|a\\| + \\|b\\|. The shingle domain is dealt by
digest into n partitions, n being fixed for a band of r: of two similar sets, at least n - k of the
projections onto partitions are equal, k being the largest difference that the band allows.
Enumerating the projections of every set as signatures would find each such pair many times over,
so all sets rank their signatures by one global order (largest projection first, then digest): a set
may leave out its lowest n - k - 1 ones, as the highest-ranking signature that two similar sets share
is then still among both. Every set thus has k + 1 signatures for each band that its partners' sizes
fall into (one or two), and a few more (``spare``), by which it may also do without that many
signatures that prove frequent.

Signatures are shuffled as (signature, set) only and met in sorted order by a streaming pass that
holds ``GROUP`` rows at most. Pairs aren't expanded: a first round verifies each member of a group
against the group's smallest; connected components of the verified links follow; a second round
verifies, within groups of up to ``GROUP`` sets, the pairs that still lie in different components,
which is all that can change the components. Sets with more than ``spare`` frequent signatures are
compared too, one block against another, if they lie in different components: sets that frequent
groups connect form one pool, so that a pair meets once however many signatures it shares. Before two sets are fetched for the exact count, an upper bound on their similarity from
their sizes and parity sketches must reach the threshold: bits in which two sketches differ stand
for at least as many differing elements.

These links connect the components but aren't all links. As every link lies within a component, a last
pass counts those of each component: its sets meet once more, one block against another, and the exact
number of shingles that each two have in common decides. Only numbers of links leave a cell of two blocks.

Sets are named by 64-bit digests of their shingles; equal sets are one node from the start, so a
group of exact copies of any size is one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actlens.llm.bloom import bloom_bytes, maybe
from actlens.llm.components import components
from actlens.llm.scratch import Scratch, redealt
from actlens.llm.words import U64, Hasher, mix, text_parts

#: Largest group of sets whose pairs are looked at directly, and rows that the streaming pass holds.
GROUP = 64
BLOCK = 512
#: Most sets and about as many shingles of a block of a component whose links are counted.
LINK_BLOCK, LINK_SHINGLES = 1024, 1 << 18
#: Bits of a sketch: the power of two at or above the set's size, within these.
SKETCH_BITS = (1024, 1 << 17)
LEVEL_BITS = 5


@dataclass(frozen=True)
class Plan:
    """The bands and partitions for a similarity of p/q."""

    p: int = 3
    q: int = 4
    first: int = 6
    stretch: float = 1.25

    def bound(self, level: int) -> int:
        """The largest r of a band."""
        return self.first << level

    def level(self, r: int) -> int:
        return max(0, (-(-r // self.first) - 1).bit_length())

    def partitions(self, level: int) -> int:
        return int(self.stretch * self.bound(level) * (self.q - self.p) / (self.q + self.p)) + 16

    def spare(self, level: int) -> int:
        return 2 + self.bound(level) * (self.q - self.p) // (self.q + self.p) // 16

    def bands(self, n: int) -> list[tuple[int, int]]:
        """(level, k + 1) for each band of a set of ``n`` elements."""
        low, high = n + -(-n * self.p // self.q), n + n * self.q // self.p
        out = []
        for level in range(self.level(low), self.level(high) + 1):
            k = min(high, self.bound(level)) * (self.q - self.p) // (self.q + self.p)
            out.append((level, k + 1))
        return out

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """The signatures of a sorted set; the level is in the lowest bits."""
        out = []
        sums = np.zeros(len(s) + 1, np.uint64)
        np.cumsum(mix(s ^ U64(0xA0761D6478BD642F)), out=sums[1:])
        for level, keep in self.bands(len(s)):
            n = self.partitions(level)
            part = ((s >> U64(32)) * U64(n)) >> U64(32)  # ascends with s
            ends = np.searchsorted(part, np.arange(n + 1).astype(np.uint64))
            size = np.diff(ends).astype(np.uint64)
            where = np.arange(n).astype(np.uint64) + U64(level << 40)
            digest = mix(mix(sums[ends[1:]] - sums[ends[:-1]] + size) + mix(where))
            rank = (np.minimum(size, U64(63)) << U64(58)) | (digest >> U64(6))
            keep = min(n, keep + self.spare(level))
            if keep < n:
                digest = digest[np.argpartition(rank, n - keep)[n - keep :]]
            out.append((digest & ~U64((1 << LEVEL_BITS) - 1)) | U64(level))
        return np.concatenate(out)


def set_name(s: np.ndarray) -> int:
    """The 64-bit digest of a set, as a long."""
    return int(np.int64(np.uint64(mix(s).sum(dtype=np.uint64)) ^ mix(np.array([len(s)], np.uint64))[0])) if len(s) else 0


def sketch(s: np.ndarray) -> bytes:
    """The parity of the number of elements in each of some buckets, of which there are about as many as elements."""
    bits = min(max(SKETCH_BITS[0], 1 << max(0, len(s) - 1).bit_length()), SKETCH_BITS[1])
    return np.packbits((np.bincount((mix(s) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(x, n_bytes: int) -> np.ndarray:
    """The sketch of ``n_bytes`` that the same set has, as 64-bit numbers; ``x`` is at least as long."""
    x = np.frombuffer(x, np.uint64)
    return x if 8 * len(x) == n_bytes else np.bitwise_xor.reduce(x.reshape(-1, n_bytes // 8), axis=0)


def shingle_meta(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, sid, sketch) of every row; an empty set has n = 0 and null for the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            for at, data, offsets in text_parts(b.column("text")):
                sets = list(hasher.shingle_sets(hasher.words(data, offsets), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_name(s) if len(s) else None for s in sets], pa.int64()), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n", "sid", "sketch"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, sid long, sketch binary")


def signature_rows(docs: DataFrame, plan: Plan, k: int) -> DataFrame:
    """(sig, sid) of the distinct sets of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = Hasher(), set()
        for b in batches:
            for _, data, offsets in text_parts(b.column("text")):
                sigs, names = [], []
                for s in hasher.shingle_sets(hasher.words(data, offsets), k):
                    if not len(s) or (name := set_name(s)) in seen:
                        continue
                    seen.add(name)
                    sigs.append(plan.signatures(s))
                    names.append(np.full(len(sigs[-1]), name, np.int64))
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(names))], names=["sig", "sid"])

    return docs.select("text").mapInArrow(run, "sig long, sid long")


def hot_signatures(docs: DataFrame, plan: Plan, k: int, share: float = 0.002, sample: int = 20_000) -> np.ndarray:
    """Sorted signatures that more than ``share`` of the distinct sets of a sample of rows have.

    The sample only decides over how many tasks a signature's rows are dealt, not on what is found. What reaches
    the driver is at most ``1 / share`` times the signatures of a mean set.
    """
    n = docs.count()
    mod = max(1, n // sample)
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("hot")), F.lit(mod)) == 0)
    counts = signature_rows(some, plan, k).groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") > max(GROUP, int(share * n / mod)))
    return np.sort(counts.select("sig").toArrow().column("sig").to_numpy())


def _runs(batches: Iterator[pa.RecordBatch], keep: int):
    """Runs of equal ``sig`` in a sorted stream of distinct (sig, sid, ...) rows.

    Yields (columns, start of each run, whether the run is frequent). Runs of more than ``keep`` rows
    are frequent; they come in pieces, and each piece but the first begins with the run's first row.
    """
    carry: list[np.ndarray] | None = None
    head: list[np.ndarray] | None = None  # the first row of an open frequent run
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if carry is not None:
            cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
            carry = None
        if not len(cols[0]):
            continue
        same = np.zeros(len(cols[0]), bool)
        same[1:] = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1])
        if same.any():
            cols = [c[~same] for c in cols]
        if head is not None:
            n = int(np.searchsorted(cols[0] != head[0][0], True))
            piece = [np.concatenate((h, c[:n])) for h, c in zip(head, cols, strict=True)]
            if n and len(piece[1]) > 1 and piece[1][1] == piece[1][0]:
                piece = [np.concatenate((p[:1], p[2:])) for p in piece]
            if len(piece[0]) > 1:
                yield piece, np.zeros(1, np.int64), np.ones(1, bool)
            cols = [c[n:] for c in cols]
            if not len(cols[0]):
                continue
            head = None
        start = np.flatnonzero(np.concatenate(([True], cols[0][1:] != cols[0][:-1])))
        if len(cols[0]) - start[-1] > keep:
            head = [c[start[-1] : start[-1] + 1] for c in cols]
            done = len(cols[0])
        else:
            carry = [c[start[-1] :] for c in cols]
            done, start = int(start[-1]), start[:-1]
        if done:
            size = np.diff(np.append(start, done))
            yield [c[:done] for c in cols], start, size > keep
    if carry is not None and len(carry[0]):
        yield carry, np.zeros(1, np.int64), np.array([len(carry[0]) > keep])


def star_rows(sigs: DataFrame, salted: np.ndarray) -> DataFrame:
    """From sorted signatures: pairs (a, b) with each group's smallest set, and the members of groups of three or more.

    Rows have a null ``b`` if they are members: (sig, a, frequent). Groups of the ``salted`` signatures are met in parts,
    each with a smallest set of its own, and are frequent, whatever a part's size.
    """
    shared = sigs.sparkSession.sparkContext.broadcast(salted)  # bounded in hot_signatures

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (sig, sid), start, hot in _runs(batches, GROUP):
            hot = hot | np.isin(sig[start], shared.value)
            size = np.diff(np.append(start, len(sig)))
            center, rest = np.repeat(sid[start], size), np.ones(len(sig), bool)
            rest[start] = False
            pairs = np.unique(np.stack((center[rest], sid[rest]), axis=1), axis=0)
            member = np.repeat((size > 2) | hot, size)
            n, m = len(pairs), int(member.sum())
            if n + m:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(sig[member])]),
                        pa.array(np.concatenate((pairs[:, 0], sid[member]))),
                        pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(m, pa.int64())]),
                        pa.concat_arrays([pa.nulls(n, pa.bool_()), pa.array(np.repeat(hot, size)[member])]),
                    ],
                    names=["sig", "a", "b", "frequent"],
                )

    return sigs.mapInArrow(run, "sig long, a long, b long, frequent boolean")


def cross_pairs(members: DataFrame) -> DataFrame:
    """Pairs of different roots within the groups of sorted (sig, sid, root) rows of up to ``GROUP`` sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, sid, root), start, hot in _runs(batches, GROUP):
            ends = np.append(start[1:], len(sid))
            mixed = np.flatnonzero((np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)) & ~hot)
            found = []
            for g in mixed:
                s, r = sid[start[g] : ends[g]], root[start[g] : ends[g]]
                i, j = np.nonzero(np.triu(r[:, None] != r[None, :]))
                found.append(np.stack((s[i], s[j]), axis=1))
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    return members.mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """(sid, shingles) of the sets named in the one column of ``names`` (and of a few others)."""
    bitmap = bloom_bytes(names)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # 4 MB at every size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, bits = Hasher(), set(), np.frombuffer(shared.value, np.uint8)
        for b in batches:
            for _, data, offsets in text_parts(b.column("text")):
                sets = [s for s in hasher.shingle_sets(hasher.words(data, offsets), k) if len(s)]
                sids = np.array([set_name(s) for s in sets], np.int64)
                rows = [i for i in np.flatnonzero(maybe(sids, bits)) if sids[i] not in seen]
                rows = list({sids[i]: i for i in rows}.values())
                seen.update(sids[rows])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(sids[rows]), pa.array([sets[i].tobytes() for i in rows], pa.binary())], names=["sid", "shingles"])

    found = docs.select("text").mapInArrow(run, "sid long, shingles binary")
    return found.groupBy("sid").agg(F.first("shingles").alias("shingles"))


def apart(x: pa.Array, y: pa.Array) -> np.ndarray:
    """In how many bits each sketch differs from its counterpart, in the size of the smaller one."""
    out = np.zeros(len(x), np.int64)
    for i, (a, b) in enumerate(zip(x, y, strict=True)):
        a, b = a.as_buffer(), b.as_buffer()
        n = min(a.size, b.size)
        out[i] = np.bitwise_count(folded(a, n) ^ folded(b, n)).sum()
    return out


def possible(pairs: DataFrame, nodes: DataFrame, plan: Plan) -> DataFrame:
    """Those pairs (a, b) whose sizes and sketches allow the similarity."""
    p, q = plan.p, plan.q
    sides = [nodes.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in ("a", "b")]
    near = pairs.join(sides[0], "a").join(sides[1], "b").where(F.least("n_a", "n_b") * q >= F.greatest("n_a", "n_b") * p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = b.column("n_a").to_numpy() + b.column("n_b").to_numpy()
            ok = pa.array(apart(b.column("s_a"), b.column("s_b")) * (q + p) <= total * (q - p)) if len(total) else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(c).filter(ok) for c in ("a", "b")], names=["a", "b"])

    return near.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """Those pairs (a, b) whose sets have the similarity."""
    left, right = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("sid").alias("b"), F.col("shingles").alias("y"))
    n = F.least(F.octet_length("x"), F.octet_length("y")), F.greatest(F.octet_length("x"), F.octet_length("y"))
    both = pairs.join(left, "a").join(right, "b").where(n[0] * plan.q >= n[1] * plan.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                ok.append(plan.q * common >= plan.p * (len(x) + len(y) - common))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b")], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def shared_shingles(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """How many shingles each set of ``left`` has in common with each one of ``right``, or of ``left`` itself."""
    sets = left + (right or [])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]
    start = np.flatnonzero(np.concatenate(([True], values[order][1:] != values[order][:-1])))
    size = np.diff(np.append(start, len(values)))
    kept = np.repeat(size > 1, size)  # a shingle of one set alone adds nothing
    owner, column = owner[kept], np.repeat(np.arange(int((size > 1).sum())), size[size > 1])
    common = np.zeros((len(left), len(right or left)), np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, BLOCK):
        lo, hi = np.searchsorted(column, (at, at + BLOCK))
        has = np.zeros((len(sets), BLOCK), np.float32)
        has[owner[lo:hi], column[lo:hi] - at] = 1
        common += (has[: len(left)] @ has[len(left) if right else 0 :].T).astype(np.int64)
    return common


def link_counts(roots: DataFrame, sets: DataFrame, nodes: DataFrame, plan: Plan) -> DataFrame:
    """(sid, n_links): for the sets of each component, how many rows have a similar other set.

    ``roots`` has (node, root), ``sets`` (sid, shingles) of the nodes at least. Work grows as the square of a component, rows
    only as its power of 3/2: there are about half as many blocks as the root of its number of sets.
    """
    rows = roots.select(F.col("node").alias("sid"), F.col("root").alias("pool")).join(nodes.select("sid", "n", "copies"), "sid")
    groups = rows.groupBy("pool").agg(F.count("*").alias("n_group"), F.sum("n").alias("n_shingles"))
    least = F.when(F.col("n_group") <= GROUP, F.lit(1.0)).otherwise(F.sqrt("n_group") / 2)
    blocks = F.ceil(F.greatest(least, F.col("n_group") / LINK_BLOCK, F.least(F.col("n_group"), F.col("n_shingles") / LINK_SHINGLES))).cast("int")
    rows = rows.drop("n").join(redealt(groups.select("pool", blocks.alias("blocks")), "pool", "own_pool"), F.col("pool") == F.col("own_pool"))
    # Block i meets block j >= i in the cell (pool, i, j).
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("sid"), "blocks").cast("int")).join(sets, "sid")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("pool", "sid", "copies", "shingles", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine")
    p, q = plan.p, plan.q

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for table in cells(batches):
            sid, copies, mine = (table.column(c).to_numpy() for c in ("sid", "copies", "mine"))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
            i, j = int(table.column("i")[0].as_py()), int(table.column("j")[0].as_py())
            left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
            if not len(left) or not len(right):
                continue
            size = np.array([len(s) for s in sets])
            common = shared_shingles([sets[x] for x in left], [sets[x] for x in right] if i != j else None)
            links = (q * common >= p * (size[left][:, None] + size[right][None, :] - common)) & (left[:, None] != right)
            found = np.zeros(len(sid), np.int64)
            found[left] += links @ copies[right]
            if i != j:
                found[right] += copies[left] @ links
            held.append((sid[found > 0], found[found > 0]))
            n_held += len(held[-1][0])
            if n_held >= 1 << 13:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=["sid", "n_links"])
                held, n_held = [], 0
        if n_held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=["sid", "n_links"])

    cells_of = rows.repartition("pool", "i", "j").sortWithinPartitions("pool", "i", "j")
    return cells_of.mapInArrow(count, "sid long, n_links long").groupBy("sid").agg(F.sum("n_links").alias("n_links"))


def node_groups(docs: DataFrame, scratch: Scratch, k: int, plan: Plan, counted: bool = True) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (doc_id, text): (doc_id, n, sid, sketch) of each row, and (sid, least, component_id, keeper) of each set.

    least is a set's smallest doc_id, component_id that of its component; keeper is the one set of the component
    that has it, or else the one with the smallest name. If ``counted``, n_links is the number of other rows that each row
    of the set links with.
    """
    meta = scratch.save(shingle_meta(docs, k), "meta")
    salted = hot_signatures(docs, plan, k)
    sigs = signature_rows(docs, plan, k)
    if len(salted):  # a hot signature's rows go to all tasks
        marks = docs.sparkSession.createDataFrame([(int(x),) for x in salted], "sig long")
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salt = F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("sid"), F.lit(parts))).otherwise(F.lit(0))
        sigs = sigs.join(F.broadcast(marks.withColumn("hot", F.lit(True))), "sig", "left").withColumn("salt", salt)
        sigs = sigs.repartition("sig", "salt").select("sig", "sid")
    else:
        sigs = sigs.repartition("sig")
    rows = scratch.save(star_rows(sigs.sortWithinPartitions("sig", "sid"), salted), "stars", like=docs)
    nodes = scratch.save(meta.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")), "nodes", ("meta",))
    pairs = scratch.save(possible(rows.where("b IS NOT NULL").select("a", "b").distinct(), nodes, plan), "pairs", ("stars",))
    links, sets = verify(docs, pairs, plan, k, scratch, "links", "pairs")
    roots = scratch.save(components(links, scratch, "first", of=("links",)), "roots", ("links",), 2)

    members = rows.where("b IS NULL").select("sig", F.col("a").alias("sid"), "frequent")
    labelled = members.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").select("sig", "sid", F.coalesce("root", "sid").alias("root"), "frequent")
    small = labelled.where("NOT frequent").select("sig", "sid", "root").repartition("sig").sortWithinPartitions("sig", "sid")
    more = possible(cross_pairs(small).distinct().join(pairs, ["a", "b"], "left_anti"), nodes, plan)
    hard = hard_pairs(labelled.where("frequent"), nodes, plan, scratch)
    more = scratch.save(more.union(hard).distinct(), "more", ("stars",))
    more_links, more_sets = verify(docs, more, plan, k, scratch, "more-links", "more")
    links = links.union(more_links)
    roots = scratch.save(components(links, scratch, "second", of=("links", "more-links")), "all-roots", ("links", "more-links"), 2)
    scratch.drop("stars", "pairs", "more", "hot", "hard", "pooled", "hard-pairs", "roots")
    if counted:
        sets = sets.union(more_sets.join(sets.select("sid"), "sid", "left_anti"))
        degree = scratch.save(link_counts(roots, sets, nodes, plan), "degrees", ("all-roots",), 2)
    scratch.drop("links-sets", "more-links-sets")

    named = nodes.select("sid", "least", "copies").join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "sid")).alias("x")
    least = named.groupBy("root").agg(first).select("root", F.col("x.least").alias("component_id"), F.col("x.sid").alias("keeper"))
    sets = named.join(redealt(least, "root", "own_root"), F.col("root") == F.col("own_root")).select("sid", "least", "component_id", "keeper", "copies")
    if counted:
        n_links = (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")
        sets = sets.join(degree, "sid", "left").select("sid", "least", "component_id", "keeper", n_links)
    return meta, scratch.save(sets, "sets", ("nodes",))


def near_copies(docs: DataFrame, scratch: Scratch, k: int = 5, plan: Plan | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of ``docs`` (doc_id, text).

    Rows link when the Jaccard similarity of their sets of distinct ``k``-word shingles is at least
    the plan's, exactly; texts of fewer words are one shingle as a whole. component_id is the smallest
    doc_id that is reachable by links, the row's own included. n_links is the number of all other rows
    that the row links with, rows with an equal set among them.

    A null or wordless text has the empty set, no links and its own doc_id as component. A null doc_id
    takes part as any other but is never the smallest. Rows repeated with one doc_id stay as many rows.
    Only doc_id and text are read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    meta, sets = node_groups(docs, scratch, k, plan or Plan())
    out = scratch.fit(meta.select("doc_id", "n", "sid").join(sets, "sid", "left"), ("meta",))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def set_names(k: int):
    """A function of a text column: the name of each text's set, null for the empty set. Only the text goes to Python."""

    def run(texts: pa.Array) -> pa.Array:
        hasher, names = Hasher(), []
        for _, data, offsets in text_parts(texts):
            names += [set_name(s) if len(s) else None for s in hasher.shingle_sets(hasher.words(data, offsets), k)]
        return pa.array(names, pa.int64())

    return F.arrow_udf(run, T.LongType())


def keep_one(docs: DataFrame, scratch: Scratch, k: int = 5, plan: Plan | None = None) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) without near copies: one row of each component stays.

    It is one with the smallest doc_id; if rows are repeated with that doc_id and set, any one of them. Null texts and
    texts without words are copies of nothing and all stay. All columns stay as they are, whatever their names. An
    empty table stays empty.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    meta, sets = node_groups(slim, scratch, k, plan or Plan(), counted=False)
    keepers = scratch.save(sets.where("sid = keeper").select("sid", "least"), "keepers", ("nodes",))
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), set_names(k)(F.col("text").cast("string")).alias("sid"))
    kept = whole.join(keepers, "sid", "left").where("sid IS NULL OR doc_id <=> least").select("row", "sid")
    again = meta.where("sid IS NOT NULL").groupBy("sid", "doc_id").count().where("count > 1").join(keepers, "sid").where("doc_id <=> least").select("sid")
    again = scratch.save(again, "repeated", ("nodes",))
    if not again.isEmpty():  # of rows repeated as they are, one
        rest = kept.join(again, "sid", "left_semi").groupBy("sid").agg(F.min_by("row", "row.text").alias("row")).select("row", "sid")
        kept = kept.join(again, "sid", "left_anti").unionByName(rest)
    return scratch.fit(kept.select("row.*"), like=docs)


def verify(docs: DataFrame, pairs: DataFrame, plan: Plan, k: int, scratch: Scratch, name: str, of: str) -> tuple[DataFrame, DataFrame]:
    """Saved tables of the pairs that are similar and of the sets of all pairs; ``of`` is the name of theirs."""
    sets = scratch.save(sets_of(docs, pairs.select("a").union(pairs.select("b")), k), f"{name}-sets", like=docs)
    return scratch.save(verified(pairs, sets, plan), name, (of, f"{name}-sets")), sets


def hard_pairs(frequent: DataFrame, nodes: DataFrame, plan: Plan, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of frequent groups that may be similar, for sets with more frequent signatures than spare ones.

    ``frequent`` has (sig, sid, root, frequent). A group is left out if all its sets have one root.
    """
    spark = nodes.sparkSession
    level = F.col("sig").bitwiseAND((1 << LEVEL_BITS) - 1)
    spare = F.element_at(F.array(*[F.lit(plan.spare(x)) for x in range(1 << LEVEL_BITS)]), (level + 1).cast("int"))
    hot = frequent.groupBy("sid", level.alias("level"), spare.alias("spare")).count().where("count > spare").select("sid").distinct()
    rows = scratch.save(frequent.join(hot, "sid", "left_semi").select("sig", "sid", "root"), "hot", ("stars",))
    mixed = rows.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("sid").alias("center")).where("lo <> hi").select("sig", "center")
    rows = scratch.save(rows.join(redealt(mixed, "sig", "own_sig"), F.col("sig") == F.col("own_sig")).select("sid", "root", "center").distinct(), "hard", ("hot",))
    if rows.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    pools = components(rows.select(F.col("sid").alias("a"), F.col("center").alias("b")), scratch, "pools", of=("hard",)).select(F.col("node").alias("sid"), F.col("root").alias("pool"))
    rows = scratch.save(rows.select("sid", "root").distinct().join(pools, "sid"), "pooled", ("hard",))
    rows = rows.join(redealt(rows.groupBy("pool").agg(F.count("*").alias("n_group")), "pool", "own_pool"), F.col("pool") == F.col("own_pool"))
    rows = rows.join(nodes.select("sid", F.col("n").alias("size"), "sketch"), "sid")
    # Block i meets block j >= i in the cell (pool, i, j).
    blocks = F.ceil(F.col("n_group") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("sid"), blocks).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("pool", "sid", "root", "size", "sketch", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine")
    p, q = plan.p, plan.q

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in cells(batches):
            sid, root, size, mine = (table.column(c).to_numpy() for c in ("sid", "root", "size", "mine"))
            if not len(sid) or (root == root[0]).all():
                continue
            sketches = table.column("sketch").to_pylist()
            least = min(map(len, sketches))
            bits = np.stack([folded(x, least) for x in sketches])
            i, j = int(table.column("i")[0].as_py()), int(table.column("j")[0].as_py())
            left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
            found = []
            for x in left:
                y = right[(root[right] != root[x]) & (sid[right] != sid[x])]
                differ = np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1, dtype=np.int64)
                near = (differ * (q + p) <= (size[y] + size[x]) * (q - p)) & (np.minimum(size[y], size[x]) * q >= np.maximum(size[y], size[x]) * p)
                found.append(np.stack((np.full(len(y), sid[x]), sid[y]), axis=1)[near])
            pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0) if found else np.zeros((0, 2), np.int64)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    cells_of = rows.repartition("pool", "i", "j").sortWithinPartitions("pool", "i", "j")
    return scratch.save(cells_of.mapInArrow(compare, "a long, b long").distinct(), "hard-pairs", ("pooled", "nodes"))


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (pool, i, j) of a stream sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        key = np.stack([b.column(c).to_numpy() for c in ("pool", "i", "j")], axis=1)
        if not len(key):
            continue
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(key)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            this = tuple(key[x])
            if held and this != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(x, y - x))
            last = this
    if held:
        yield pa.Table.from_batches(held)
