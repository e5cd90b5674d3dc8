"""WARC archives whose records share a Zstandard dictionary.

Layout of a ``.warc.zst`` file: a skippable frame (magic 0x184D2A5D) that holds the dictionary, then
one Zstandard frame for each record, so that a record can be read alone. The dictionary is trained
on a bounded sample of the records that are archived.

A task writes archives of its own below the shared folder; their names hold the attempt's number and
only the index rows of the attempt that succeeded name them, so a lost executor or a repeated task
leaves an unread file at worst, never a mixed one.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actlens.llm.scratch import Scratch

#: Fixed value of the format.
DICTIONARY_FRAME = 0x184D2A5D
RESPONSE, REVISIT = "response", "revisit"
_SPACE = uuid.UUID("6f7d6a52-0d0c-5a5e-9a53-3f6b1c2f7e10")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None, digest: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}:{kind}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A WARC/1.1 record; a revisit has the response's HTTP head, and so the payload's length, without the payload."""
    digest = base32_sha1(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = REVISIT if revisit else RESPONSE
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_uri(page_id, digest, kind)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_uri(refers_to, digest, RESPONSE)}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    else:
        block += payload
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Page id, url, type, digest, payload (None of a revisit), its length and what is referred to."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == RESPONSE and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError("a payload differs from its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload_digest": digest, "payload_bytes": length, "payload": payload if kind == RESPONSE else None, "refers_to": number("X-Refers-To-Page-ID")}


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary; where the samples are too few to train one, their last bytes, which serve as a raw one."""
    try:
        if len(samples) >= 8:
            return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        pass
    raw = b"".join(samples)[-size:]
    return raw if len(raw) >= 8 else b""


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary


def read_records(f, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The raw records of an archive, one at a time."""
    magic, n = struct.unpack("<II", f.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    dictionary = f.read(n)
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    left = f.read(chunk)
    while left:
        frame, parts = unpack.decompressobj(), []
        while not frame.eof:
            if not left and not (left := f.read(chunk)):
                raise ValueError("an archive ends within a record")
            parts.append(frame.decompress(left))
            left = frame.unused_data if frame.eof else b""
        yield b"".join(parts)
        left = left or f.read(chunk)


INDEX = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("archive", T.StringType()), T.StructField("at", T.LongType()), T.StructField("n_bytes", T.LongType())])


def write_archives(
    pages: DataFrame, scratch: Scratch, min_revisit_bytes: int = 0, date: str = "2026-01-01T00:00:00Z",
    dictionary_bytes: int = 64 << 10, sample_records: int = 400, sample_record_bytes: int = 64 << 10, archive_bytes: int = 64 << 20, level: int = 3,
) -> DataFrame:
    """Archives ``pages`` (page_id, url, html) and returns the index: page_id, archive, at, n_bytes.

    Of the rows with equal payloads of at least ``min_revisit_bytes`` bytes, those with the smallest
    page_id are responses and the others revisit it; smaller payloads are all responses. A null html
    is an empty payload; a null url is left out; null page_ids come last. Rows repeated with one
    page_id and payload are of one type. Other columns are not archived, whatever their names. An empty table gives
    an empty index; payloads of any length are archived whole.

    The dictionary is trained on ``sample_records`` whole records at most, of up to
    ``sample_record_bytes`` bytes each, those first by a hash of page_id and payload. With fewer than eight it is made of the records' bytes as they are.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    rank, fits = F.xxhash64("page_id", "html"), F.octet_length("html") <= sample_record_bytes
    ranks = [r[0] for r in rows.where(fits).select(rank.alias("r")).orderBy("r").limit(sample_records).collect()]  # tasks send ranks, not records
    small = rows.where(fits & rank.isin(ranks)).dropDuplicates(["page_id", "html"]).orderBy(rank, "page_id").limit(sample_records) if ranks else rows.limit(0)
    samples = [record_bytes(r.page_id, r.url, r.html.encode(), None, False, date) for r in small.collect()]
    dictionary = train_dictionary(samples, dictionary_bytes)
    keyed = rows.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    # Only digests are shuffled; those of several rows are few as a rule, and then the join needs no shuffle of pages.
    # Where they are many and one is hot, adaptive execution splits it, as the other side has one row a digest.
    first = keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    first = scratch.save(first, "repeated", like=rows)
    linked = keyed.join(first, "digest", "left").select("page_id", "url", "html", F.col("first").alias("_first"))
    root = scratch.path("archives")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        stem = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        pack = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        out, name, at, n = None, "", 0, 0
        try:
            for b in batches:
                index: list[tuple] = []
                for page_id, url, html, ref in zip(*(b.column(c) for c in ("page_id", "url", "html", "_first")), strict=True):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, n = f"{stem}-{n:04d}.warc.zst", n + 1
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                        out.write(head := dictionary_frame(dictionary))
                        at = len(head)
                    page_id, ref, raw = page_id.as_py(), ref.as_py(), html.as_py().encode()
                    revisit = ref is not None and len(raw) >= min_revisit_bytes and page_id != ref
                    frame = pack.compress(record_bytes(page_id, url.as_py(), raw, ref, revisit, date))
                    out.write(frame)
                    index.append((page_id, name, at, len(frame)))
                    at += len(frame)
                if index:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=INDEX.names)
        finally:
            if out is not None:
                out.close()

    return scratch.save(linked.mapInArrow(write, INDEX).withColumn("archive", F.concat(F.lit(root + "/"), "archive")), "index")


RECORD = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("refers_to", T.LongType()),
])


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives named in column ``archive``, each checked against its digest.

    A name may occur in many rows; its archive is read once. A revisit has a null payload, but its
    payload's digest and length. ``with_payload=False`` checks payloads and leaves them out.
    """
    names = archives.select("archive").where("archive IS NOT NULL").distinct()
    schema = RECORD if with_payload else T.StructType([f for f in RECORD.fields if f.name != "payload"])
    arrow = [{T.LongType: pa.int64(), T.StringType: pa.string(), T.BinaryType: pa.binary()}[type(f.dataType)] for f in schema.fields]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(schema.names, arrow, strict=True)], names=schema.names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column("archive").to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_stream(path, compression=None) as f:
                    rows, size = [], 0
                    for raw in read_records(f):
                        rows.append(parse_record(raw))
                        size += len(raw) * with_payload + 200
                        if size > 4 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch(rows)

    # One archive for each task: they are large, and adaptive execution would put their short names together.
    return names.repartition(max(1, names.count())).mapInArrow(read, schema)
