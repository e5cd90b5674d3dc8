"""Media columns: storing bytes as 8-bit sound and sniffing what a binary column really holds.

``sniff`` runs an Aho-Corasick automaton of magic byte strings over the whole value; each place it
finds is handed to the validator of that format, which walks the structure and returns the length
of the object that begins there, or None. What stands at offset 0 corrects the declared type; what
stands further in is carved as embedded media.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

UNIT = 64
SAMPLE_RATE = 8000
OTHER = "application/octet-stream"


def to_payload(text: bytes) -> bytes:
    """The bytes with zero bytes up to a positive multiple of 64."""
    n = max(UNIT, -(-len(text) // UNIT) * UNIT)
    return text + bytes(n - len(text))


def wav_bytes(samples: bytes) -> bytes:
    """A RIFF/WAVE file of one channel of unsigned 8-bit PCM samples; their number is even."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(form) + 8 + len(samples), b"WAVE") + form + struct.pack("<4sI", b"data", len(samples)) + samples


def wav_samples(b: bytes) -> bytes:
    """The samples that a WAVE file holds."""
    at = 12
    while at + 8 <= len(b):
        name, n = struct.unpack_from("<4sI", b, at)
        if name == b"data":
            return b[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def _png(b: bytes, at: int) -> int | None:
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, pos)
        if pos + 12 + n > len(b) or (first and (kind != b"IHDR" or n != 13)):
            return None
        if zlib.crc32(b[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", b, pos + 8 + n)[0]:
            return None
        pos, first = pos + 12 + n, False
        if kind == b"IEND":
            return pos - at
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    pos, scanned = at + 2, False
    while pos + 4 <= len(b):
        if b[pos] != 0xFF:
            return None
        mark = b[pos + 1]
        if mark == 0xFF:
            pos += 1
            continue
        if mark == 0xD9:
            return pos + 2 - at if scanned else None
        if mark in (0x00, 0x01) or 0xD0 <= mark <= 0xD8:
            return None
        n = struct.unpack_from(">H", b, pos + 2)[0]
        if n < 2 or pos + 2 + n > len(b):
            return None
        pos += 2 + n
        if mark == 0xDA:  # entropy-coded bytes follow, up to a marker that isn't a stuffed or restart one
            scanned = True
            while True:
                pos = b.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= len(b):
                    return None
                if b[pos + 1] == 0 or 0xD0 <= b[pos + 1] <= 0xD7:
                    pos += 2
                else:
                    break
            if b[pos + 1] == 0xD9:
                return pos + 2 - at
    return None


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    pos = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)

    def blocks(pos: int) -> int:
        while pos < len(b) and b[pos]:
            pos += b[pos] + 1
        return pos + 1

    while pos < len(b):
        if b[pos] == 0x3B:
            return pos + 1 - at
        if b[pos] == 0x21:
            pos = blocks(pos + 2)
        elif b[pos] == 0x2C and pos + 10 <= len(b):
            flags = b[pos + 9]
            pos = blocks(pos + 11 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0))
        else:
            return None
    return None


def _riff(form: bytes, first: tuple[bytes, ...]) -> Callable[[bytes, int], int | None]:
    def walk(b: bytes, at: int) -> int | None:
        if at + 20 > len(b) or b[at + 8 : at + 12] != form or b[at + 12 : at + 16] not in first:
            return None
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        pos = at + 12
        if end > len(b):
            return None
        while pos + 8 <= end:
            n = struct.unpack_from("<I", b, pos + 4)[0]
            pos += 8 + n + n % 2
        return end - at if pos in (end, end + 1) else None

    return walk


def _bmp(b: bytes, at: int) -> int | None:
    if at + 30 > len(b):
        return None
    size, reserved, offset, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    ok = reserved == 0 and head in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 0 < width and height and 14 + head <= offset <= size <= len(b) - at
    return size if ok and offset + (width * bits + 31) // 32 * 4 * abs(height) <= size else None


def _gzip(b: bytes, at: int) -> int | None:
    if at + 18 > len(b) or b[at + 2] != 8 or b[at + 3] & 0xE0:
        return None
    unpack = zlib.decompressobj(31)
    try:
        rest = memoryview(b)[at:]
        for k in range(0, len(rest), 65536):
            piece = unpack.decompress(rest[k : k + 65536], 1 << 20)
            while not unpack.eof and unpack.unconsumed_tail:
                piece = unpack.decompress(unpack.unconsumed_tail, 1 << 20)
            if unpack.eof:
                return min(k + 65536, len(rest)) - len(unpack.unused_data)
        del piece
    except zlib.error:
        return None
    return None


def _zip(b: bytes, at: int) -> int | None:
    end = b.find(b"PK\x05\x06", at)
    while end >= 0 and end + 22 <= len(b):
        size, start, note = struct.unpack_from("<IIH", b, end + 12)
        if at + start + size == end and end + 22 + note <= len(b) and b[at + start : at + start + 4] in (b"PK\x01\x02", b"PK\x05\x06"):
            return end + 22 + note - at
        end = b.find(b"PK\x05\x06", end + 4)
    return None


def _pdf(b: bytes, at: int) -> int | None:
    if not b[at + 5 : at + 8].replace(b".", b"").isdigit():
        return None
    start, end = b.find(b"startxref", at), b.find(b"%PDF-", at + 5)
    last = b.rfind(b"%%EOF", at, end if end >= 0 else len(b))
    return last + 5 - at if 0 <= start < last else None


def _flac(b: bytes, at: int) -> int | None:
    pos, first = at + 4, True
    while pos + 4 <= len(b):
        head, n = b[pos], int.from_bytes(b[pos + 1 : pos + 4], "big")
        if (first and (head & 0x7F or n != 34)) or head & 0x7F == 127 or pos + 4 + n > len(b):
            return None
        pos, first = pos + 4 + n, False
        if head & 0x80:  # frames follow without a total length: the rest is theirs
            return len(b) - at if b[pos : pos + 1] == b"\xff" else pos - at
    return None


def _ogg(b: bytes, at: int) -> int | None:
    pos, serial, ended = at, None, False
    while b[pos : pos + 4] == b"OggS" and pos + 27 <= len(b) and not ended:
        n = b[pos + 26]
        size = 27 + n + sum(b[pos + 27 : pos + 27 + n])
        this = b[pos + 14 : pos + 18]
        if b[pos + 4] or pos + size > len(b) or serial not in (None, this):
            return None
        serial, ended = this, bool(b[pos + 5] & 4)
        pos += size
    return pos - at if ended else None


def _mp4(b: bytes, at: int) -> int | None:
    """``at`` is the place of ``ftyp``, four bytes into its box."""
    start = pos = at - 4
    kinds = set()
    while 0 <= pos and pos + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, pos)
        if n == 1 and pos + 16 <= len(b):
            n = struct.unpack_from(">Q", b, pos + 8)[0]
        if kind not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"moof", b"mfra", b"sidx", b"udta", b"meta", b"uuid", b"styp", b"pdin") or n < 8 or pos + n > len(b):
            break
        kinds.add(kind)
        pos += n
    return pos - start if b"ftyp" in kinds and len(kinds) > 1 else None


#: Magic bytes, media type and how many bytes before them the object begins.
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", "image/png", 0),
    (b"\xff\xd8\xff", "image/jpeg", 0),
    (b"GIF87a", "image/gif", 0),
    (b"GIF89a", "image/gif", 0),
    (b"BM", "image/bmp", 0),
    (b"RIFF", "audio/wav", 0),
    (b"RIFF", "image/webp", 0),
    (b"fLaC", "audio/flac", 0),
    (b"OggS", "audio/ogg", 0),
    (b"ftyp", "video/mp4", 4),
    (b"%PDF-", "application/pdf", 0),
    (b"PK\x03\x04", "application/zip", 0),
    (b"\x1f\x8b", "application/gzip", 0),
]


def make_sniffer() -> Callable[[bytes], list[tuple[int, int, str]]]:
    """A function from bytes to the (offset, length, type) of the objects in them, outermost ones only."""
    walkers = {
        "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "audio/flac": _flac, "audio/ogg": _ogg,
        "video/mp4": _mp4, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip,
        "audio/wav": _riff(b"WAVE", (b"fmt ", b"LIST", b"JUNK", b"bext")), "image/webp": _riff(b"WEBP", (b"VP8 ", b"VP8L", b"VP8X")),
    }
    words: dict[bytes, list[tuple[str, int]]] = {}
    for magic, kind, back in MAGIC:
        words.setdefault(magic, []).append((kind, back))
    automaton = ahocorasick.Automaton()
    for magic, kinds in words.items():
        automaton.add_word(magic.decode("latin-1"), (len(magic), kinds))
    automaton.make_automaton()

    def sniff(b: bytes) -> list[tuple[int, int, str]]:
        found: list[tuple[int, int, str]] = []
        ended = {}
        for last, (n, kinds) in automaton.iter(b.decode("latin-1")):
            at = last + 1 - n
            for kind, back in kinds:
                if at - back >= 0 and (size := walkers[kind](b, at)):
                    ended[at - back] = max(ended.get(at - back, (0, "")), (size, kind))
        over = 0
        for at in sorted(ended):
            size, kind = ended[at]
            inside = at < over
            if not inside:
                over = at + size
            if not inside or found and found[0][0] == 0 and at:  # parts of the outermost object are embedded in it
                found.append((at, size, kind))
        return found

    return sniff


SNIFFED = T.StructType([
    T.StructField("media_type", T.StringType()),
    T.StructField("corrected", T.BooleanType()),
    T.StructField("valid_bytes", T.LongType()),
    T.StructField("embedded", T.ArrayType(T.StructType([T.StructField("at", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("media_type", T.StringType()), T.StructField("content", T.BinaryType())]))),
])


def encode_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces a text column by ``n_bytes``, ``media`` (a WAVE file) and ``declared_type``.

    The payload is the text in UTF-8 (null: empty) with zero bytes up to a positive multiple of 64;
    each byte becomes one sample, so nothing is lost. Other columns stay, apart from those named as
    the new ones. Equal texts give equal bytes.
    """
    rows = df.drop("n_bytes", "media", "declared_type") if text not in ("n_bytes", "media", "declared_type") else df.drop(*({"n_bytes", "media", "declared_type"} - {text}))
    keep = [f for f in rows.schema.fields if f.name != text]
    schema = T.StructType([*keep, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType()), T.StructField("declared_type", T.StringType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, text):
                raw = [(x or "").encode() for x in part.column(text).to_pylist()]
                media = [wav_bytes(to_payload(x)) for x in raw]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary()), pa.array(["audio/wav"] * len(raw), pa.string())], names=schema.names)

    return rows.mapInArrow(encode, schema)


def slices(b: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes in a column, or one row."""
    at = 0
    whole = b.column(column)
    while at < b.num_rows:
        n = b.num_rows - at
        while n > 1 and whole.slice(at, n).get_total_buffer_size() and _width(whole.slice(at, n)) > limit:
            n = max(1, n // 2)
        yield b.slice(at, n)
        at += n


def _width(a: pa.Array) -> int:
    return a.nbytes


def sniff_media(df: DataFrame, content: str = "media", declared: str = "declared_type") -> DataFrame:
    """Adds ``sniffed``: the type found, whether it corrects the declared one, its length and embedded media.

    A null or empty value, or one in which no format is confirmed at offset 0, has the declared type
    and 0 valid bytes; a null declared type counts as ``application/octet-stream``. A column already
    named ``sniffed`` is replaced.
    """
    rows = df.drop("sniffed")
    schema = T.StructType([*rows.schema.fields, T.StructField("sniffed", SNIFFED)])
    arrow = pa.struct([("media_type", pa.string()), ("corrected", pa.bool_()), ("valid_bytes", pa.int64()), ("embedded", pa.list_(pa.struct([("at", pa.int64()), ("n_bytes", pa.int64()), ("media_type", pa.string()), ("content", pa.binary())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniff = make_sniffer()
        for b in batches:
            for part in slices(b, content):
                out = []
                for x, said in zip(part.column(content).to_pylist(), part.column(declared).to_pylist(), strict=True):
                    found = sniff(x) if x else []
                    whole = next((f for f in found if f[0] == 0), None)
                    kind = whole[2] if whole else said or OTHER
                    out.append({"media_type": kind, "corrected": kind != said, "valid_bytes": whole[1] if whole else 0, "embedded": [{"at": at, "n_bytes": n, "media_type": k, "content": x[at : at + n]} for at, n, k in found if at]})
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, arrow)], names=schema.names)

    return rows.mapInArrow(run, schema)


def describe_stored(df: DataFrame, content: str = "media") -> DataFrame:
    """Adds what the samples read back from ``content`` amount to: lengths, digests and a feature text.

    Needs ``sniffed`` of :func:`sniff_media`. The feature lists type, bits, channels, rate, number of
    samples and embedded objects. A null value, or one that isn't a WAVE file with 8-bit samples, has nulls. Columns already
    named as the new ones are replaced; an empty table stays empty.
    """
    new = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    rows = df.drop(*[n for n, _ in new])
    keep = [f for f in rows.schema.fields if f.name != content and f.name != "sniffed"]
    schema = T.StructType([*keep, *[T.StructField(n, t) for n, t in new]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, content):
                cols: list[list] = [[] for _ in new]
                for x, s in zip(part.column(content).to_pylist(), part.column("sniffed").to_pylist(), strict=True):
                    if x is None or not s["valid_bytes"] or s["media_type"] != "audio/wav" or struct.unpack_from("<H", x, 34)[0] != 8:
                        for c in cols:
                            c.append(None)
                        continue
                    payload = wav_samples(x)
                    channels, rate, bits = (struct.unpack_from("<H", x, 22)[0], struct.unpack_from("<I", x, 24)[0], struct.unpack_from("<H", x, 34)[0])
                    inner = ",".join(f"{e['media_type']}@{e['at']}+{e['n_bytes']}" for e in s["embedded"])
                    feature = f"{s['media_type']};bits={bits};channels={channels};rate={rate};samples={len(payload)};valid={s['valid_bytes']};embedded={inner}"
                    for c, v in zip(cols, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(x), hashlib.sha256(x).hexdigest(), feature), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), *(pa.array(c, pa.int64() if isinstance(t, T.LongType) else pa.string()) for c, (_, t) in zip(cols, new, strict=True))], names=schema.names)

    return rows.mapInArrow(run, schema)
