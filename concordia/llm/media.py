"""Media columns (2): signature sniffing of binary values.

An Aho-Corasick automaton locates the magic bytes of all formats in one pass. At each place the format's validator walks its
structure (chunks, blocks, markers, checksums, lengths) and returns where the object ends; only confirmed objects count. The
object at offset 0 gives the true type, which corrects a declared one; objects further in are carved, with offset, length and hash.

Defined results: null bytes count as empty; an empty value or one without any valid object is ``application/octet-stream``,
not valid, nothing carved; equal values give equal rows; other columns are ignored. Objects inside a confirmed one are not carved
again, except inside containers whose payload is opaque to the validator (WAV samples), where they are. Values of any length are
read whole; chains that validators walk in vain are remembered, so marks without an object behind them are not walked again and again;
where two formats' marks begin at one place, the automaton's order decides; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_arrow, need

UNKNOWN = "application/octet-stream"


def _png(b: bytes, at: int, seen: dict):
    p = at + 8
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        end = p + 12 + n
        if end > len(b) or zlib.crc32(b[p + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0] or (p == at + 8) != (kind == b"IHDR"):
            return None
        if kind == b"IEND":
            return "image/png", end
        p = end
    return None


def _gif(b: bytes, at: int, seen: dict):
    if at + 13 > len(b):
        return None
    p = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0)
    while p < len(b):
        mark = b[p]
        if mark == 0x3B:
            return "image/gif", p + 1
        if mark == 0x21:
            p += 2
        elif mark == 0x2C and p + 10 <= len(b):
            p += 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 128 else 0)
        else:
            return None
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return None


def _jpeg(b: bytes, at: int, seen: dict):
    p, framed = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        mark = b[p + 1]
        if mark in (0xC0, 0xC1, 0xC2):
            framed = True
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or 0xD0 <= mark <= 0xD9:
            return None
        p += 2 + n
        if mark == 0xDA:
            if "jpeg" in seen:  # a scan went on to the value's end before: so would this one
                return None
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b):
                if b[p + 1] == 0xD9:
                    return ("image/jpeg", p + 2) if framed else None
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7 or b[p + 1] == 0xFF:
                    p += 1 if b[p + 1] == 0xFF else 2
                else:
                    break
            else:
                seen["jpeg"] = True
                return None
    return None


def _riff(b: bytes, at: int, seen: dict):
    if at + 12 > len(b):
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}.get(b[at + 8 : at + 12])
    p, names = at + 12, []
    while kind and p + 8 <= end <= len(b):
        name, n = struct.unpack_from("<4sI", b, p)
        names.append(name)
        p += 8 + n + n % 2
    need_ = {"audio/wav": {b"fmt ", b"data"}, "image/webp": set(), "video/x-msvideo": {b"LIST"}}.get(kind, {b"?"})
    return (kind, end) if kind and p == end + (end - at) % 2 and need_ <= set(names) and names else None


def _bmp(b: bytes, at: int, seen: dict):
    if at + 26 > len(b):
        return None
    size, zero, start, header = struct.unpack_from("<IIII", b, at + 2)
    return ("image/bmp", at + size) if zero == 0 and header in (12, 40, 52, 56, 108, 124) and 14 + header <= start <= size and at + size <= len(b) else None


def _gzip(b: bytes, at: int, seen: dict):
    """A header whose optional fields end, then a stream to its end. Where the next zero byte is, is remembered: names end there."""

    def zero(p: int) -> int:
        begin, found = seen.get("zero", (0, -2))
        if found == -2 or p < begin or 0 <= found < p:
            found = b.find(b"\0", p)
            seen["zero"] = p, found
        return found

    flags, p = (b[at + 3] if at + 10 <= len(b) else 0xFF), at + 10
    if flags & 0xE0:
        return None
    if flags & 4:
        if p + 2 > len(b):
            return None
        p += 2 + struct.unpack_from("<H", b, p)[0]
    for bit in (8, 16):
        if flags & bit:
            if (end := zero(p)) < 0:
                return None
            p = end + 1
    d, p, view = zlib.decompressobj(31), at, memoryview(b)
    try:
        while p < len(b) and not d.eof:
            piece = view[p : p + (1 << 16)]
            p += len(piece)
            d.decompress(piece, 1 << 20)
            while d.unconsumed_tail and not d.eof:
                d.decompress(d.unconsumed_tail, 1 << 20)
    except zlib.error:
        return None
    return ("application/gzip", p - len(d.unused_data)) if d.eof else None


def _zip(b: bytes, at: int, seen: dict):
    """Entries from ``at`` to the central directory, which must say how far back the first one is. What follows a place is remembered, so
    a chain of entries without a directory is walked once."""
    after, p, passed = seen.setdefault("zip", {}), at, []
    while p not in after and p + 30 <= len(b) and b[p : p + 4] == b"PK\x03\x04":
        flags, packed, name, extra = struct.unpack_from("<H", b, p + 6)[0], *struct.unpack_from("<IxxxxHH", b, p + 18)
        passed.append(p)
        if flags & 8:
            p = -1
            break
        p += 30 + name + extra + packed
    directory = after.get(p, p)
    after.update(dict.fromkeys(passed, directory))
    if directory < 0:
        return None
    ends = seen.setdefault("zip directory", {})
    if directory not in ends:
        p = directory
        while p + 46 <= len(b) and b[p : p + 4] == b"PK\x01\x02":
            p += 46 + sum(struct.unpack_from("<HHH", b, p + 28))
        ends[directory] = p
    p = ends[directory]
    if p + 22 > len(b) or b[p : p + 4] != b"PK\x05\x06":
        return None
    size, start, comment = struct.unpack_from("<IIH", b, p + 12)
    return ("application/zip", p + 22 + comment) if start == directory - at and size == p - directory and p + 22 + comment <= len(b) else None


def _pdf(b: bytes, at: int, seen: dict):
    """The version, then the next ``startxref`` with an offset and ``%%EOF``; the places of both marks are found once a value."""
    if not b[at + 5 : at + 6].isdigit() or b[at + 6 : at + 7] != b".":
        return None
    if "pdf" not in seen:
        seen["pdf"] = [m.start() for m in re.finditer(rb"startxref", b)], [m.start() for m in re.finditer(rb"%%EOF", b)]
    refs, ends = seen["pdf"]
    r = bisect_left(refs, at)
    if r == len(refs) or (e := bisect_left(ends, refs[r])) == len(ends) or ends[e] - refs[r] > 64:
        return None
    end, place = ends[e], b[refs[r] + 9 : ends[e]].strip()
    return ("application/pdf", end + 5) if place.isdigit() and at + int(place) < end else None


def _ogg(b: bytes, at: int, seen: dict):
    p, last, torn = at, None, seen.setdefault("ogg", set())
    passed = []
    while p + 27 <= len(b) and b[p : p + 4] == b"OggS" and b[p + 4] == 0:
        passed.append(p)
        n = b[p + 26]
        end = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        if p in torn or end > len(b):  # its last page breaks off, as for all pages before
            torn.update(passed)
            return None
        p = last = end
    return ("audio/ogg", last) if last else None


#: magic bytes and validators, as the formats' public specifications give them
FORMATS = (
    (b"\x89PNG\r\n\x1a\n", _png),
    (b"GIF87a", _gif),
    (b"GIF89a", _gif),
    (b"\xff\xd8\xff", _jpeg),
    (b"RIFF", _riff),
    (b"BM", _bmp),
    (b"\x1f\x8b\x08", _gzip),
    (b"PK\x03\x04", _zip),
    (b"%PDF-", _pdf),
    (b"OggS", _ogg),
)


def sniffer():
    """``sniff(bytes) -> [(type, start, end), ...]``, in order; not overlapping, but for objects inside WAV samples."""
    automaton = ahocorasick.Automaton()
    for magic, check in FORMATS:
        automaton.add_word(magic.decode("latin-1"), (len(magic), check))
    automaton.make_automaton()

    def sniff(b: bytes) -> list[tuple[str, int, int]]:
        found, free, seen = [], 0, {}  # seen: what validators have learnt about this value
        for last, (n, check) in automaton.iter(b.decode("latin-1")):
            at = last - n + 1
            if at >= free and (got := check(b, at, seen)):
                found.append((got[0], at, got[1]))
                free = at + n if got[0] == "audio/wav" else got[1]
        return found

    return sniff


def sniff_media(rows: DataFrame, id_col: str = "doc_id", bytes_col: str = "media", declared_col: str | None = "declared") -> DataFrame:
    """(id, declared, type, valid, end, trailing, corrected, carved: array of type, start, length, sha256) for each row."""
    picked = rows.select(F.col(id_col).alias("id"), F.col(bytes_col).cast("binary").alias("media"), (F.col(declared_col) if declared_col else F.lit(None)).cast("string").alias("declared"))
    kind = picked.schema["id"].dataType.simpleString()

    def make():
        sniff = sniffer()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for i, media, declared in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                b = media or b""
                found = sniff(b)
                head = next((x for x in found if x[1] == 0), None)
                carved = [{"type": t, "start": s, "length": e - s, "sha256": hashlib.sha256(b[s:e]).hexdigest()} for t, s, e in found if s]
                true = head[0] if head else UNKNOWN
                out.append({"id": i, "declared": declared, "type": true, "valid": head is not None, "end": head[2] if head else 0, "trailing": len(b) - (head[2] if head else 0), "corrected": declared != true, "carved": carved})
            return pa.RecordBatch.from_pylist(out, schema=target)

        return step

    item = pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("sha256", pa.string())])
    target = pa.schema([("id", _arrow(kind)), ("declared", pa.string()), ("type", pa.string()), ("valid", pa.bool_()), ("end", pa.int64()), ("trailing", pa.int64()), ("corrected", pa.bool_()), ("carved", pa.list_(item))])
    return by_arrow(picked, make, f"id {kind}, declared string, type string, valid boolean, end long, trailing long, corrected boolean, carved array<struct<type:string,start:long,length:long,sha256:string>>")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[kind]


RATE = 8000


def wav_of(payload: bytes) -> bytes:
    """The payload as 8-bit mono samples of a WAV file (``payload`` of even length)."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def samples_of(media: bytes) -> tuple[bytes, dict]:
    """The samples that the file's own chunks point to, and its format fields."""
    p, end, fmt, data = 12, 8 + struct.unpack_from("<I", media, 4)[0], {}, b""
    while p + 8 <= end:
        name, n = struct.unpack_from("<4sI", media, p)
        if name == b"fmt ":
            fmt = dict(zip(("codec", "channels", "rate", "bytes_s", "align", "bits"), struct.unpack_from("<HHIIHH", media, p + 8), strict=True))
        elif name == b"data":
            data = media[p + 8 : p + 8 + n]
        p += 8 + n + n % 2
    return data, fmt


def text_media(docs: DataFrame) -> DataFrame:
    """Every text as a WAV value: doc_id, n_bytes, media, declared (as a careless producer would declare it: text/plain)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = [x or b"" for x in batch.column(1).to_pylist()]
            media = [wav_of(b + bytes(-len(b) % 64 or (64 if not b else 0))) for b in raw]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary()), pa.array(["text/plain"] * len(raw))], names=["doc_id", "n_bytes", "media", "declared"])

        return step

    rows = need(docs, doc_id="long", text="string").select("doc_id", F.col("text").cast("binary").alias("b"))
    return by_arrow(rows, make, "doc_id long, n_bytes long, media binary, declared string")


def media_features(media_rows: DataFrame) -> DataFrame:
    """The stored bytes of (doc_id, n_bytes, media, declared), sniffed and read back: sizes, hashes and a feature string."""

    def make():
        sniff = sniffer()
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for media, declared in zip(batch.column("media").to_pylist(), batch.column("declared").to_pylist(), strict=True):
                found = sniff(media or b"")
                head = next((x for x in found if x[1] == 0 and x[0] == "audio/wav"), None)
                if head is None:
                    raise ValueError("a stored value is not a valid WAV file")
                data, fmt = samples_of(media[: head[2]])
                carved = ",".join(f"{t}@{s}+{e - s}" for t, s, e in found if s)
                sums = sum(data)
                feature = f"{declared}>{head[0]};channels={fmt['channels']};rate={fmt['rate']};bits={fmt['bits']};samples={len(data)};sum={sums};zeros={data.count(0)};carved=[{carved}]"
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *cols], names=names)

        return step

    return by_arrow(media_rows, make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
