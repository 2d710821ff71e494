"""Media columns: signature sniffing.

An Aho-Corasick automaton locates the magic bytes of every known format in one
pass over a blob; each hit goes to that format's validator, which walks the
structure (chunk lengths, checksums, terminators) and returns the exact length
or rejects the hit. The outermost confirmed item corrects the declared type,
and every confirmed item can be carved.

Defined cases: a null blob has no items and keeps its declared type; a null
declared type counts as unknown; a blob without a confirmed item at offset 0 is
``application/octet-stream``; nested items are all reported, with their depth; an
empty table stays empty; repeated rows are sniffed each; blobs of any length are walked whole.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, id_and_bytes

UNKNOWN = "application/octet-stream"

# The formats' magic bytes and the media types they stand for.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"\xff\xd8\xff": "image/jpeg",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"BM": "image/bmp",
    b"RIFF": "riff",
    b"\x1f\x8b\x08": "application/gzip",
    b"PK\x03\x04": "application/zip",
    b"%PDF-": "application/pdf",
    b"OggS": "audio/ogg",
    b"fLaC": "audio/flac",
}
RIFF_KIND = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}


def _png(b: bytes, at: int, known: dict) -> tuple[str, int] | None:
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        size, name = struct.unpack_from(">I4s", b, pos)
        end = pos + 12 + size
        if end > len(b) or (first and (name != b"IHDR" or size != 13)):
            return None
        if zlib.crc32(b[pos + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if name == b"IEND":
            return "image/png", end - at
        pos, first = end, False
    return None


_JPEG_NEXT = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]", re.DOTALL)


def _jpeg(b: bytes, at: int, known: dict) -> tuple[str, int] | None:
    pos, frame = at + 2, False
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        mark = b[pos + 1]
        if mark == 0xFF:
            pos += 1
            continue
        size = struct.unpack_from(">H", b, pos + 2)[0]
        if size < 2 or mark in (0x00, 0x01, 0xD8, 0xD9) or pos + 2 + size > len(b):
            return None
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        pos += 2 + size
        if mark == 0xDA:
            found = _JPEG_NEXT.search(b, pos)
            if not found or not frame:
                return None
            pos = found.start()
            if b[pos + 1] == 0xD9:
                return "image/jpeg", pos + 2 - at
    return None


def _gif_blocks(b: bytes, pos: int) -> int:
    while pos < len(b) and b[pos]:
        pos += 1 + b[pos]
    return pos + 1


def _gif(b: bytes, at: int, known: dict) -> tuple[str, int] | None:
    if at + 13 > len(b):
        return None
    flags, pos, images = b[at + 10], at + 13, 0
    pos += 3 * (2 << (flags & 7)) if flags & 0x80 else 0
    while pos < len(b):
        kind = b[pos]
        if kind == 0x3B:
            return ("image/gif", pos + 1 - at) if images else None
        if kind == 0x21:
            pos = _gif_blocks(b, pos + 2)
        elif kind == 0x2C and pos + 10 <= len(b):
            local = b[pos + 9]
            pos += 10 + (3 * (2 << (local & 7)) if local & 0x80 else 0)
            pos, images = _gif_blocks(b, pos + 1), images + 1
        else:
            return None
    return None


def _bmp(b: bytes, at: int, known: dict) -> tuple[str, int] | None:
    if at + 26 > len(b):
        return None
    size, spare, start, header = struct.unpack_from("<IIII", b, at + 2)
    if spare or header not in (12, 40, 52, 56, 64, 108, 124) or not 14 + header <= start <= size <= len(b) - at:
        return None
    return "image/bmp", size


def _riff_chunks(b: bytes, at: int) -> tuple[int, dict[bytes, tuple[int, int]]] | None:
    """(end, first chunk of each name -> (offset, size)) if the lengths agree."""
    if at + 12 > len(b):
        return None
    size = struct.unpack_from("<I", b, at + 4)[0]
    pos, end, found = at + 12, at + 8 + size, {}
    if size < 4 or end > len(b):
        return None
    while pos + 8 <= end:
        name, n = struct.unpack_from("<4sI", b, pos)
        if pos + 8 + n > end:
            return None
        found.setdefault(name, (pos + 8, n))
        pos += 8 + n + (n & 1)
    return (end, found) if pos >= end else None


def _riff(b: bytes, at: int, known: dict) -> tuple[str, int] | None:
    kind = RIFF_KIND.get(b[at + 8 : at + 12])
    walked = _riff_chunks(b, at) if kind else None
    if not walked or not walked[1]:
        return None
    if kind == "audio/wav":
        fmt, data = walked[1].get(b"fmt "), walked[1].get(b"data")
        if not fmt or not data or fmt[1] < 16:
            return None
        channels, _, _, align, bits = struct.unpack_from("<HIIHH", b, fmt[0] + 2)
        if align != channels * ((bits + 7) // 8) or not align or data[1] % align:
            return None
    return kind, walked[0] - at


def _gzip(b: bytes, at: int, known: dict) -> tuple[str, int] | None:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    unzip, pos = zlib.decompressobj(31), at
    try:
        while pos < len(b) and not unzip.eof:
            unzip.decompress(b[pos : pos + 65536])
            pos += 65536
    except zlib.error:
        return None
    return ("application/gzip", min(pos, len(b)) - len(unzip.unused_data) - at) if unzip.eof else None


def _descriptors(b: bytes) -> dict[int, int]:
    """Start of an entry's data -> end of the data descriptor that states this distance."""
    found, at = {}, b.find(b"PK\x07\x08")
    while at >= 0 and at + 16 <= len(b):
        packed = struct.unpack_from("<I", b, at + 8)[0]
        found.setdefault(at - packed, at + 16)
        at = b.find(b"PK\x07\x08", at + 4)
    return found


def _zip_entry(b: bytes, pos: int, known: dict) -> int | None:
    """Place behind the entry at ``pos``; None if there is none or its length can't be told."""
    if b[pos : pos + 4] != b"PK\x03\x04" or pos + 30 > len(b):
        return None
    flags, _, _, _, _, packed, _, name, extra = struct.unpack_from("<HHHHIIIHH", b, pos + 6)
    data = pos + 30 + name + extra
    if not flags & 8:
        return data + packed
    if "descriptors" not in known:
        known["descriptors"] = _descriptors(b)
    return known["descriptors"].get(data)


def _zip_end(b: bytes, start: int) -> tuple[int, int, int] | None:
    """(entries, stated offset of the directory, end) of the central directory at ``start``."""
    pos, count = start, 0
    while b[pos : pos + 4] == b"PK\x01\x02" and pos + 46 <= len(b):
        name, extra, note = struct.unpack_from("<HHH", b, pos + 28)
        pos, count = pos + 46 + name + extra + note, count + 1
    if b[pos : pos + 4] != b"PK\x05\x06" or pos + 22 > len(b):
        return None
    total, size, offset, note = struct.unpack_from("<HIIH", b, pos + 10)
    if total != count or size != pos - start or pos + 22 + note > len(b):
        return None
    return count, offset, pos + 22 + note


def _zip(b: bytes, at: int, known: dict) -> tuple[str, int] | None:
    """Entries up to a central directory that names the first one's place; chains with the same end are walked once."""
    walked, pos = [], at
    while pos not in known and (after := _zip_entry(b, pos, known)) is not None:
        walked.append(pos)
        pos = after
    if pos not in known:
        known[pos] = pos, _zip_end(b, pos)
    known.update(dict.fromkeys(walked, known[pos]))
    start, end = known[pos]
    return ("application/zip", end[2] - at) if end and end[1] == start - at else None


_PDF_HEAD = re.compile(rb"%PDF-\d\.\d[\r\n]")
_PDF_END = re.compile(rb"startxref\s++\d++\s++%%EOF")


def _pdf(b: bytes, at: int, known: dict) -> tuple[str, int] | None:
    """Up to the last end mark before the next file's header: updates are appended behind the first end mark."""
    if not _PDF_HEAD.match(b, at):
        return None
    following = _PDF_HEAD.search(b, at + 5)
    last = None
    for last in _PDF_END.finditer(b, at, following.start() if following else len(b)):
        pass
    return ("application/pdf", last.end() - at) if last else None


def _ogg(b: bytes, at: int, known: dict) -> tuple[str, int] | None:
    """Pages up to one marked as the last; a page that an earlier walk passed begins no file."""
    pos, end, walked, begun = at, None, [], at in known
    while pos not in known and b[pos : pos + 4] == b"OggS" and pos + 27 <= len(b) and b[pos + 4] == 0:
        walked.append(pos)
        n, last = b[pos + 26], b[pos + 5] & 4
        pos += 27 + n + sum(b[pos + 27 : pos + 27 + n])
        if last:
            end = pos if pos <= len(b) else None
            break
    else:
        end = known.get(pos)
    known.update(dict.fromkeys(walked, end))
    return ("audio/ogg", end - at) if end and not begun else None


def _flac(b: bytes, at: int, known: dict) -> tuple[str, int] | None:
    """Metadata blocks state their lengths; frames don't, so it runs to the end."""
    pos, first = at + 4, True
    while pos + 4 <= len(b):
        kind, size = b[pos], int.from_bytes(b[pos + 1 : pos + 4], "big")
        if first and (kind & 0x7F or size != 34) or pos + 4 + size > len(b):
            return None
        pos, first = pos + 4 + size, False
        if kind & 0x80:
            return ("audio/flac", len(b) - at) if b[pos : pos + 1] in (b"", b"\xff") else None
    return None


CHECKS = {
    "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "riff": _riff, "application/gzip": _gzip,
    "application/zip": _zip, "application/pdf": _pdf, "audio/ogg": _ogg, "audio/flac": _flac,
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


def sniff(blob: bytes, machine: ahocorasick.Automaton) -> tuple[int, list[tuple[str, int, int, int]]]:
    """(magic hits, confirmed items as (type, offset, length, depth) by offset)."""
    hits, items, around, known = 0, [], [], {kind: {} for kind in CHECKS}  # places walked, so that none is twice
    for last, (size, kind) in machine.iter(blob.decode("latin-1")):
        at, hits = last - size + 1, hits + 1
        if found := CHECKS[kind](blob, at, known[kind]):
            while around and around[-1] <= at:
                around.pop()
            items.append((found[0], at, found[1], len(around)))
            around.append(at + found[1])
    return hits, items


def wav(samples: bytes, rate: int = 8000) -> bytes:
    """``samples`` as 8-bit mono PCM."""
    pad = len(samples) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * pad


def samples_of(blob: bytes, at: int = 0) -> bytes:
    """The samples of the WAV that starts at ``at``."""
    _, chunks = _riff_chunks(blob, at)
    start, size = chunks[b"data"]
    return blob[start : start + size]


def sniff_media(media: DataFrame, id_col: str, blob_col: str, declared_col: str) -> DataFrame:
    """Per row: id, declared type, detected type, whether that corrects it, hits, items."""
    schema = pa.schema([
        ("id", pa.int64()), ("declared", pa.string()), ("detected", pa.string()), ("corrected", pa.bool_()), ("n_hits", pa.int64()),
        ("items", pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("depth", pa.int32())]))),
    ])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for key, blob, declared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hits, items = (0, []) if blob is None else sniff(blob, machine)
                real = items[0][0] if items and items[0][1] == 0 else (UNKNOWN if blob is not None else declared)
                row = (key, declared, real, real != declared, hits, [dict(zip(("type", "offset", "length", "depth"), x, strict=True)) for x in items])
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
            yield batch_of(schema, out)

    picked = media.select(F.col(id_col).cast("long").alias("id"), F.col(blob_col).cast("binary").alias("blob"), F.col(declared_col).cast("string").alias("declared"))
    kinds = "id long, declared string, detected string, corrected boolean, n_hits long, items array<struct<type:string,offset:bigint,length:bigint,depth:int>>"
    return picked.mapInArrow(each, kinds)


def carve_media(media: DataFrame, id_col: str, blob_col: str, declared_col: str) -> DataFrame:
    """One row per embedded item: id, type, offset, length, depth, its bytes."""
    found = sniff_media(media, id_col, blob_col, declared_col).select("id", F.explode("items").alias("item"))
    blobs = media.select(F.col(id_col).cast("long").alias("id"), F.col(blob_col).cast("binary").alias("blob"))
    return found.join(blobs, "id").select(
        "id", "item.*", F.expr("substring(blob, cast(item.offset + 1 as int), cast(item.length as int))").alias("bytes")
    )


_STORED = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("detected", pa.string()), ("corrected", pa.bool_()),
])


def store_and_sniff(docs: DataFrame, block: int = 64) -> DataFrame:
    """Each text's padded bytes stored as a WAV of 8-bit samples and read back.

    The stored blob is declared ``application/octet-stream``; the sniffer must
    find the WAV at offset 0 and the samples are read from the confirmed data
    chunk. ``feature`` lists the hits and all confirmed items, so media inside a
    text shows. Null text: as an empty one (one block of zeros).
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _STORED}
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = raw.as_py() or b""
                blob = wav(raw + b"\0" * (max(1, -(-len(raw) // block)) * block - len(raw)))
                hits, items = sniff(blob, machine)
                if not items or items[0][:3] != ("audio/wav", 0, len(blob)):
                    raise ValueError(f"document {key}: the stored form was not recognised")
                payload = samples_of(blob)
                feature = f"{UNKNOWN}>{items[0][0]};hits={hits};" + ",".join(f"{k}@{o}+{n}/{d}" for k, o, n, d in items)
                row = (key, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-block:]), len(blob),
                       hashlib.sha256(blob).hexdigest(), feature, items[0][0], items[0][0] != UNKNOWN)
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
            yield batch_of(_STORED, out)

    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, detected string, corrected boolean"
    return id_and_bytes(docs).mapInArrow(each, kinds)
