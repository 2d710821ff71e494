"""Media sniffing, packing and BPE: against the libraries and by hand."""

import hashlib
import io
import random
import struct
import time
import wave
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestrata.llm import bpe_chunks, media, packing

SCHEMA = "doc_id long, text string, score string, n_tokens int"
ODD = [
    (1, None, "x", 1), (2, "", "x", 2), (3, "Plain words, twice. Plain words, twice.", None, None), (None, "no id here", "y", 0),
    (4, "é" * 3000 + " <|endoftext|> it's 42! \t\n \r x", "z", 5), (4, "é" * 3000 + " <|endoftext|> it's 42! \t\n \r x", "z", 5), (5, "w" * 70000, "z", 5),
    (6, "don't stop İstanbul Σas ́b ﬁ 日本語 👍🏽 ... !!", "", 6),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def png() -> bytes:
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def gif() -> bytes:
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x4c\x01\x00\x3b"


def zipped() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
        z.writestr("b.txt", "world")
    return out.getvalue()


JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x05abc\xff\xda\x00\x04ab\x12\xff\x00\x34\xff\xd0\x56\xff\xd9"
BMP = b"BM" + struct.pack("<IIII", 62, 0, 58, 40) + bytes(44)
GZIP = zlib.compressobj(9, zlib.DEFLATED, 31)
GZIP = GZIP.compress(b"packed") + GZIP.flush()
PDF = b"%PDF-1.4\nbody\nstartxref\n9\n%%EOF"
OGG = b"OggS\0\2" + bytes(20) + b"\1\3abc" + b"OggS\0\4" + bytes(20) + b"\1\2de"
KINDS = {"image/png": png(), "image/gif": gif(), "image/jpeg": JPEG, "image/bmp": BMP, "application/gzip": GZIP, "application/zip": zipped(), "application/pdf": PDF, "audio/ogg": OGG, "audio/wav": media.wav(b"abcd")}


@pytest.mark.parametrize("kind", KINDS)
def test_validators_find_type_and_length(kind):
    machine, blob = media.automaton(), KINDS[kind]
    assert (kind, 0, len(blob), 0) in media.sniff(blob, machine)[1]
    assert (kind, 7, len(blob), 0) in media.sniff(b"leading" + blob + b"after", machine)[1]
    for cut in (len(blob) // 2, len(blob) - 1):
        assert not [x for x in media.sniff(blob[:cut], machine)[1] if x[0] == kind and x[1] == 0]


class Unseekable(io.RawIOBase):
    """A target that makes the library write data descriptors."""

    def __init__(self):
        self.data = b""

    def writable(self):
        return True

    def write(self, data):
        self.data += bytes(data)
        return len(data)


def test_archives_with_descriptors_and_archives_inside_archives():
    machine, out = media.automaton(), Unseekable()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "hello " * 50)
        z.writestr("b.txt", "")
    assert out.data[6] & 8
    assert media.sniff(b"xx" + out.data + b"yy", machine)[1] == [("application/zip", 2, len(out.data), 0)]
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("first.txt", "1")
        z.writestr("inner.zip", zipped())
        z.writestr("streamed.zip", out.data)
    blob = outer.getvalue()
    want = [("application/zip", 0, len(blob), 0), ("application/zip", blob.index(zipped()), len(zipped()), 1), ("application/zip", blob.index(out.data), len(out.data), 1)]
    assert media.sniff(blob, machine)[1] == want
    assert media.sniff(b"PK\3\4 no archive" + zipped(), machine)[1] == [("application/zip", 15, len(zipped()), 0)]


def test_updated_documents_run_to_their_last_end_mark():
    machine = media.automaton()
    updated = PDF + b"\nnew objects\nstartxref\n77\n%%EOF"
    assert media.sniff(b"x" + updated + b" tail " + PDF, machine)[1] == [("application/pdf", 1, len(updated), 0), ("application/pdf", len(updated) + 7, len(PDF), 0)]
    assert media.sniff(b"%PDF-1.4\nstartxref\nnone\n%%EOF", machine)[1] == []


def test_pages_of_one_stream_are_one_item():
    machine = media.automaton()
    assert media.sniff(OGG + OGG, machine)[1] == [("audio/ogg", 0, len(OGG), 0), ("audio/ogg", len(OGG), len(OGG), 0)]
    assert media.sniff(OGG[:31] * 3, machine)[1] == []


@pytest.mark.parametrize("piece", [b"%PDF-1.4\n startxref ", b"PK\3\4" + bytes(26), b"PK\3\4\0\0\x08" + bytes(23), b"OggS\0\0" + bytes(21), b"PK\3\4" + bytes(26) + b"PK\1\2" + bytes(42), b"startxref \n %PDF-1.4 "])
def test_hostile_repeats_take_linear_time(piece):
    machine, seconds = media.automaton(), []
    for n in (20_000, 80_000):
        start = time.process_time()
        hits, _ = media.sniff(piece * n, machine)
        seconds.append(time.process_time() - start)
        assert hits >= n
    assert seconds[1] < 10 * seconds[0] + 0.5


def test_declared_types_are_corrected_and_media_carved(spark):
    rows = [(1, png(), "image/jpeg"), (2, media.wav(b"xx" + png() + b"yyy"), "audio/wav"), (3, b"nothing", "image/png"), (4, None, "text/plain"), (5, b"", None)]
    df = spark.createDataFrame(rows, "id long, blob binary, declared string")
    got = {r.id: r for r in media.sniff_media(df, "id", "blob", "declared").collect()}
    assert (got[1].detected, got[1].corrected) == ("image/png", True)
    assert (got[2].detected, got[2].corrected) == ("audio/wav", False)
    assert [(x.type, x.depth) for x in got[2]["items"]] == [("audio/wav", 0), ("image/png", 1)]
    assert (got[3].detected, got[3].corrected) == (media.UNKNOWN, True)
    assert (got[4].detected, got[4].n_hits) == ("text/plain", 0)
    assert got[5].detected == media.UNKNOWN
    carved = {(r.id, r.type): bytes(r.bytes) for r in media.carve_media(df, "id", "blob", "declared").collect()}
    assert carved[2, "image/png"] == png()


def test_stored_texts_read_back(docs):
    for r, want in zip(media.store_and_sniff(docs).collect(), ODD, strict=True):
        raw = (want[1] or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (want[0], len(raw), len(padded))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        with wave.open(io.BytesIO(media.wav(padded))) as w:
            assert w.readframes(w.getnframes()) == padded
        assert (r.media_bytes, r.media_sha256) == (len(media.wav(padded)), hashlib.sha256(media.wav(padded)).hexdigest())
    assert media.store_and_sniff(docs.limit(0)).count() == 0


def noise(seed: int, pieces: list[str], most: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice(pieces) for _ in range(draw.randint(0, most))) for _ in range(400)]


PIECES = ["a", "b", " ", "  ", "\n", "'s", "'re", "é", "1", "<|endoftext|>", "!", "日本", " ", "\t", "don't", "  x y z", "<|endof", "text|>", "'", "r", "e", " word", " Word, ", "́", "Σ", "İ", "...", "\x1c", "ﬁ"]


def test_chunked_encoding_equals_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tool, library = bpe_chunks.ChunkCodec(path), Tokenizer.from_file(path)
    shared = noise(1, PIECES, 300)
    texts = shared + [a + " and then " + b for a, b in zip(shared, shared[1:], strict=False)]
    for k in range(0, len(texts), 100):
        for text, ids in zip(texts[k : k + 100], tool.encode([t.encode() for t in texts[k : k + 100]]), strict=True):
            want = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, dtype="<u4").tolist() == want
            assert tool.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_chunks_are_cut_alike_in_different_texts():
    passage = " ".join(f"word{k} other{k * 7 % 13}" for k in range(3000)).encode()

    def cut(raw):
        data = np.frombuffer(raw, dtype=np.uint8)
        at = bpe_chunks.chunk_bounds(data, bpe_chunks.agreed_cuts(data))
        return {raw[a:b] for a, b in zip(at, at[1:], strict=False)}

    one, two = cut(b"Some lead. " + passage + b" tail"), cut(b"Another, longer lead " * 9 + passage)
    assert sum(len(p) for p in one & two) > 0.8 * len(passage) and len(one) > 20


def test_chunk_joins_are_repaired(monkeypatch):
    """With very short chunks most words at joins are cut; the library's ids come out all the same, mostly without encoding a text whole."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(bpe_chunks, "CHUNK_BITS", 5)
    monkeypatch.setattr(bpe_chunks.chunk_ends, "__defaults__", (5,))
    tool, library = bpe_chunks.ChunkCodec(path), Tokenizer.from_file(path)
    draw = random.Random(9)
    texts = [" ".join(draw.choice(["straightforward", "don't", "naïve", "x" * 30, "日本", "<|endoftext|>", "1234567", "a", "  b", "c\n"]) for _ in range(400)) for _ in range(30)]
    whole = []
    encode = tool.tokenizer.encode
    class Spy:
        def __getattr__(self, name):
            return getattr(library, name)
        def encode(self, *a, **k):
            whole.append(1)
            return encode(*a, **k)
    tool.tokenizer = Spy()
    for text, ids in zip(texts, tool.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    data = [np.frombuffer(t.encode(), dtype=np.uint8) for t in texts]
    assert sum(len(bpe_chunks.chunk_bounds(d, bpe_chunks.agreed_cuts(d))) - 2 for d in data) > 300
    assert len(whole) <= 3


def test_disagreeing_joins_are_encoded_whole(monkeypatch):
    """Where the cuts were no boundaries of pre-tokens, agreement fails and the text is encoded whole."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    tool, library = bpe_chunks.ChunkCodec(path), Tokenizer.from_file(path)
    monkeypatch.setattr(bpe_chunks, "agreed_cuts", lambda data: np.arange(4, len(data) - 4, 5))
    text = " ".join(f"unbelievable{k}" for k in range(2000))
    assert np.frombuffer(tool.encode([text.encode()])[0], dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_other_tokenizer_files_are_not_cut():
    path = public_tokenizers.path("word_bpe_49k.json")
    tool, library = bpe_chunks.ChunkCodec(path), Tokenizer.from_file(path)
    text = "Some words, and more of them. " * 300
    ids = library.encode(text, add_special_tokens=False).ids
    assert not tool.cuttable and np.frombuffer(tool.encode([text.encode()])[0], dtype="<u4").tolist() == ids
    assert tool.decode(np.array(ids, dtype="<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_encoding_query_on_odd_rows(docs, spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r, want in zip(bpe_chunks.encode_and_decode(docs, path).collect(), ODD, strict=True):
        ids = library.encode(want[1] or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens) == (want[0], len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe_chunks.encode_documents(docs, path)
    back = bpe_chunks.decode_documents(encoded, path).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((d or 0, t or "") for d, t, *_ in ODD)
    assert bpe_chunks.encode_and_decode(docs.limit(0), path).count() == 0


def test_word_encoding_equals_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    tool, library = packing.WordCodec(path), Tokenizer.from_file(path)
    texts = noise(2, [*PIECES, "B", ".", ",", "word. ", "WORD ", "<|startoftext|>", "ÅNGSTRÖM", "Ŀ ", "it's", "'LL", "!'s", "x'", "'9", "a-b", "_x_1", "(B)", "mail9.ex@am.org", "=\u0338", "e\u0301!", "\u2019s"], 200)
    assert tool.encode([]) == [] and tool.encode([b"", b" \n"]) == [b"", b""]
    for text, ids in zip(texts, tool.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def check_packing(rows, capacity):
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_packing_query(docs, spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path).collect()
    want = []
    for doc_id, text, *_ in ODD:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[start : start + 4096], dtype="<u4")
            want.append((doc_id or 0, piece, start, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    check_packing(rows, 4096)
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_packing_needs_hardly_more_than_the_least(spark):
    draw = random.Random(5)
    lengths = [min(4096, int(draw.lognormvariate(6.5, 1.2)) + 1) for _ in range(20000)]
    df = spark.createDataFrame([(k, 0, n) for k, n in enumerate(lengths)], "doc_id long, piece int, length long").withColumns({"start": F.lit(0), "ids_crc32": F.lit(0)})
    used = check_packing(packing.pack(df, group_pieces=5000).collect(), 4096)
    assert used <= 1.01 * sum(lengths) / 4096 + 4


def brute_choice(lengths, capacity):
    """Every choice tried, the sum of squares counted anew each time; (gap left, opened) of every step."""
    gaps, opened, steps, least = [], 0, [], -(-sum(lengths) // capacity)
    energy = lambda some: sum(some.count(g) ** 2 for g in set(some) if g)
    for s in lengths:
        choices = []
        for gap in sorted({g for g in gaps if g >= s}):
            after = gaps.copy()
            after.remove(gap)
            choices.append((energy([*after, gap - s]), 0, gap, [*after, gap - s]))
        if opened < least or not choices:
            choices.append((energy([*gaps, capacity - s]), 1, capacity, [*gaps, capacity - s]))
        _, fresh, gap, gaps = min(choices, key=lambda c: c[:3])
        opened += fresh
        steps.append((gap, opened))
    return steps


@pytest.mark.parametrize("capacity", [10, 23])
def test_every_step_makes_the_sum_of_squares_smallest(capacity):
    draw = random.Random(capacity)
    for _ in range(60):
        lengths = [draw.randint(1, capacity) for _ in range(draw.randint(1, 40))]
        if draw.random() < 0.5:
            lengths.sort(reverse=True)
        sequence, offset = packing.sum_of_squares(np.array(lengths), capacity)
        opened = np.maximum.accumulate(sequence) + 1
        assert [(capacity - o, n) for o, n in zip(offset.tolist(), opened.tolist(), strict=True)] == brute_choice(lengths, capacity)


def test_large_ids_stay_whole_beside_nulls(spark):
    ids = [2**53 + 1, 2**53 + 3, None, 2**63 - 1, None]
    df = spark.createDataFrame([(d, 0, 5) for d in ids], "doc_id long, piece int, length long").withColumns({"start": F.lit(0).cast("long"), "ids_crc32": F.lit(0).cast("long")})
    assert sorted((r.doc_id or 0) for r in packing.pack(df).collect()) == sorted(d or 0 for d in ids)
