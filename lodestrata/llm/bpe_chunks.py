"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes picks chunk ends from content alone, so a passage
that many documents share is cut alike in all of them and its chunks are encoded
once per worker process, each as a whole and by the library. What a chunk's ids are near its ends depends on what
stands beyond them, so every join of two chunks is repaired: the window from REACH *cuts* before the join to REACH cuts behind
it is encoded, too, and its ids must agree with those of both chunks, token by token, between its outermost two
cuts on either side. Then the chunk's ids are taken up to the inner cut, the window's from there on.
Where they do not agree the window is made GROWTH times longer, and at last the whole text is encoded.

A cut is the place of a single space between two visible characters. No alternative of the byte-level pattern runs from a visible
character into a space, none looks behind, and no special token holds a space, so it is a pre-token boundary
whatever stands around it. This holds for byte-level tokenizers of the usual pattern only; the file is checked for that, and with any other
file every text is encoded whole. A chunk end that hasn't enough cuts on both sides is passed over.

Memory: the cache of chunks and windows is emptied whenever it is full; that
changes speed only. Defined cases: a null text is as an empty one (no ids); invalid bytes count as replacement characters; repeated rows
and rows with a null id are encoded each; an empty table gives an empty one; texts of any length are encoded whole. Only the id and the text
are read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, id_and_bytes, resident

CACHE_BYTES = 64 << 20
#: A chunk ends where so many low bits of the rolling hash are 0: 1024 bytes on average.
CHUNK_BITS = 10
WINDOW = 16
#: Cuts that the window over a join reaches to on each side, and how much farther it reaches where that gives no agreement.
REACH, GROWTH = 2, 4

_GEAR = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)
_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[33:127] = True
#: First byte of the letters from U+00C0 to U+00FF (and two signs), all visible.
_LATIN = 0xC3


def chunk_ends(data: np.ndarray, bits: int = CHUNK_BITS) -> np.ndarray:
    """Positions where a chunk ends: the hash of the WINDOW bytes before them is 0 in its low bits."""
    h = _GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1


def agreed_cuts(data: np.ndarray) -> np.ndarray:
    """Positions of a space between two visible characters (ASCII or U+00C0 to U+00FF)."""
    space = np.flatnonzero(data == 0x20)
    space = space[(space > 0) & (space < len(data) - 1)]
    before, after = data[space - 1], data[space + 1]
    latin = (data[space - 2] == _LATIN) & (space > 1)  # place -1 of a short text doesn't count
    return space[(_VISIBLE[before] | latin) & (_VISIBLE[after] | (after == _LATIN))]


def chunk_bounds(data: np.ndarray, cuts: np.ndarray) -> list[int]:
    """0, the chunk ends inside one text that have 2 REACH cuts on both sides of their own, and its length."""
    n = len(data)
    if len(cuts) < 4 * REACH:
        return [0, n]
    ends = chunk_ends(data)
    ends = ends[(ends >= WINDOW) & (ends < n - 2)]
    ends = ends[(data[ends] & 0xC0) != 0x80]  # between characters
    before = np.searchsorted(cuts, ends - 3, side="right")  # cuts with both neighbours before the end
    after = np.searchsorted(cuts, ends + 3)  # first cut with both neighbours behind it
    out, held = [0], 0
    for end, low, high in zip(ends.tolist(), before.tolist(), after.tolist(), strict=True):
        if low - held >= 2 * REACH and len(cuts) - high >= 2 * REACH:
            out.append(end)
            held = high
    return [*out, n]


class ChunkCodec:
    """Encoder and decoder of one tokenizer file, with its cache."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cuttable = has_cuts(spec)
        self.pieces = token_bytes(spec) if self.cuttable else []
        self.lengths = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.known: dict[bytes, np.ndarray] = {}
        self.held = 0

    def learn(self, parts: set[bytes]) -> None:
        """Encode the ``parts`` that aren't known."""
        new = [p for p in parts if p not in self.known]
        for start in range(0, len(new), 4096):
            some = new[start : start + 4096]
            for p, found in zip(some, self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False), strict=True):
                self.known[p] = ids = np.array(found.ids, dtype="<u4")
                self.held += len(p) + ids.nbytes + 250

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Where each token starts, in bytes, and where the last one ends."""
        return np.append(0, np.cumsum(self.lengths[ids]))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
        texts = [raw.decode("utf-8", "replace").encode() for raw in texts]
        data = [np.frombuffer(raw, dtype=np.uint8) for raw in texts]
        cuts = [agreed_cuts(d) if self.cuttable else np.zeros(0, dtype=np.int64) for d in data]
        bounds = [chunk_bounds(d, c) for d, c in zip(data, cuts, strict=True)]
        chunks = [[raw[a:b] for a, b in zip(at, at[1:], strict=False)] for raw, at in zip(texts, bounds, strict=True)]
        reach = [[REACH] * (len(at) - 2) for at in bounds]
        windows = [[self.window(c, at, k, REACH) for k in range(1, len(at) - 1)] for c, at in zip(cuts, bounds, strict=True)]
        self.learn({raw[w[0] : w[-1]] for raw, of in zip(texts, windows, strict=True) for w in of}.union(*chunks))
        out = []
        for k, raw in enumerate(texts):
            joined = self.joined(raw, cuts[k], bounds[k], chunks[k], windows[k], reach[k])
            if joined is None:
                joined = np.array(self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids, dtype="<u4")
            out.append(joined.tobytes())
        return out

    @staticmethod
    def window(cuts: np.ndarray, at: list[int], k: int, reach: int) -> tuple[int, int, int, int] | None:
        """(outer cut, inner cut, inner cut, outer cut) around the k-th bound; None if a chunk hasn't so many."""
        low, high = int(np.searchsorted(cuts, at[k] - 3, side="right")), int(np.searchsorted(cuts, at[k] + 3))
        first, last = int(np.searchsorted(cuts, at[k - 1] + 3)), int(np.searchsorted(cuts, at[k + 1] - 3, side="right"))
        if low - reach < first or high + reach > last:
            return None
        return int(cuts[low - reach]), int(cuts[low - 1]), int(cuts[high]), int(cuts[high + reach - 1])

    def joined(self, raw: bytes, cuts: np.ndarray, at: list[int], chunks: list[bytes], windows: list[tuple], reach: list[int]) -> np.ndarray | None:
        """The ids of a text from its chunks' and windows', or None if some join never agrees."""
        parts, from_token = [], 0
        ids = self.known[chunks[0]]
        if len(chunks) == 1:
            return ids
        place = self.places(ids)
        for k in range(1, len(at) - 1):
            after = self.known[chunks[k]]
            after_place = self.places(after)
            window, wide = windows[k - 1], reach[k - 1]
            while True:
                if window is None:
                    return None
                found = self.agreement(raw, window, ids, place, at[k - 1], after, after_place, at[k])
                if found:
                    break
                wide *= GROWTH
                window = self.window(cuts, at, k, wide)
            to_token, between, next_token = found
            if to_token < from_token:
                return None  # the windows of two joins overlap
            parts += [ids[from_token:to_token], between]
            ids, place, from_token = after, after_place, next_token
        return np.concatenate([*parts, ids[from_token:]])

    def agreement(self, raw: bytes, window: tuple, ids: np.ndarray, place: np.ndarray, start: int, after: np.ndarray, after_place: np.ndarray, join: int) -> tuple[int, np.ndarray, int] | None:
        """(tokens of the chunk before the window's inner part, that part's ids, first token of the next chunk behind it)."""
        outer, inner, next_inner, next_outer = window
        self.learn({raw[outer:next_outer]})
        own = self.known[raw[outer:next_outer]]
        own_place = self.places(own)

        def between(where: np.ndarray, low: int, high: int) -> tuple[int, int] | None:
            a, b = np.searchsorted(where, (low, high)).tolist()
            return (a, b) if b < len(where) and where[a] == low and where[b] == high else None

        left, own_left = between(place, outer - start, inner - start), between(own_place, 0, inner - outer)
        right, own_right = between(after_place, next_inner - join, next_outer - join), between(own_place, next_inner - outer, next_outer - outer)
        if None in (left, own_left, right, own_right):
            return None
        if not np.array_equal(ids[slice(*left)], own[slice(*own_left)]) or not np.array_equal(after[slice(*right)], own[slice(*own_right)]):
            return None
        return left[1], own[own_left[1] : own_right[0]], right[0]

    def decode(self, ids: bytes) -> str:
        """As the library's decode with special tokens kept."""
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        if not self.cuttable:
            return self.tokenizer.decode(numbers, skip_special_tokens=False)
        pieces = self.pieces
        return b"".join([pieces[i] for i in numbers]).decode("utf-8", "replace")


def has_cuts(spec: dict) -> bool:
    """Whether a tokenizer file is of the kind whose pre-tokens always end before a space between visible characters."""
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor")
    whole = model.get("type", "BPE") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not model.get("byte_fallback")
    decoded = (spec.get("decoder") or {}).get("type") == "ByteLevel"
    return plain and whole and decoded and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])


def token_bytes(spec: dict) -> list[bytes]:
    """The bytes of each id under byte-level spelling: printable bytes stand for
    themselves and the others, in order, for the code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelt = {chr(b): b for b in plain}
    spelt |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    vocab = dict(spec["model"]["vocab"])
    out = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
    for token, i in vocab.items():
        out[i] = bytes(spelt[c] for c in token)
    for token in spec["added_tokens"]:
        out[token["id"]] = token["content"].encode()
    return out


def codec(path: str) -> ChunkCodec:
    """One codec per worker process; its caches serve all tasks of the worker."""
    return resident(("chunks", path), lambda: ChunkCodec(path))


def slices(batch: pa.RecordBatch, most: int = 4 << 20, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each part take about ``most`` bytes."""
    sizes = np.cumsum(_lengths(batch.column(column)))
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) with the ids as an array column."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(tokenizer_path)
        for batch in (part for whole in batches for part in slices(whole)):
            found = tool.encode([x or b"" for x in batch.column(1).to_pylist()])
            yield batch_of(schema, {"doc_id": batch.column(0).to_pylist(), "ids": [np.frombuffer(x, dtype="<u4").astype(np.int64) for x in found]})

    return id_and_bytes(docs, id_col, text_col).mapInArrow(each, "doc_id long, ids array<bigint>")


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(tokenizer_path)
        for batch in batches:
            texts = [tool.decode(np.array(ids or [], dtype="<u4").tobytes()) for ids in batch.column(1).to_pylist()]
            yield batch_of(schema, {"doc_id": batch.column(0).to_pylist(), "text": texts})

    return encoded.select("doc_id", "ids").mapInArrow(each, "doc_id long, text string")


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_and_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Digests of each whole text's ids and of the text decoded from them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(tokenizer_path)
        for batch in (part for whole in batches for part in slices(whole)):
            found = tool.encode([x or b"" for x in batch.column(1).to_pylist()])
            yield batch_of(_DIGEST, {
                "doc_id": batch.column(0).to_pylist(),
                "n_tokens": [len(x) // 4 for x in found],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in found],
                "decoded_sha256": [hashlib.sha256(tool.decode(x).encode()).hexdigest() for x in found],
            })

    return id_and_bytes(docs).mapInArrow(each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
