"""Best-fit packing by sums of squares.

Documents are tokenised and cut into pieces of at most one sequence. Pieces are
dealt at random into packing groups of about ``GROUP_PIECES`` pieces (as many
groups as the input needs), and each group packs its pieces, longest first. A
group keeps N[g], the number of its open sequences with g free places; a piece
of length s goes to the open sequence whose gap g >= s makes the sum of all N[g]^2
smallest (a closed sequence has no gap and counts nothing). A new sequence is one of the choices while there are
fewer than the pieces need in any case (their tokens over the capacity); from then on one is opened only if no open one has room.

Defined cases: a null text is an empty one and yields the end token alone; ties
of the sum go to the smallest gap, and to an open sequence before a new one; equal lengths are packed by
(doc_id, piece), null ids last. Repeated rows are packed one by one. Rows with a null id are packed like all others. A text of
any length is cut into pieces; an empty table packs into an empty one. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_chunks import slices
from .common import batch_of, id_and_bytes, materialize, resident
from .units import UnitCache, parted

CAPACITY = 4096
END_ID = 1
#: Pieces that one group packs; bounds a task's memory at any input size.
GROUP_PIECES = 16384


class WordCodec(UnitCache):
    """Encoder for a tokenizer that drops white space and never joins across it.

    The text's white-space-parted words, parted again between ASCII letters or digits and marks, are encoded apart, each once. Words of
    letters are in lower case and composed already, so the light tokenizer needs
    the byte-level spelling only; the vocabulary marks the ends of words.
    """

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer, pre_tokenizers

        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends_unit = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends_unit[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith(suffix)]] = True
        self.light = Tokenizer(self.tokenizer.model)
        self.light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def encode_plain(self, words: list[bytes]) -> list[bytes]:
        ids = np.array(self.light.encode_batch_fast([b" ".join(words).decode().lower()], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (np.flatnonzero(self.ends_unit[ids]) + 1) * 4
        packed = ids.tobytes()
        return [packed[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        # Lower case comes before all else in the tokenizer, but for special tokens ("<|...|>").
        split = [raw.split() if b"<|" in raw else words for raw, words in zip(texts, parted(texts), strict=True)]
        found = [list(map(self.known.get, words)) for words in split]
        holes = [[k for k, ids in enumerate(some) if ids is None] for some in found]
        self.learn({words[k] for words, some in zip(split, holes, strict=True) for k in some})
        for words, some, missing in zip(split, found, holes, strict=True):
            for k in missing:
                some[k] = self.known[words[k]]
        return [b"".join(some) for some in found]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut to ``capacity``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = resident(("words", tokenizer_path), lambda: WordCodec(tokenizer_path))
        end, width = np.array([END_ID], dtype="<u4").tobytes(), 4 * capacity
        for batch in (part for whole in batches for part in slices(whole)):
            out: dict[str, list] = {f.name: [] for f in _PIECES}
            for key, ids in zip(batch.column(0).to_pylist(), tool.encode([x or b"" for x in batch.column(1).to_pylist()]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), width)):
                    some = ids[at : at + width]
                    for name, value in zip(out, (key, k, at // 4, len(some) // 4, zlib.crc32(some)), strict=True):
                        out[name].append(value)
            yield batch_of(_PIECES, out)

    return id_and_bytes(docs).mapInArrow(each, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, taken in the given order."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, dtype=np.int64)  # count[0] stays 0: closed sequences don't count
    sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    opened, least = 0, -(-int(lengths.sum()) // capacity)
    for k, s in enumerate(lengths.tolist()):
        fits = np.flatnonzero(count[s:])  # gaps less s, that is the gaps that would be left
        best = None
        if len(fits):
            # N[g] falls by one, N[g - s] grows by one unless the sequence is closed
            change = 2 * (count[fits] - count[fits + s]) + np.where(fits > 0, 2, 1)
            best = int(np.argmin(change))
        fresh = 2 * count[capacity - s] + 1 if s < capacity else 0
        if best is not None and (change[best] <= fresh or opened >= least):
            rest = int(fits[best])
            gap = rest + s
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            b, gap, opened = opened, capacity, opened + 1
            rest = capacity - s
        sequence[k], offset[k] = b, capacity - gap
        if rest:
            open_bins[rest].append(b)
            count[rest] += 1
    return sequence, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with ``sequence_id`` and ``offset``."""
    groups = max(1, -(-pieces.count() // group_pieces))

    names = pieces.columns

    def each(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sequence, offset = sum_of_squares(group.column("length").to_numpy(), capacity)
        number = group.column("pack_group").to_numpy() * (1 << 32) + sequence
        return group.select(names).append_column("sequence_id", pa.array(number, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(groups)))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("pack_group").applyInArrow(each, kinds)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(materialize(token_pieces(docs, tokenizer_path, capacity)), capacity)
