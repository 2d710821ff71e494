"""Language ID: n-gram filters that answer with a bitmask of languages.

Letter n-grams (3 and 4 characters, word borders included) of the training rows
are counted per language over the whole corpus. All of them enter a bit-sliced Bloom filter, each under
the languages in which it is as common as it should be: its share there is at least a ``NOISE``-th
of its largest share in any language (a foreign word in a text does not teach its language). Every cell of the filter
holds one bit per language, insertion sets the language's bit in HASHES cells, and the AND of a query's cells is the
mask of all languages that (may) contain it. A text's score for a language is the popcount of that language's
bit over its n-grams, corrected for the share f of false answers that the fill of the language's
slice predicts: (hits - f n) / (1 - f). The highest one decides.

Bounds: the filter has CELLS_PER_GRAM cells for every distinct n-gram, between CELLS and MOST_CELLS. Beyond
that it fills up further, which the correction for false answers accounts for; no n-gram is left out. The
executors set the bits; one bitmap per language, whose size the cells fix, comes to the driver and goes out again.

Defined cases: a null text or one without letters is ``und`` with score 0; so is
every text if no language was learned. A text with letters but no known n-gram
gets the language with most training n-grams, score 0. Ties go to the language
first in alphabetical order. Repeated rows are counted and predicted each; rows with a null id are
neither held out nor learnt from; an empty table gives an empty one; texts of any length are read whole, in
batches. Only ``doc_id``, ``text`` and ``lang`` are read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe_chunks import slices
from .common import batch_of, free, id_and_bytes, id_remainder, materialize, small_batches

SIZES = (3, 4)
#: How many times rarer than in the language where it is commonest an n-gram may be to count for a language.
NOISE = 50
CELLS_PER_GRAM = 16
CELLS, MOST_CELLS = 1 << 20, 1 << 26
HASHES = 3
UNDETERMINED = "und"

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)
    return _letters


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hashes, index of the text each belongs to), all texts in one pass."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "replace"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts) + 1), [1, *(len(t) + 1 for t in lowered)]) - 1
    letter = letter_table()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of the characters that part two words stays, as the border
    keep[0] = True
    z = np.where(letter, codes, 0)[keep].astype(np.uint64)
    owner = owner[keep]
    found, owners = [], []
    for n in SIZES:
        m = len(z) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, dtype=np.uint64)
        inner = np.ones(m, dtype=bool)
        for k in range(n):
            part = z[k : k + m]
            h = (h + part) * _MULTIPLIER
            h ^= h >> np.uint64(32)
            if 0 < k < n - 1:
                inner &= part != 0
        found.append(_mixed(h[inner]))
        owners.append(owner[1 : 1 + m][inner])
    if not found:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(found), np.concatenate(owners)


def places(h: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cells of each n-gram."""
    step = (h >> np.uint64(40)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64(cells - 1)).astype(np.int64) for k in range(HASHES)]


class MaskFilter:
    """Bloom filter whose answers are bitmasks of languages, 8 to a slice."""

    def __init__(self, languages: list[str], cells: int = CELLS):
        self.languages = languages
        self.cells = np.zeros((max(1, -(-len(languages) // 8)), cells), dtype=np.uint8)
        self.commonest = 0

    def insert(self, language: int, h: np.ndarray) -> None:
        bit = np.uint8(1 << language % 8)
        for at in places(h, self.cells.shape[1]):
            row = self.cells[language // 8]
            row[at] = row[at] | bit  # the same bit for all: repeated places are no loss

    def insert_bitmap(self, language: int, bitmap: np.ndarray) -> None:
        """Set the cells whose bits are set, lowest first."""
        self.cells[language // 8] |= np.unpackbits(bitmap, bitorder="little") << np.uint8(language % 8)

    def answer(self, h: np.ndarray) -> np.ndarray:
        """Masks, one row per 8 languages."""
        first, *more = places(h, self.cells.shape[1])
        out = self.cells[:, first]
        for at in more:
            out = out & self.cells[:, at]
        return out

    def holds(self, masks: np.ndarray, language: int) -> np.ndarray:
        return (masks[language // 8] >> np.uint8(language % 8)) & np.uint8(1)

    def false_share(self) -> np.ndarray:
        return np.array([self.holds(self.cells, k).mean() ** HASHES for k in range(len(self.languages))])

    def classify(self, texts: list[str], false: np.ndarray) -> tuple[list[str], list[float]]:
        h, owner = grams(texts)
        n = np.bincount(owner, minlength=len(texts)).astype(float)
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        masks = self.answer(h)
        scores = np.empty((len(self.languages), len(texts)))
        for k in range(len(self.languages)):
            hits = np.bincount(owner, weights=self.holds(masks, k), minlength=len(texts))
            scores[k] = np.maximum(0.0, (hits - false[k] * n) / (1 - false[k]) if false[k] < 1 else 0.0)
        best = scores.argmax(axis=0)
        top = scores.max(axis=0)
        best[top <= 0] = self.commonest
        share = np.clip(top / np.maximum(n, 1), 0.0, 1.0)
        return [self.languages[b] if c else UNDETERMINED for b, c in zip(best, n, strict=True)], share.tolist()


def count_grams(train: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of (lang, raw); each task adds up before the shuffle."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        keys, where = np.unique(keys, return_inverse=True)
        return keys, np.bincount(where, weights=counts, minlength=len(keys)).astype(np.int64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in (part for whole in batches for part in slices(whole, 2 << 20)):
            texts: dict[str, list[str]] = {}
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append((raw or b"").decode("utf-8", "replace"))
            for lang, some in texts.items():
                held.setdefault(lang, []).append(np.unique(grams(some)[0], return_counts=True))
                if len(held[lang]) >= 8:
                    held[lang] = [merged(held[lang])]
        for lang, parts in held.items():
            keys, counts = merged(parts)
            yield batch_of(schema, {"lang": [lang] * len(keys), "gram": keys.view(np.int64), "n": counts})

    parts = train.mapInArrow(each, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def filter_cells(grams_: int) -> int:
    """A power of two, so that equal places come from a mask."""
    return min(MOST_CELLS, max(CELLS, 1 << (CELLS_PER_GRAM * grams_ - 1).bit_length()))


def cell_bitmaps(counts: DataFrame, totals: DataFrame, cells: int, noise: float) -> DataFrame:
    """(lang, bucket, bitmap) of the cells that each language's n-grams set, 32,768 to a bucket."""
    shares = counts.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))
    best = shares.groupBy("gram").agg(F.max("share").alias("best"), F.collect_list(F.struct("lang", "share")).alias("of"))
    kept = best.select("gram", F.explode(F.filter("of", lambda x: x["share"] * noise >= F.col("best"))["lang"]).alias("lang"))
    schema = pa.schema([("lang", pa.string()), ("cell", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0)
            for at in places(batch.column(1).to_numpy().view(np.uint64), cells):
                yield pa.RecordBatch.from_arrays([lang, pa.array(at + 1)], schema=schema)

    placed = kept.select("lang", "gram").mapInArrow(each, "lang string, cell long")
    bucket, bit = F.expr("bitmap_bucket_number(cell)"), F.expr("bitmap_bit_position(cell)")
    return placed.select("lang", bucket.alias("bucket"), bit.alias("bit")).groupBy("lang", "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def learn(docs: DataFrame, chosen: Column, noise: float = NOISE) -> MaskFilter:
    """The filter of all rows that ``chosen`` admits and that have a language."""
    small_batches(docs.sparkSession)
    train = docs.where(chosen & F.col("lang").isNotNull()).select("lang", F.col("text").cast("binary").alias("raw"))
    counts = materialize(count_grams(train))
    totals = materialize(counts.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("grams")))
    named = {r["lang"]: r for r in totals.collect()}
    names = sorted(named)
    made = MaskFilter(names, filter_cells(max((r["grams"] for r in named.values()), default=0)))
    bitmaps = {k: np.zeros(made.cells.shape[1] // 8, dtype=np.uint8) for k in names}
    for r in cell_bitmaps(counts, totals, made.cells.shape[1], noise).toLocalIterator():
        bitmaps[r["lang"]][(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bitmap"], dtype=np.uint8)
    for k, name in enumerate(names):
        made.insert_bitmap(k, bitmaps[name])
    made.commonest = max(range(len(names)), key=lambda k: (named[names[k]]["total"], -k), default=0)
    free(counts, totals)
    return made


_RESULT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, model: MaskFilter) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = sent.value
        false = filters.false_share()
        for batch in (part for whole in batches for part in slices(whole, 2 << 20)):
            texts = [(x or b"").decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            named, score = filters.classify(texts, false)
            yield batch_of(_RESULT, {"doc_id": batch.column(0).to_pylist(), "lang_pred": named, "score": score})

    return id_and_bytes(docs).mapInArrow(each, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Learn from the other folds, predict all rows."""
    remainder = id_remainder(F.col("doc_id"), folds)
    model = learn(docs, remainder != held)
    held_out = F.coalesce(remainder == held, F.lit(False)).alias("held_out")
    return predict(docs, model).select("doc_id", held_out, "lang_pred", "score")
