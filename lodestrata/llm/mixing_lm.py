"""LM scoring: online logistic mixing of hashed-context bit predictors.

The text that is scored is a document's tokens: its words in lower case (A-Z only),
one space between them, one end sign (a line feed) behind. A byte is a path of bits
through a Huffman tree of the corpus. For every bit the counts under the 0 to ORDER
bytes before it and the tree's node, found by key, give one prediction each.
Their logits are added with weights from the set that a gate picks (the
longest context known, and whether it has seen one outcome only); an adaptive probability map
refines the sum. Minus the binary logarithms of the bits' probabilities add up to the bits of
the text; a document's score is its base-10 logarithm.

Nothing in a bit's probability depends on more than ORDER + 1 bytes, so it is
evaluated once per distinct byte sequence of that length of the corpus and looked up for all others.

What is gathered: counts of all words and of all byte sequences of the training rows, by key. The tree
and orders 0 to LOW come from the at most 2^24 triples of bytes, as counts per context and node. Sequences that share the three bytes
before their last meet in one task, where the orders above are summed over all of them, without a
cut; that leaves three bytes of a sequence, so a group has at most 2^24 rows at any corpus size. Words and sequences with a share of at least MIN_SHARE (so at most 1 / MIN_SHARE of each) go to the
executors with their counts or bits, to be looked up on the spot; all others are joined with theirs by
key. The share decides the way of the lookup only, no score.

Mixing weights and map are learnt from all training rows, by sums over the counted sequences, each one's
own occurrence taken off the counts: PASSES of Newton's steps to the weights on summed gradients,
then one pass for the map. Only those sums, of fixed size, reach the driver.

``score`` is of the text in that spelling, as the contract's tokens are; white space and the case of A-Z don't count.

Defined cases: null texts are empty: an end sign alone; repeated rows are scored each; an empty table gives an empty one; texts
of any length are scored whole, and counted in batches; with no
training rows every count is 0 and all bits have probability 1/2; null ids are not held out and
not trained on.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe_chunks import slices
from .common import batch_of, id_and_bytes, id_remainder, materialize, resident, small_batches
from .shingles import mixed, word_hashes

ORDER = 5
#: Highest order whose counts every task holds.
LOW = 2
MIN_SHARE = 2.0**-21
#: Newton's steps to the mixing weights.
PASSES = 4
#: Logits are stored in steps of 1 / SCALE.
SCALE = 12.0
MAP_CONTEXTS, MAP_STEPS = 1024, 24
#: Bytes of text that a task works on at once, and distinct keys that it holds before it passes their counts on.
TEXT_BYTES, HELD = 1 << 20, 600_000
#: Steps of paths in a stored row of lessons: 150 KB, as the JVM's heap grows and breaks up over larger arrays.
LESSON_STEPS = 1 << 13
END = 10

_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: The bytes of a context by which sequences meet.
_PLACE = (1 << (8 * LOW + 8)) - 1


def canonical(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all documents, each led by ORDER line feeds and ended by one; length of each with its end)."""
    words = [b" ".join(t.lower().split()) for t in texts]
    lead = bytes([END]) * ORDER
    data = np.frombuffer(lead + (bytes([END]) + lead).join(words) + bytes([END]), dtype=np.uint8)
    return data, np.array([len(w) + 1 for w in words], dtype=np.int64)


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(each byte with the ORDER bytes before it as one number, how many per document)."""
    data, lengths = canonical(texts)
    keys = np.zeros(len(data) - ORDER, dtype=np.uint64)
    for k in range(ORDER + 1):
        keys = (keys << np.uint64(8)) | data[k : len(data) - ORDER + k]
    own = np.ones(len(keys), dtype=bool)
    gaps = (np.cumsum(lengths + ORDER) - ORDER)[:-1]  # where the next document's lead begins
    own[(gaps[:, None] + np.arange(ORDER)).ravel()] = False
    return keys[own], lengths


def chunks(batch: pa.RecordBatch, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts, as both sides of the Arrow channel hold a whole one."""
    for start in range(0, batch.num_rows, most):
        yield batch.slice(start, most)


def count_all(docs: DataFrame, chosen: Column) -> DataFrame:
    """(kind, key, n) over the chosen rows: kind 0 words by hash, kind 1 byte sequences (those of other rows with 0), kind 2 rows."""
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])
    most = HELD

    def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
        return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        held: list[list] = [[], []]
        rows = 0

        def passed_on(k: int) -> Iterator[pa.RecordBatch]:
            (keys, counts), held[k] = added(held[k]), []
            yield from chunks(batch_of(schema, {"kind": np.full(len(keys), k, dtype=np.int32), "key": keys.view(np.int64), "n": counts}))

        for batch in (part for whole in batches for part in slices(whole, TEXT_BYTES, column=0)):
            every, use = [x or b"" for x in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            texts, others = ([x for x, u in zip(every, use, strict=True) if u is t] for t in (True, False))
            rows += len(texts)
            found = [(0, word_hashes(texts)[0], 1), (1, sequences(texts)[0], 1)] if texts else []
            found += [(1, sequences(others)[0], 0)] if others else []
            for k, keys, times in found:
                some, n = np.unique(keys, return_counts=True)
                held[k].append((some, n * times))
                if sum(len(x) for x, _ in held[k][1:]) > most:
                    held[k] = [added(held[k])]
                    if len(held[k][0][0]) > most:
                        yield from passed_on(k)
        for k in (0, 1):
            if held[k]:
                yield from passed_on(k)
        yield batch_of(schema, {"kind": [2], "key": [0], "n": [rows]})

    small_batches(docs.sparkSession)
    texts = docs.select(F.col("text").cast("binary").alias("raw"), F.coalesce(chosen, F.lit(False)).alias("use"))
    return texts.mapInArrow(each, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length of each byte's path, its nodes, its bits) for all 256 bytes."""
    heap = [(int(n) + 1, b, (b,)) for b, n in enumerate(counts)]
    heapq.heapify(heap)
    paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    node = 0
    while len(heap) > 1:
        (a, x, low), (b, y, high) = heapq.heappop(heap), heapq.heappop(heap)
        for bit, some in ((0, low), (1, high)):
            for s in some:
                paths[s].append((node, bit))
        heapq.heappush(heap, (a + b, min(x, y), low + high))
        node += 1
    length = np.array([len(p) for p in paths])
    nodes, bits = np.zeros((256, length.max()), dtype=np.int64), np.zeros((256, length.max()), dtype=np.int64)
    for s, p in enumerate(paths):
        for d, (n, bit) in enumerate(reversed(p)):
            nodes[s, d], bits[s, d] = n, bit
    return length, nodes, bits


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Mixer:
    """The tree, the counts of the orders up to LOW, gated weights and the refining map."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        """From byte sequences, of which only the last LOW + 1 bytes are used here, and how often each occurs."""
        self.keys, self.counts = keys, counts
        some, of = np.unique(keys & np.uint64((1 << (8 * LOW + 8)) - 1), return_inverse=True)
        n, some = np.bincount(of, weights=counts, minlength=len(some)), some.astype(np.int64)
        self.length, self.nodes, self.bits = huffman(np.bincount(some & 255, weights=n, minlength=256))
        at, _, node, bit = self.paths(some & 255)
        self.low = []  # per order: contexts with their nodes, and how often each outcome was seen there
        for order in range(LOW + 1):
            place, of = np.unique((some[at] >> 8 & (1 << (8 * order)) - 1) << 8 | node, return_inverse=True)
            self.low.append((place, *(np.bincount(of, weights=n[at] * (bit == outcome), minlength=len(place)) for outcome in (0, 1))))
        gates = 2 * (ORDER + 1)
        self.weights = np.full((gates, ORDER + 2), 0.0)
        for g in range(gates):
            self.weights[g, : g // 2 + 1] = 0.2
            self.weights[g, g // 2] = 0.8
        self.map = np.tile(_squash(np.linspace(-12, 12, MAP_STEPS + 1)), (MAP_CONTEXTS, 1))

    def paths(self, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, depth, node, bit) of every step of every byte's path, in order."""
        n = self.length[byte]
        at = np.repeat(np.arange(len(byte)), n)
        depth = np.arange(len(at)) - (np.cumsum(n) - n)[at]
        return at, depth, self.nodes[byte[at], depth], self.bits[byte[at], depth]

    def seen(self, keys: np.ndarray, counts: np.ndarray, most: int = 1 << 15) -> Iterator[tuple]:
        """For parts of the distinct ``keys``: (slice, row, node, bit, counts of 0 per order, counts of 1).

        All counted sequences that share the last LOW + 1 bytes of a context with one of the keys must be among them.
        """
        high = []
        for order in range(LOW + 1, ORDER + 1):
            some, of = np.unique(keys & np.uint64((1 << (8 * order + 8)) - 1), return_inverse=True)
            n = np.bincount(of, weights=counts, minlength=len(some))
            byte = (some & np.uint64(255)).astype(np.int64)
            at, _, node, bit = self.paths(byte)
            slot = np.unique((some[at] >> np.uint64(8) << np.uint64(8)) | node.astype(np.uint64), return_inverse=True)[1].astype(np.int32)
            both = [np.bincount(slot, weights=n[at] * (bit == outcome)) for outcome in (0, 1)]
            first = np.cumsum(self.length[byte]) - self.length[byte]
            high.append((of, first, slot, both))
        for start in range(0, len(keys), most):
            part = keys[start : start + most]
            at, depth, node, bit = self.paths((part & np.uint64(255)).astype(np.int64))
            found = [[], []]
            for order, (place, *both) in enumerate(self.low):
                context = (part >> np.uint64(8)).astype(np.int64) & ((1 << (8 * order)) - 1)
                # steps of one path are few, but rows of one context are many: look up each once
                wanted, which = np.unique(context[at] << 8 | node, return_inverse=True)
                slot = np.minimum(np.searchsorted(place, wanted), max(0, len(place) - 1))
                hit = place[slot] == wanted if len(place) else np.zeros(len(wanted), dtype=bool)
                for outcome in (0, 1):
                    found[outcome].append(np.where(hit, both[outcome][slot] if len(place) else 0.0, 0.0)[which])
            for of, first, slot, both in high:
                place = slot[first[of[start : start + most]][at] + depth]
                for outcome in (0, 1):
                    found[outcome].append(both[outcome][place])
            yield slice(start, start + most), at, node, bit, *found

    @staticmethod
    def inputs(zeros: list[np.ndarray], ones: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(logits of all orders in steps, gate) from the counts per order."""
        x = np.zeros((len(zeros[0]), ORDER + 1), dtype=np.int8)
        gate = np.zeros(len(zeros[0]), dtype=np.uint8)
        for k in range(ORDER + 1):
            x[:, k] = Mixer.stored(zeros[k], ones[k])
            sure = np.minimum(zeros[k], ones[k]) <= 0
            gate = np.where(zeros[k] + ones[k] > 0, 2 * k + sure, gate).astype(np.uint8)
        return x, gate

    @staticmethod
    def stored(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Logit as it is kept: whole steps, 0 if nothing was seen."""
        return np.where(zeros + ones > 0, np.clip(np.rint(SCALE * _logit((ones + 0.4) / (zeros + ones + 0.8))), -127, 127), 0.0)

    @staticmethod
    def scaled(x: np.ndarray) -> np.ndarray:
        """Logits of all orders and a constant."""
        return np.column_stack([x / SCALE, np.full(len(x), 0.3)])

    def total(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip((x * self.weights[gate]).sum(axis=1), -11.9, 11.9)

    def lessons(self, keys: np.ndarray, counts: np.ndarray, times: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
        """What learning needs of the sequences that occur ``times`` > 0: inputs without a sequence's own occurrence."""
        for part, at, node, bit, zeros, ones in self.seen(keys, counts):
            n = times[part][at]
            use = n > 0
            at, node, bit, n = at[use], node[use], bit[use], n[use]
            x, gate = self.inputs(*([np.maximum(0.0, c[use] - (bit == outcome)) for c in some] for outcome, some in ((0, zeros), (1, ones))))
            place = self.map_context(self.context(keys[part])[at], node)
            yield {"x": x, "gate": gate, "bit": bit.astype(np.uint8), "place": place.astype(np.uint16), "n": n.astype(np.float64)}

    def slopes(self, lesson: dict[str, np.ndarray]) -> np.ndarray:
        """Per gate the gradient of the log likelihood and the matrix of its second derivatives, summed over all occurrences."""
        out = np.zeros((len(self.weights), ORDER + 2, ORDER + 3))
        for g in np.unique(lesson["gate"]):
            some = lesson["gate"] == g
            x, n = self.scaled(lesson["x"][some]), lesson["n"][some]
            p = _squash(self.total(x, lesson["gate"][some]))
            out[g, :, 0] = x.T @ (n * (lesson["bit"][some] - p))
            out[g, :, 1:] = (x * (n * p * (1 - p))[:, None]).T @ x
        return out

    def step(self, slopes: np.ndarray, hold: float = 1.0) -> None:
        """One of Newton's steps; gates that met nothing stay."""
        for g, s in enumerate(slopes):
            self.weights[g] += np.clip(np.linalg.solve(s[:, 1:] + hold * np.eye(ORDER + 2), s[:, 0]), -0.5, 0.5)

    def outcomes(self, lesson: dict[str, np.ndarray]) -> np.ndarray:
        """Per cell of the map the weight of its bits that are 1, and of all."""
        low, part = self.map_place(self.total(self.scaled(lesson["x"]), lesson["gate"]))
        out = np.zeros((2, self.map.size))
        for shift, weight in ((0, 1 - part), (1, part)):
            cell = lesson["place"].astype(np.int64) * (MAP_STEPS + 1) + low + shift
            out[0] += np.bincount(cell, weights=lesson["n"] * weight * lesson["bit"], minlength=self.map.size)
            out[1] += np.bincount(cell, weights=lesson["n"] * weight, minlength=self.map.size)
        return out

    def refine(self, outcomes: np.ndarray, hold: float = 50.0) -> None:
        """Every cell becomes the mean of its outcomes; its starting value counts ``hold`` times."""
        ones, every = (x.reshape(self.map.shape) for x in outcomes)
        self.map = np.clip((ones + hold * self.map) / (every + hold), 1e-6, 1 - 1e-6)

    def learn(self, keys: np.ndarray) -> None:
        """From sequences, each as often as it occurs, in this process."""
        of, times = np.unique(keys, return_counts=True)
        every = np.union1d(self.keys, of)
        counts, n = np.zeros(len(every)), np.zeros(len(every))
        counts[np.searchsorted(every, self.keys)] = self.counts
        n[np.searchsorted(every, of)] = times
        lessons = list(self.lessons(every, counts, n))
        for _ in range(PASSES):
            self.step(sum(self.slopes(x) for x in lessons))
        self.refine(sum(self.outcomes(x) for x in lessons))

    def freeze(self) -> None:
        """Learning has ended; counts stay exact, so nothing is left to turn into tables."""

    @staticmethod
    def context(keys: np.ndarray) -> np.ndarray:
        """Hash of the byte before each byte."""
        return mixed(((keys >> np.uint64(8)) & np.uint64(255)) * _GOLD + np.uint64(1))

    @staticmethod
    def map_context(context: np.ndarray, node: np.ndarray) -> np.ndarray:
        return (mixed(context + node.astype(np.uint64) * _GOLD) % np.uint64(MAP_CONTEXTS)).astype(np.int64)

    @staticmethod
    def map_place(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (total + 12) * (MAP_STEPS / 24)
        low = at.astype(np.int64)
        return low, at - low

    def bits_among(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Bits that each of the distinct ``keys``' last byte takes; see ``seen`` for what must be among them."""
        out = np.zeros(len(keys))
        for part, at, node, bit, zeros, ones in self.seen(keys, counts):
            x, gate = self.inputs(zeros, ones)
            total = self.total(self.scaled(x), gate)
            low, share = self.map_place(total)
            place = self.map_context(self.context(keys[part])[at], node)
            refined = self.map[place, low] * (1 - share) + self.map[place, low + 1] * share
            p = (_squash(total) + refined) / 2
            out[part] = np.bincount(at, weights=-np.log2(np.where(bit == 1, p, 1 - p)), minlength=len(out[part]))
        return out

    def bits_of(self, keys: np.ndarray) -> np.ndarray:
        """Bits that each sequence's last byte takes, by the counts that this object was made from."""
        every = np.union1d(self.keys, keys)
        counts = np.zeros(len(every))
        counts[np.searchsorted(every, self.keys)] = self.counts
        return self.bits_among(every, counts)[np.searchsorted(every, keys)]


class Model:
    """What scoring needs: totals, the frequent words' counts and the frequent sequences' bits."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: int, distinct: int, ends: int, keys: np.ndarray, bits: np.ndarray):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.tokens, self.distinct, self.ends = tokens, distinct, ends
        order = np.argsort(keys)
        self.keys, self.bits = keys[order], bits[order]

    def log10(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))

    def finder(self) -> Callable[[np.ndarray], np.ndarray]:
        """Sequences to their bits, NaN if they are not frequent: one probe, and a search for those that met another."""
        size = max(4, (4 * len(self.keys)).bit_length())
        slot = lambda keys: ((keys * _GOLD) >> np.uint64(64 - size)).astype(np.int64)
        table = np.full(1 << size, -1, dtype=np.int32)
        table[slot(self.keys)] = np.arange(len(self.keys), dtype=np.int32)
        beaten = np.flatnonzero(table[slot(self.keys)] != np.arange(len(self.keys)))
        more = self.keys[beaten]

        def bits(keys: np.ndarray) -> np.ndarray:
            out = np.full(len(keys), np.nan)
            if not len(self.keys):
                return out
            at = table[slot(keys)]
            hit = (at >= 0) & (self.keys[at] == keys)
            out[hit] = self.bits[at[hit]]
            if len(more):
                left = np.flatnonzero(~hit & (at >= 0))
                at = np.minimum(np.searchsorted(more, keys[left]), len(more) - 1)
                hit = more[at] == keys[left]
                out[left[hit]] = self.bits[beaten[at[hit]]]
            return out

        return bits


def by_context(seqs: DataFrame, columns: list[str], each: Callable[..., Iterator[pa.RecordBatch]], kinds: str, least: int = 1 << 16) -> DataFrame:
    """What ``each`` makes of the arrays of (key, *columns), all sequences that share the last LOW + 1 bytes of the context together."""

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        held: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield from each(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held.clear()

        for batch in batches:
            key, *more = (batch.column(c).to_numpy() for c in range(1 + len(columns)))
            key = key.view(np.uint64)
            place = (key >> np.uint64(8)) & np.uint64(_PLACE)
            cut = np.flatnonzero(place[1:] != place[:-1]) + 1
            for start, stop in zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True):
                if start == stop:
                    continue
                if held and sum(len(h[0]) for h in held) >= least and ((held[-1][0][-1] >> np.uint64(8)) & np.uint64(_PLACE)) != place[start]:
                    yield from flush()
                held.append([c[start:stop] for c in (key, *more)])
        yield from flush()

    place = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(_PLACE))
    return seqs.select("key", *columns, place.alias("place")).repartition("place").sortWithinPartitions("place", "key").mapInArrow(grouped, kinds)


_LESSON = {"x": np.int8, "gate": np.uint8, "bit": np.uint8, "place": np.uint16, "n": np.float64}


def learn(mixer: Mixer, seqs: DataFrame) -> None:
    """Weights, then the map, from the sums over all occurrences of (key, n) in ``seqs``."""
    schema = pa.schema([(c, pa.binary()) for c in _LESSON])

    def taught(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lesson in mixer.lessons(keys, n, n):
            for start in range(0, len(lesson["n"]), LESSON_STEPS):
                yield batch_of(schema, {c: [lesson[c][start : start + LESSON_STEPS].tobytes()] for c in _LESSON})

    lessons = materialize(by_context(seqs, ["n"], taught, ", ".join(f"{c} binary" for c in _LESSON)), long_rows=True)

    def summed(of: str, shape: tuple[int, ...]) -> np.ndarray:
        """The sum of what the mixer, as it is now, makes of every lesson."""
        sums = pa.schema([("cell", pa.int32()), ("v", pa.float64())])

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in (part for whole in batches for part in slices(whole, 1 << 20, column=0)):
                lesson = {c: np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=t) for c, t in _LESSON.items()}
                total += getattr(mixer, of)(lesson | {"x": lesson["x"].reshape(-1, ORDER + 1)})
            at = np.flatnonzero(total)
            yield batch_of(sums, {"cell": at, "v": total.ravel()[at]})

        out = np.zeros(shape)
        found = lessons.mapInArrow(each, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
        out.ravel()[found.column("cell").to_numpy()] = found.column("v").to_numpy()
        return out

    for _ in range(PASSES):
        mixer.step(summed("slopes", (*mixer.weights.shape, ORDER + 3)))
    mixer.refine(summed("outcomes", (2, mixer.map.size)))


def train(docs: DataFrame, chosen: Column) -> tuple[Model, DataFrame, DataFrame]:
    """(the model, counts of all words by hash, bits of all less frequent sequences) from the
    rows that ``chosen`` admits; sequences of the other rows are in it with a count of 0."""
    counts = materialize(count_all(docs, chosen))
    totals = {r["kind"]: (r["n"], r["d"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect()}
    (words, distinct), (bytes_, _), (ends, _) = (totals.get(k, (0, 0)) for k in range(3))
    often = counts.where("kind = 0").where(F.col("n") >= words * MIN_SHARE).toArrow()
    seqs = counts.where("kind = 1").select("key", "n")
    triples = seqs.where("n > 0").groupBy(F.col("key").bitwiseAND(F.lit(_PLACE)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    mixer = Mixer(triples.column("key").to_numpy().view(np.uint64), triples.column("n").to_numpy().astype(np.float64))
    mixer.keys = mixer.counts = None  # not sent to the tasks
    learn(mixer, seqs)
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("bits", pa.float64())])

    def each(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from chunks(batch_of(schema, {"key": keys.view(np.int64), "n": n, "bits": mixer.bits_among(keys, n)}))

    bits = materialize(by_context(seqs, ["n"], each, "key long, n long, bits double"))
    frequent = F.col("n") >= max(1.0, bytes_ * MIN_SHARE)
    top = bits.where(frequent).select("key", "bits").toArrow()
    model = Model(
        often.column("key").to_numpy().view(np.uint64), often.column("n").to_numpy(), words + ends, distinct + (ends > 0), ends,
        top.column("key").to_numpy().view(np.uint64), top.column("bits").to_numpy(),
    )
    return model, counts.where("kind = 0").select(F.col("key").alias("word"), "n"), bits.where(~frequent).select(F.col("key").alias("seq"), "bits")


_PARTS = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("bits", pa.float64()),
    ("n_bytes", pa.int64()), ("word", pa.int64()), ("seq", pa.int64()), ("times", pa.int64()),
])


def _per_row(keys: np.ndarray, owner: np.ndarray, name: str, row: int) -> pa.RecordBatch:
    """One row per document and distinct key, with how often it occurs there."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
    columns = {"row": row + owner[first], name: keys[first].view(np.int64), "times": np.diff(np.append(first, len(keys)))}
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(first), f.type) for f in _PARTS], schema=_PARTS)


def score(docs: DataFrame, model: Model, counts: DataFrame, rare_bits: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score, bits_per_byte) of every row of what ``train`` has seen."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        bits_of = m.finder()
        row = TaskContext.get().partitionId() << 33
        empty = m.log10(np.array([m.ends]))[0]
        for batch in (part for whole in batches for part in slices(whole, TEXT_BYTES)):
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            keys, lengths = sequences(texts)
            each_bits = bits_of(keys)
            far = np.flatnonzero(np.isnan(each_bits))
            each_bits[far] = 0.0
            bits = np.add.reduceat(each_bits, np.cumsum(lengths) - lengths)
            words, n = word_hashes(texts)
            owner = np.repeat(np.arange(len(texts)), n)
            at = np.searchsorted(m.words, words)
            hit = np.zeros(len(words), dtype=bool)
            if len(m.words):
                at = np.minimum(at, len(m.words) - 1)
                hit = m.words[at] == words
            base = np.bincount(owner[hit], weights=m.log10(m.counts[at[hit]]), minlength=len(texts)) + empty if len(m.words) else np.full(len(texts), empty)
            known = np.bincount(owner[hit], minlength=len(texts)) + (m.ends > 0)
            none = pa.nulls(len(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array(row + np.arange(len(texts))), batch.column(0), pa.array(n.astype(np.int64) + 1), pa.array(known.astype(np.int64)), pa.array(base),
                pa.array(bits), pa.array(lengths), none, none, none,
            ], schema=_PARTS)
            # the rarer words and sequences: one row per document and each, to meet their counts and bits by key
            yield from chunks(_per_row(words[~hit], owner[~hit], "word", row))
            yield from chunks(_per_row(keys[far], np.searchsorted(np.cumsum(lengths), far, side="right"), "seq", row))
            row += len(texts)

    kinds = "row long, doc_id long, n_tokens long, known long, base double, bits double, n_bytes long, word long, seq long, times long"
    parts = materialize(id_and_bytes(docs).mapInArrow(each, kinds))
    chance = F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(model.tokens + 0.1 * (model.distinct + 1)))
    rare = parts.where("word is not null").select("row", "word", "times").join(counts, "word", "left")
    rare = rare.select("row", (F.col("times") * chance).alias("more"), F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("more_known"), F.lit(0.0).alias("more_bits"))
    far = parts.where("seq is not null").select("row", "seq", "times").join(rare_bits, "seq", "left")
    far = far.select("row", F.lit(0.0).alias("more"), F.lit(0).cast("long").alias("more_known"), (F.col("times") * F.col("bits")).alias("more_bits"))
    more = rare.union(far).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("more", "more_known", "more_bits")))
    out = parts.where("n_tokens is not null").drop("word", "seq", "times").join(more, "row", "left")
    bits = F.col("bits") + F.coalesce("more_bits", F.lit(0.0))
    return out.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (-bits * float(np.log10(2))).alias("score"), (bits / F.col("n_bytes")).alias("bits_per_byte"),
    )


def score_documents(docs: DataFrame, folds: int = 10, held: int = 0) -> DataFrame:
    """Learn from the other folds, score all rows."""
    remainder = id_remainder(F.col("doc_id"), folds)
    model, counts, rare_bits = train(docs, remainder != held)
    held_out = F.coalesce(id_remainder(F.col("doc_id"), folds) == held, F.lit(False))
    return score(docs, model, counts, rare_bits).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(int(model.tokens)).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte"
    )
