"""Toxicity: a support vector machine on a gapped string kernel, with Nyström landmarks.

The kernel of two words counts their common subsequences of ``ORDER`` characters,
each weighted by ``DECAY`` to the length it spans in both, and is normalised to 1
for equal words; inserted or left-out characters lower it only a little. Landmarks
are words typical of sentences in toxic documents. A sentence's feature for a landmark
is the kernel's largest value over its words (0 below ``FLOOR``), mapped by the
inverse square root of the landmarks' own kernel matrix (Nyström), and a linear
support vector machine is trained on sentences: the likeliest one of each toxic
document against the likeliest ones of the others. A document's score is a
logistic calibration of its highest sentence margin, the sum of its positive
margins and its length: of a long text one slightly similar word says less.

The kernel is evaluated once per distinct word and worker, against all landmarks at once: a word's
subsequences are looked up among those of the landmarks, which gives its unnormalised kernel with each. The word's own
kernel, for the normalisation, is at least what its subsequences would have if all differed; only words that
reach the floor under that bound need the exact one. So no pair that reaches the floor is passed over.

Bounds: landmarks and machine are fitted on at most ``FIT_ROWS`` labelled rows of
each class, the smallest hashes of doc_id. The machine sees the HARDEST sentences of each; the calibration sees
the same statistics of all sentences that scoring uses. All rows are scored on their whole text.

Defined cases: null and empty texts have no words and get the score of a
document without any similar word; with no labelled toxic row every score is 0.
Copies of one document count once when landmarks are chosen. Repeated rows are scored
each; an empty table gives an empty one; rows with a null id are scored and are not fitted on; texts of any length are
scored whole. ``keep_clean`` keeps all columns of the caller, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe_chunks import slices
from .common import batch_of, free, id_and_bytes, id_remainder, materialize, resident
from .shingles import mixed

ORDER = 3
DECAY = 0.7
FLOOR = 0.5
LANDMARKS = 160
#: Word sets that share one of these bands of minima count as copies: nine in ten with 70 % in common, one in 10,000 with 20 %.
COPY_BANDS, COPY_ROWS = 40, 8
#: Words that may become landmarks by accident, at most (expected number); the machine weighs them.
CHANCE = 100.0
FIT_ROWS = 3000
#: Sentences of a document that the machine is trained on, those with the highest similarity.
HARDEST = 3
THRESHOLD = 0.3
#: Longer words are compared in windows of this length, overlapping by half.
WIDTH = 32
CACHE_WORDS = 500_000

_FACTORS = np.random.default_rng(5).integers(0, 2**64, COPY_BANDS * COPY_ROWS, dtype=np.uint64) | np.uint64(1)
_SPACED = re.compile(r"(?<!\S)\w(?:[ .\-_*]{1,3}\w){3,}(?!\S)")
_EDGES = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum())
_SENTENCE = re.compile(r"[.!?\n]+\s")


def words_of(text: str) -> set[str]:
    """Distinct lower-case words without outer punctuation, and spelt-out runs of single characters joined."""
    low = text.lower()
    found = {w.strip(_EDGES) for w in set(low.split())}
    found.update(re.sub(r"[\W_]", "", m) for m in _SPACED.findall(low))
    return found


def codes(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(code points padded with 0, lengths)."""
    table = np.array(words, dtype=f"U{width}")
    return table.view(np.uint32).reshape(len(words), width).astype(np.int32), np.char.str_len(table).astype(np.int32)


def kernel(a: np.ndarray, b: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gapped-subsequence kernel of each row of a with the same row of b (padding: 0 in a, 0 in b).

    The recursion runs over the two positions; each step is one array operation
    over all pairs.
    """
    n, width, other = len(a), a.shape[1], b.shape[1]
    equal = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] != 0)
    inner = np.ones((n, width + 1, other + 1), dtype=np.float64)  # weights of shorter common subsequences, run on to here
    total = np.zeros(n)
    for p in range(order):
        hits = equal * inner[:, :-1, :-1] * decay * decay
        if p == order - 1:
            total = hits.sum(axis=(1, 2))
            break
        grown = np.zeros_like(inner)
        for i in range(width):
            row = np.zeros(n)
            for j in range(other):
                row = decay * row + hits[:, i, j]
                grown[:, i + 1, j + 1] = decay * grown[:, i, j + 1] + row
        inner = grown
    return total


def normal_kernel(words: list[str], landmarks: list[str], at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Normalised kernel of words[at] with landmarks[to]."""
    if not len(at):
        return np.zeros(0)
    a, b = codes(words, WIDTH)[0], codes(landmarks, WIDTH)[0]
    b = b[:, : max(1, max(map(len, landmarks)))]
    used = np.unique(at)
    own_a, own_b = np.ones(len(words)), kernel(b, b)
    out = np.empty(len(at))
    length = np.array([min(WIDTH, len(w)) for w in words])
    for some in _by_length(length[used]):
        part = a[used[some]][:, : max(1, length[used[some]].max())]
        own_a[used[some]] = kernel(part, part)
    for some in _by_length(length[at]):
        part = a[at[some]][:, : max(1, length[at[some]].max())]
        out[some] = kernel(part, b[to[some]])
    norm = np.sqrt(own_a[at] * own_b[to])
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _by_length(length: np.ndarray, most: int = 2048) -> Iterator[np.ndarray]:
    order = np.argsort(length, kind="stable")
    for k in range(0, len(order), most):
        yield order[k : k + most]


@cache
def _subsequences(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of all subsequences of ORDER of n characters, their weights)."""
    at = np.array(list(combinations(range(n), ORDER)), dtype=np.int64).reshape(-1, ORDER)
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1.0)


class Features:
    """Words to sparse landmark similarities, remembered per worker."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.dull: set[str] = set()
        self.near: dict[str, np.ndarray] = {}
        self.letters = np.unique(codes(landmarks, WIDTH)[0]) if landmarks else np.zeros(1, dtype=np.int32)
        names, owners, weights = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        for k, word in enumerate(landmarks):
            at, weight = _subsequences(len(word))
            names.append(self._names(codes([word], len(word))[0], at)[0])
            owners.append(np.full(len(at), k))
            weights.append(weight)
        name, owner, weight = (np.concatenate(x) for x in (names, owners, weights))
        # one entry per landmark and subsequence, with the sum of its weights there
        pair, of = np.unique(np.stack([name, owner]), axis=1, return_inverse=True)
        self.weight = np.bincount(of.ravel(), weights=weight, minlength=pair.shape[1])
        self.owner = pair[1]
        self.known, self.first, self.count = np.unique(pair[0], return_index=True, return_counts=True)
        self.own = np.bincount(self.owner, weights=self.weight**2, minlength=len(landmarks))
        self.table = None
        if len(self.letters) <= 128:
            self.table = np.full((len(self.letters) + 1) ** ORDER, -1, dtype=np.int32)
            self.table[self.known] = np.arange(len(self.known))

    def _names(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A number for each subsequence; characters that no landmark has count as one that none has."""
        place = np.minimum(np.searchsorted(self.letters, c), len(self.letters) - 1)
        letter = np.where(self.letters[place] == c, place, len(self.letters)).astype(np.int64)
        name = np.zeros((len(c), len(at)), dtype=np.int64)
        for k in range(ORDER):
            name = name * (len(self.letters) + 1) + letter[:, at[:, k]]
        return name

    def kernels(self, c: np.ndarray) -> np.ndarray:
        """Unnormalised kernel of each row of characters, all of one length, with all landmarks."""
        at, weight = _subsequences(c.shape[1])
        name = self._names(c, at).ravel()
        if self.table is not None:
            entry = self.table[name]
        else:
            entry = np.minimum(np.searchsorted(self.known, name), len(self.known) - 1)
            entry[self.known[entry] != name] = -1
        hit = np.flatnonzero(entry >= 0)
        n = self.count[entry[hit]]
        each = np.repeat(np.arange(len(hit)), n)
        of = self.first[entry[hit]][each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        row, place = np.divmod(hit[each], len(at))
        cell = row * len(self.landmarks) + self.owner[of]
        return np.bincount(cell, weights=weight[place] * self.weight[of], minlength=len(c) * len(self.landmarks)).reshape(len(c), -1)

    def learn(self, words: list[str]) -> None:
        units, owner = [], []
        for k, w in enumerate(words):
            for at in range(0, max(1, len(w) - WIDTH // 2), WIDTH // 2) if len(w) > WIDTH else (0,):
                units.append(w[at : at + WIDTH])
                owner.append(k)
        hot: dict[int, np.ndarray] = {}
        length = np.array([len(u) for u in units])
        for n in np.unique(length[length >= ORDER]).tolist() if self.landmarks else ():
            some, step = np.flatnonzero(length == n), max(1, 2_000_000 // len(_subsequences(n)[0]))
            for start in range(0, len(some), step):
                self._compare([units[u] for u in some[start : start + step]], [owner[u] for u in some[start : start + step]], hot)
        for k, w in enumerate(words):
            if k in hot:
                self.near[w] = hot[k]
            else:
                self.dull.add(w)

    def _compare(self, units: list[str], owner: list[int], hot: dict[int, np.ndarray]) -> None:
        """Similarities from FLOOR on of units of one length."""
        c = codes(units, len(units[0]))[0]
        value = self.kernels(c) / np.sqrt(self.own)
        least = np.sqrt((_subsequences(c.shape[1])[1] ** 2).sum())  # the norm if no subsequence occurred twice
        likely = np.flatnonzero((value >= FLOOR * least).any(axis=1))
        for some in (likely[k : k + 2048] for k in range(0, len(likely), 2048)):
            exact = value[some] / np.sqrt(kernel(c[some], c[some]))[:, None]
            for k, row in zip(some.tolist(), np.where(exact >= FLOOR, exact, 0).astype(np.float32), strict=True):
                if row.any():
                    hot[owner[k]] = np.maximum(row, hot.get(owner[k], 0))

    def sentences(self, texts: list[str]) -> list[tuple[int, np.ndarray]]:
        """Per text, its number of words and one row per sentence that has a similar word."""
        if len(self.dull) > CACHE_WORDS:
            self.dull, self.near = set(), {}
        found = [words_of(t) for t in texts]
        new = {w for w in set().union(*found).difference(self.dull) if w not in self.near}
        if new:
            self.learn(list(new))
        near, none = self.near, np.zeros((0, len(self.landmarks)), dtype=np.float32)
        out = []
        for text, words in zip(texts, found, strict=True):
            n, similar = len(text.split()), [w for w in words if w in near]
            if not similar:
                out.append((n, none))
                continue
            rows = []
            for sentence in _SENTENCE.split(text.lower()):
                # a spelt-out word is remembered joined, its sentence doesn't hold it
                if (any(w in sentence for w in similar) or _SPACED.search(sentence)) and (hits := [near[w] for w in words_of(sentence) if w in near]):
                    rows.append(np.max(hits, axis=0))
            # spelt-out words can run over sentence marks
            out.append((n, np.array(rows or [np.max([near[w] for w in similar], axis=0)])))
        return out


class Machine:
    """Nyström map, linear support vector machine and calibration."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        n = len(landmarks)
        if n:
            at, to = (x.ravel() for x in np.indices((n, n)))
            values, vectors = np.linalg.eigh(normal_kernel(landmarks, landmarks, at, to).reshape(n, n))
            self.map = (vectors / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
        self.weights, self.bias, self.curve = np.zeros(n), -1.0, np.array([0.0, 0.0, 0.0, -20.0])

    def margin(self, rows: np.ndarray) -> np.ndarray:
        return rows @ self.weights + self.bias

    def train(self, rows: np.ndarray, toxic: np.ndarray, cost: float = 10.0, steps: int = 400) -> None:
        """Squared-hinge support vector machine by accelerated gradient steps; classes weigh the same."""
        x, y = rows @ self.map, np.where(toxic, 1.0, -1.0)
        weight = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum()))
        x1 = np.column_stack([x, np.ones(len(x))])
        hold = np.append(np.full(x.shape[1], 1 / (cost * 100)), 0.0)
        step = 1 / (2 * np.linalg.norm(x1 * np.sqrt(weight)[:, None], 2) ** 2 + hold.max())
        v = ahead = np.zeros(x1.shape[1])
        for k in range(steps):
            gap = np.maximum(0, 1 - y * (x1 @ ahead))
            after = ahead - step * (hold * ahead - 2 * x1.T @ (weight * gap * y))
            ahead, v = after + k / (k + 3) * (after - v), after
        self.weights, self.bias = self.map @ v[:-1], float(v[-1])

    def evidence(self, per_text: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Per text: highest margin, sum of positive margins, length, 1; from all sentences."""
        out = np.ones((len(per_text), 4))
        for k, (n, rows) in enumerate(per_text):
            margins = self.margin(rows)
            out[k, :3] = max([self.bias, *margins]), np.log1p(np.maximum(0, margins).sum()), np.log1p(n)
        return out

    def calibrate(self, evidence: np.ndarray, toxic: np.ndarray) -> None:
        """Logistic regression of the documents' labels (Newton's method, smoothed targets)."""
        pos, neg = toxic.sum(), (~toxic).sum()
        target, w = np.where(toxic, (pos + 1) / (pos + 2), 1 / (neg + 2)), np.zeros(evidence.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(evidence @ w, -30, 30)))
            h = (evidence * (p * (1 - p))[:, None]).T @ evidence + 1e-3 * np.eye(len(w))
            w = w + np.clip(np.linalg.solve(h, evidence.T @ (target - p) - 1e-3 * w), -5, 5)
        self.curve = w

    def score(self, per_text: list[tuple[int, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(per_text) @ self.curve, -50, 50)))


def sample(docs: DataFrame, labels: DataFrame, chosen: Column, fit_rows: int) -> DataFrame:
    """(doc_id, raw, toxic) of at most ``fit_rows`` labelled rows of each class."""
    rows = labels.where("toxic in (0, 1)").select("doc_id", "toxic").where(chosen)
    picked = [rows.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows) for t in (0, 1)]
    return id_and_bytes(docs).join(F.broadcast(picked[0].union(picked[1])), "doc_id")


def near_copies(rows: DataFrame) -> dict[int, int]:
    """Of the fitted rows: a number per row's set of words to the group of near copies that it is in.

    MinHash bands of the word sets, joined by union-find: COPY_BANDS keys of COPY_ROWS minima a row, of at most
    2 ``FIT_ROWS`` rows.
    """
    schema = pa.schema([("key", pa.int64()), ("bands", pa.binary())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [word_set(raw) for raw in batch.column(0).to_pylist()]
            bands = []
            for _, h in sets:
                least = np.full(COPY_BANDS * COPY_ROWS, 2**64 - 1, dtype=np.uint64)
                for k in range(0, len(h), 4096):
                    least = np.minimum(least, (h[k : k + 4096, None] * _FACTORS).min(axis=0))
                bands.append(mixed((mixed(least).reshape(COPY_BANDS, COPY_ROWS) * _FACTORS[:COPY_ROWS]).sum(axis=1, dtype=np.uint64)).tobytes())
            yield batch_of(schema, {"key": [set_key(h) for _, h in sets], "bands": bands})

    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    first: dict[tuple[int, int], int] = {}
    for r in sorted(rows.select("raw").mapInArrow(each, "key long, bands binary").distinct().collect()):
        parent.setdefault(r["key"], r["key"])
        for band in enumerate(np.frombuffer(r["bands"], dtype=np.uint64).tolist()):
            a, b = root(first.setdefault(band, r["key"])), root(r["key"])
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def word_set(raw: bytes | None) -> tuple[list[str], np.ndarray]:
    """(words that can be landmarks, their hashes) of one text."""
    words = [w for w in words_of((raw or b"").decode("utf-8", "replace")) if ORDER <= len(w) <= WIDTH]
    return words, np.array([int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little") for w in words], dtype=np.uint64)


def set_key(hashes: np.ndarray) -> int:
    return int(mixed(hashes).sum(dtype=np.uint64).view(np.int64))


def choose_landmarks(rows: DataFrame, most: int = LANDMARKS) -> list[str]:
    """Words that are in more toxic documents than chance gives to any word, those with the smallest chance first.

    Of the n documents with a word, a share a is toxic; p of all are. n KL(a, p) is the logarithm of how unlikely
    that is at most (Chernoff's bound), and has to outweigh the number of words that are asked, over CHANCE.
    Near copies count once, so that one document in many versions makes no landmarks.
    """
    schema = pa.schema([("word", pa.string()), ("toxic", pa.int32()), ("alike", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for raw, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, hashes = word_set(raw)
                out["word"] += words
                out["toxic"] += [toxic] * len(words)
                out["alike"] += [groups[set_key(hashes)]] * len(words)
            yield batch_of(schema, out)

    groups = near_copies(rows)
    seen = materialize(rows.select("raw", F.col("toxic").cast("int")).mapInArrow(each, "word string, toxic int, alike long").distinct())
    documents_ = {r["toxic"]: r["n"] for r in seen.groupBy("toxic").agg(F.countDistinct("alike").alias("n")).collect()}
    counts = materialize(seen.groupBy("word").agg(F.sum("toxic").alias("n_toxic"), F.count("*").alias("n")))
    asked, every = counts.count(), sum(documents_.values())
    if not documents_.get(1):
        return []
    p = min(documents_[1] / every, 0.5)
    share = F.col("n_toxic") / F.col("n")
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    excess = F.col("n") * (part(share, F.lit(p)) + part(1 - share, F.lit(1 - p)))
    best = counts.where(share > p).where(excess >= math.log(asked / CHANCE)).orderBy(excess.desc(), "word").limit(most)
    out = [r["word"] for r in best.collect()]
    free(seen, counts)
    return out


def fit(docs: DataFrame, labels: DataFrame, chosen: Column, fit_rows: int = FIT_ROWS) -> Machine:
    rows = sample(docs, labels, chosen, fit_rows)
    landmarks = choose_landmarks(rows)
    machine = Machine(landmarks)
    if not landmarks:
        return machine
    rows = materialize(rows.select("doc_id", "raw", F.col("toxic").cast("int")))

    def of_all(make: Callable[[list[tuple[int, np.ndarray]]], list[bytes]]) -> tuple[list[np.ndarray], np.ndarray]:
        """What ``make`` makes of every fitted row, in a defined order, and its label."""
        schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("made", pa.binary())])

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tool = features(landmarks)
            for batch in (part for whole in batches for part in slices(whole)):
                made = make(tool.sentences([(x or b"").decode("utf-8", "replace") for x in batch.column(1).to_pylist()]))
                yield batch_of(schema, {"doc_id": batch.column(0), "toxic": batch.column(2), "made": made})

        found = rows.mapInArrow(each, "doc_id long, toxic int, made binary").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending"), ("made", "ascending")])
        return found.column("made").to_pylist(), found.column("toxic").to_numpy().astype(bool)

    def hardest(per_text: list[tuple[int, np.ndarray]]) -> list[bytes]:
        return [x[np.argsort(-x.max(axis=1), kind="stable")[:HARDEST]].astype(np.float32).tobytes() if len(x) else b"" for _, x in per_text]

    found, toxic = of_all(hardest)
    vectors, marks = [], []
    for raw, t in zip(found, toxic, strict=True):
        take = np.frombuffer(raw, dtype=np.float32).reshape(-1, len(landmarks))[: 1 if t else HARDEST]
        vectors += list(take) if len(take) else [np.zeros(len(landmarks), dtype=np.float32)]
        marks += [t] * max(1, len(take))
    machine.train(np.array(vectors), np.array(marks))
    found, toxic = of_all(lambda per_text: [x.tobytes() for x in machine.evidence(per_text)])
    machine.calibrate(np.array([np.frombuffer(x) for x in found]), toxic)
    free(rows)
    return machine


def features(landmarks: list[str]) -> Features:
    """One per worker process and set of landmarks."""
    return resident(("landmarks", *landmarks), lambda: Features(landmarks))


_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])


def score_documents(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every whole text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = features(machine.landmarks)
        for batch in (part for whole in batches for part in slices(whole)):
            score = machine.score(tool.sentences([(x or b"").decode("utf-8", "replace") for x in batch.column(1).to_pylist()]))
            yield batch_of(_SCORES, {"doc_id": batch.column(0).to_pylist(), "score": score, "predicted": (score >= threshold).astype(np.int32)})

    return id_and_bytes(docs).mapInArrow(each, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold."""
    names = docs.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = features(machine.landmarks)
        for whole in batches:
            for batch in slices(whole, column=names.index("text")):
                texts = [x or "" for x in batch.column(names.index("text")).to_pylist()]
                yield batch.filter(pa.array(machine.score(tool.sentences(texts)) < threshold))

    return docs.mapInArrow(each, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Train on labelled rows of the other folds, score all rows."""
    remainder = id_remainder(F.col("doc_id"), folds)
    machine = fit(docs, labels, remainder != held)
    held_out = F.coalesce(remainder == held, F.lit(False)).alias("held_out")
    return score_documents(docs, machine).select("doc_id", held_out, "score", "predicted")
