"""Quality rules: an isolation forest on rule statistics.

Every document gets the same rule statistics (word counts, symbols, repeated
lines and word windows, upper case, ...). Trees split a random statistic at a
random value until a row stands alone; rows with short paths are anomalies. The
forest is grown from rows labelled good, so its paths measure how far a document
is from accepted ones. Half of the splits range over the node's part of the box
around all labelled rows, the others over the node's own rows: a statistic that no
good row varies in can be split too, and regions without good rows end early. The
threshold is the score that best parts the labelled rows while keeping all but
``KEEP_LOSS`` of the good ones (a good row lost weighs ``LOSS_WEIGHT`` bad ones).

Box, trees and threshold are made from all labelled rows that pass the base rules.
Trees differ by their random splits only and grow level by level on the executors:
a level takes the rows, the least and the greatest value of each of its nodes, summed up
over all good rows. Trees end at ``HEIGHT`` levels; the rows of a last node add the path
that they would take on the average. For the threshold a good row is taken off its own nodes,
and scores are whole multiples of 1 / ``GRID``, so counts per score say all about it.

Bounds: nothing but nodes (``TREES`` times 2^(``HEIGHT`` + 1) at most) and counts per score
(2 ``GRID`` + 2 at most) reaches the driver. Statistics are taken once per document, of its whole text.

Defined cases: a null or empty text has 0 words, all statistics 0, and fails the
base rules; with no labelled rows of a class nothing beyond the base rules is
rejected; equal statistics always get equal scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, batch_of, condensed, id_and_bytes, materialize, scope

TREES = 150
HEIGHT = 9
GRID = 1 << 16
#: Share of good labelled rows that may be rejected, and what a good row lost counts against a bad one caught.
KEEP_LOSS = 0.002
LOSS_WEIGHT = 20

#: Characters that the symbol rule counts.
SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_ALPHA = _UPPER + bytes(range(97, 123))
_CONTINUATION = bytes(range(0x80, 0xC0))
WINDOW = 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The forest's statistics; repeated windows and lines are the base rules' part.
FEATURES = ("log_words", "word_length", "symbols", "marks", "upper", "same_next")


def repeated_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that occur twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    if len(set(windows)) == n:
        return 0
    often = Counter(windows)
    inside, until = 0, 0
    for k, w in enumerate(windows):
        if often[w] > 1:
            inside += k + WINDOW - max(k, until)
            until = k + WINDOW
    return inside


def statistics(raw: bytes) -> tuple[list[int], list[float]]:
    """(the base counts, the forest's features) of one text."""
    words = raw.split()
    n = len(words)
    size = len(raw)
    without = lambda chars: size - len(raw.translate(None, chars))
    word_chars = size - without(BLANKS) - without(_CONTINUATION)
    symbols = without(SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    counts = [n, word_chars, symbols, dup_lines, repeats]
    if not n:
        return counts, [0.0] * len(FEATURES)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    spread = lambda x, of: float(np.log1p(50 * x / (of + 20)))  # noqa: E731  20 more: short texts vary more
    return counts, [
        float(np.log1p(n)), (word_chars + 100) / (n + 20), spread(symbols, n), spread(without(b"!"), n), spread(without(_UPPER), without(_ALPHA)),
        spread(same, n),
    ]


def base_fails(counts: list[int]) -> bool:
    return counts[0] < 10 or 100 * counts[4] > 20 * counts[0]


class Forest:
    """Isolation trees, one per row of flat arrays (node k parts into 2 k + 1 and 2 k + 2): statistic, split, good rows that came by."""

    def __init__(self, rows: int, low: np.ndarray, high: np.ndarray, measure: Callable[[Forest], tuple], trees: int = TREES, height: int = HEIGHT, seed: int = 7):
        """``measure`` says of each node of the last level how many rows it has, and the least and greatest value of its statistic among them."""
        rng = np.random.default_rng(seed)
        self.rows, self.level = rows, 0
        height = min(height, int(np.ceil(np.log2(max(2, rows)))))
        shape = trees, (2 << height) - 1
        self.feature, self.split, self.n = np.full(shape, -1), np.full(shape, np.inf), np.zeros(shape, dtype=np.int64)
        low, high = (np.tile(x, (trees, 1, 1)) for x in (low, high))
        while True:
            width = 1 << self.level
            now = slice(width - 1, 2 * width - 1)
            free = high > low
            drawn = np.where(free, rng.random(free.shape), -1.0).argmax(axis=2)
            self.feature[:, now] = np.where(free.any(axis=2) & (self.level < height), drawn, -1)
            self.n[:, now], least, most = measure(self)
            self.feature[:, now][self.n[:, now] < 2] = -1
            if self.level == height:
                return
            inner = self.feature[:, now] >= 0
            pick = np.where(inner, drawn, 0)[..., None]
            box = (np.take_along_axis(x, pick, axis=2)[..., 0] for x in (low, high))
            own = (rng.random(inner.shape) < 0.5) & (least < most)
            start, stop = (np.where(own, a, b) for a, b in zip((least, most), box, strict=True))
            value = start + rng.random(inner.shape) * (stop - start)
            self.split[:, now] = np.where(inner, value, np.inf)
            below, above = high.copy(), low.copy()
            for side in (below, above):
                np.put_along_axis(side, pick, np.where(inner, value, np.take_along_axis(side, pick, axis=2)[..., 0])[..., None], axis=2)
            low, high = (np.stack(x, axis=2).reshape(trees, 2 * width, -1) for x in ((low, above), (below, high)))
            self.level += 1

    def ends(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """Per tree, the node in which every row ends, as far as the trees have grown."""
        flat, index = rows.T.ravel(), np.arange(len(rows))
        for feature, split in zip(self.feature, self.split, strict=True):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.level):
                f = feature[node]
                right = flat[np.maximum(f, 0) * len(rows) + index] > split[node]
                node = np.where(f >= 0, 2 * node + 1 + right, node)
            yield node

    def levels(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``measure`` has to say, of these rows alone (infinite where a node has none)."""
        width = 1 << self.level
        n, least, most = np.zeros((len(self.feature), width), dtype=np.int64), np.full((len(self.feature), width), np.inf), np.full((len(self.feature), width), -np.inf)
        for t, node in enumerate(self.ends(rows)):
            here = np.flatnonzero(node >= width - 1)
            at = node[here] - (width - 1)
            values = rows[here, np.maximum(self.feature[t][node[here]], 0)]
            n[t] = np.bincount(at, minlength=width)
            np.minimum.at(least[t], at, values)
            np.maximum.at(most[t], at, values)
        return n, least, most

    def score(self, rows: np.ndarray, own: int = 0) -> np.ndarray:
        """Anomaly score in 0..1, higher for shorter paths; ``own`` of the counted rows are left out of each node."""
        if not len(rows):
            return np.zeros(0)
        depth = np.log2(np.arange(1, self.n.shape[1] + 1)).astype(np.int64)
        total = np.zeros(len(rows))
        for n, node in zip(self.n, self.ends(rows), strict=True):
            total += (depth + average_path(n - own))[node]
        return np.rint(np.exp2(-total / len(self.n) / max(1.0, float(average_path(np.array(self.rows))))) * GRID) / GRID


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean path of an unsuccessful search in binary trees of n rows."""
    m = np.maximum(n, 2)
    return np.where(n < 2, 0.0, 2.0 * (np.log(m - 1) + 0.5772156649) - 2.0 * (m - 1) / m)


class Judge:
    """The forest and the calibrated threshold; without a forest, nothing is rejected."""

    def __init__(self, forest: Forest | None = None, cells: np.ndarray | None = None, good: np.ndarray | None = None, bad: np.ndarray | None = None):
        """``good`` and ``bad`` labelled rows have the scores ``cells`` / GRID, which ascend."""
        self.forest, self.threshold = forest, np.inf
        if forest is None or not bad.sum():
            return
        kept, caught = np.cumsum(good) / good.sum(), 1 - np.cumsum(bad) / bad.sum()
        worth = np.where(kept >= 1 - KEEP_LOSS, caught + LOSS_WEIGHT * kept, -1.0)
        best = np.flatnonzero(worth == worth.max())[-1]
        later = cells[best + 1 :][bad[best + 1 :] > 0]  # half way to the next rejected row
        self.threshold = float((cells[best] + (later[0] if len(later) else cells[best])) / 2) / GRID

    def rejects(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = self.forest.score(rows) if self.forest else np.zeros(len(rows))
        return score, score > self.threshold


_MEASURED = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()), ("features", pa.list_(pa.float64()))])
_KINDS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean"


def measured(docs: DataFrame) -> DataFrame:
    """Base counts, base verdict and the forest's features of every document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(x.as_py() or b"") for x in batch.column(1)]
            out = {name: [c[k] for c, _ in found] for k, name in enumerate(COUNTS)}
            yield batch_of(_MEASURED, out | {"doc_id": batch.column(0).to_pylist(), "base_failed": [base_fails(c) for c, _ in found], "features": [f for _, f in found]})

    return id_and_bytes(docs).mapInArrow(each, f"{_KINDS}, features array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("features").flatten().to_numpy().reshape(-1, len(FEATURES))


def _measure(good: DataFrame, forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``Forest.levels`` over all rows of ``good``."""
    kinds = {"n": np.int64, "least": np.float64, "most": np.float64}
    schema = pa.schema([("tree", pa.int32()), *((c, pa.binary()) for c in kinds)])

    def added(parts: list[tuple]) -> tuple:
        n, least, most = zip(*parts, strict=True)
        return sum(n), np.minimum.reduce(least), np.maximum.reduce(most)

    def told(trees: list[int], found: list[tuple]) -> pa.RecordBatch:
        return batch_of(schema, {"tree": trees} | {c: [f[k].tobytes() for f in found] for k, c in enumerate(kinds)})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far: tuple | None = None
        for batch in batches:
            found = forest.levels(_matrix(batch))
            so_far = added([so_far, found]) if so_far else found
        if so_far:
            yield told(list(range(len(so_far[0]))), list(zip(*so_far, strict=True)))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, tuple] = {}
        for batch in batches:
            for r in batch.to_pylist():
                found = tuple(np.frombuffer(r[c], dtype=t) for c, t in kinds.items())
                by[r["tree"]] = added([by[r["tree"]], found]) if r["tree"] in by else found
        yield told(list(by), list(by.values()))

    spelt = "tree int, " + ", ".join(f"{c} binary" for c in kinds)
    rows = good.mapInArrow(each, spelt).repartition("tree").mapInArrow(merged, spelt).collect()
    rows.sort(key=lambda r: r["tree"])
    return tuple(np.stack([np.frombuffer(r[c], dtype=t) for r in rows]) for c, t in kinds.items())


def fit_measured(found: DataFrame, labels: DataFrame) -> Judge:
    """A judge from all labelled rows of ``measured`` that pass the base rules."""
    marks = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("quality"))
    with scope():
        rows = materialize(found.where("not base_failed").join(marks, F.col("doc_id") == F.col("label_id")).select("quality", "features"))
        ends = [f(F.col("features")[k]).alias(f"{name}{k}") for name, f in (("low", F.min), ("high", F.max)) for k in range(len(FEATURES))]
        every = rows.agg(F.sum("quality").alias("good"), *ends).first()
        if (every["good"] or 0) < 2:
            return Judge()
        low, high = (np.array([every[f"{name}{k}"] for k in range(len(FEATURES))]) for name in ("low", "high"))
        good = rows.where("quality = 1").select("features")
        forest = Forest(every["good"], low, high, lambda grown: _measure(good, grown))
        schema = pa.schema([("cell", pa.int32()), ("good", pa.int64()), ("bad", pa.int64())])

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                is_good, features = batch.column("quality").to_numpy() == 1, _matrix(batch)
                score = np.zeros(len(features))
                for side in (True, False):
                    score[is_good == side] = forest.score(features[is_good == side], own=int(side))
                cells, of = np.unique(np.rint(score * GRID).astype(np.int64), return_inverse=True)
                yield batch_of(schema, {"cell": cells} | {c: np.bincount(of[is_good == side], minlength=len(cells)) for c, side in (("good", True), ("bad", False))})

        counts = rows.mapInArrow(each, "cell int, good long, bad long").groupBy("cell").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow().sort_by("cell")
        return Judge(forest, *(counts.column(c).to_numpy() for c in ("cell", "good", "bad")))


def fit(docs: DataFrame, labels: DataFrame) -> Judge:
    """A judge from all labelled rows that pass the base rules."""
    return fit_measured(measured(docs), labels)


_VERDICT = pa.schema([*list(_MEASURED)[:-1], ("kept", pa.bool_()), ("anomaly", pa.float64())])


def verdicts(found: DataFrame, judge: Judge) -> DataFrame:
    """Base counts, base verdict, anomaly score and final verdict of every row of ``measured``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, rejected = judge.rejects(_matrix(batch))
            failed = batch.column("base_failed").to_numpy(zero_copy_only=False)
            out = {f.name: batch.column(f.name) for f in list(_MEASURED)[:-1]}
            yield batch_of(_VERDICT, out | {"anomaly": score, "kept": ~(failed | rejected)})

    return found.mapInArrow(each, f"{_KINDS}, kept boolean, anomaly double")


def judge_documents(docs: DataFrame, judge: Judge) -> DataFrame:
    return verdicts(measured(docs), judge)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Verdicts of all documents by a judge of all labelled ones; statistics are taken once."""

    def make() -> DataFrame:
        found = materialize(measured(docs))
        return verdicts(found, fit_measured(found, labels))

    return condensed(make)
