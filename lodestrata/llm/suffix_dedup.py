"""Exact removal of repeated passages with a suffix array.

A byte goes if a string of LENGTH bytes that covers it also starts earlier
(smaller doc_id, or the same document and an earlier place). "Window" below means
such a string.

1. Anchors: of the LENGTH - GRAM + 1 grams in a window the leftmost with the
   smallest hash is its anchor, so equal windows have equal anchors at equal places.
   The windows of one anchor form a segment, one short row.
2. Rows meet by the anchor's hash. Equal segments (by hash, 64 bits beside the
   anchor's 64) repeat each other as a whole; all but the first are repeats. Each
   task first settles its own rows in that way, so that a passage in very many
   documents sends one row per batch. Hot anchors, those in very many rows, are told from the
   counts of a fixed number of cells over one document in SAMPLE; their rows meet by anchor and segment instead,
   so no task holds all of them, and equal segments are folded as they stream by. The counts choose the
   way only, never a result.
3. Different segments with one anchor can share some of their windows only. Those
   that share a core (what all windows of a quarter of the anchor's places have in
   common) are fetched as bytes, the anchor written as one symbol, and sorted
   by the linear suffix sorter; equal windows are then neighbours in the suffix array,
   and all but the first are repeats. An anchor with more than HOT such segments, or a hot one (the edge of
   a passage in very many documents), is dealt into blocks of about that many; what each
   block's sort leaves, its distinct windows, meets by the window's hash, added up before the exchange.
4. The repeated windows of a document are joined into maximal runs and cut out.

Only the cells' counts and a bitmap, of limited size, are sent to the executors; nothing else but rows by hash and by
document is exchanged.

Defined cases: null texts are empty; texts shorter than LENGTH lose nothing; rows with
a null id are read by themselves and lose nothing; rows that repeat a doc_id are
read as one place, different texts included: their equal windows at equal starts don't repeat each other, and what one of them
loses the others lose at the same places; an empty table gives an empty one; long texts are read in overlapping
pieces, whole. Only ``doc_id`` and ``text`` are read; ``without_repeats`` keeps all other columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_chunks import slices
from .common import batch_of, condensed, free, id_and_bytes, marked, materialize, resident
from .shingles import mixed
from .suffix_sort import suffix_array

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM + 1  # grams in a window; the anchor's places
PARTS = 8
#: Window starts that are worked on at a time: longer texts are read in overlapping pieces.
PIECE = 1 << 19
#: Segments of one anchor that are sorted together.
HOT = 512
#: Documents of which one is looked at for hot anchors, cells that count them, and rows from which an anchor is hot.
SAMPLE, CELLS, HOT_ROWS = 16, 1 << 20, 4096
#: Symbols that are sorted at a time, unless one anchor's segments have more.
SORT_SYMBOLS = 1 << 14

_BASE = 0x9E3779B97F4A7C15
_edges = [round(k * SPAN / PARTS) for k in range(PARTS + 1)]
#: First and last place (bytes before the anchor) of each part.
PLACES = [(_edges[k], _edges[k + 1] - 1) for k in range(PARTS)]

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    if base not in _powers or len(_powers[base]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        out = np.empty(size, dtype=np.uint64)
        out[0], known = 1, 1
        while known < size:
            out[known : 2 * known] = out[:known] * np.uint64(pow(base, known, 2**64))
            known *= 2
        _powers[base] = out
    return _powers[base]


def gram_hashes(grams: list[bytes]) -> np.ndarray:
    """As ``segments`` hashes them."""
    data = np.frombuffer(b"".join(grams), dtype=np.uint8).reshape(-1, GRAM).astype(np.uint64) + np.uint64(1)
    return mixed((data * powers(_BASE, GRAM)[:GRAM]).sum(axis=1, dtype=np.uint64))


def segments(raw: bytes) -> tuple[np.ndarray, ...] | None:
    """(anchor hash, segment hash, first window, windows, anchor's place, core codes) of one piece."""
    data = np.frombuffer(raw, dtype=np.uint8)
    n = len(data)
    if n < LENGTH:
        return None
    up, down = powers(_BASE, n + 1), powers(pow(_BASE, -1, 2**64), n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashed = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    # hash in the high bits, place in the low ones: the minimum is the leftmost of the smallest
    low = np.uint64(2 * PIECE - 1)
    keys = (hashed & ~low) | np.arange(len(hashed), dtype=np.uint64)
    rows = -(-len(keys) // SPAN)
    padded = np.full(rows * SPAN, 2**64 - 1, dtype=np.uint64)
    padded[: len(keys)] = keys
    padded = padded.reshape(rows, SPAN)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - LENGTH + 1
    anchor = (np.minimum(back[:windows], ahead[SPAN - 1 : SPAN - 1 + windows]) & low).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    stop = np.append(first[1:], windows)
    anchor = anchor[first]

    def part(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))

    codes = np.zeros((len(first), PARTS), dtype=np.uint16)
    for k, (near, far) in enumerate(PLACES):
        held = (first <= anchor - near) & (stop - 1 >= anchor - far)  # has a window with such a place
        start, end = np.where(held, anchor - near, 0), np.where(held, anchor - far + LENGTH, 0)
        codes[:, k] = np.where(held, part(start, end) % np.uint64(65535) + np.uint64(1), 0)
    return hashed[anchor], part(first, stop - 1 + LENGTH), first, stop - first, anchor - first, codes


#: A segment's row: anchor hash, segment hash, document, first window with the anchor's place and the number of windows, core codes.
#: A negative place is a run of repeats: -1 - first window, with the number of windows in the second column.
_ROW = pa.schema([(c, pa.int64()) for c in ("meet", "h", "seg", "doc", "pos", "near", "far")])


def _runs(doc: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Adjoining runs of windows joined, by document."""
    order = np.lexsort((first, doc))
    doc, first, count = doc[order], first[order], count[order]
    fresh = np.append(True, (doc[1:] != doc[:-1]) | (first[1:] != first[:-1] + count[:-1])) if len(doc) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(fresh)
    return doc[at], first[at], np.add.reduceat(count, at) if len(at) else count


def _later(new: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of rows in groups that begin where ``new`` is: those at another place than their group's first one."""
    leader = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return (doc != doc[leader]) | (first != first[leader])


def _cell(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(40)).astype(np.int64) & (CELLS - 1)


def hot_anchors(docs: DataFrame, hot_rows: int = HOT_ROWS, sample: int = SAMPLE) -> np.ndarray:
    """Per cell of anchors: the rows to expect of a hot one, 0 for all others.

    A cell is hot if it has ``hot_rows`` rows and 8 times the mean, so that at most an eighth of the cells are, at any size.
    """
    schema = pa.schema([("cell", pa.int64()), ("n", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        seen = np.zeros(CELLS, dtype=np.int64)
        for batch in (part for whole in batches for part in slices(whole, 3 << 20)):
            for raw in batch.column(1).to_pylist():
                for at in range(0, max(0, len(raw or b"") - LENGTH + 1), PIECE):
                    seen += np.bincount(_cell(segments(raw[at : at + PIECE + LENGTH - 1])[0]), minlength=CELLS)
        found = np.flatnonzero(seen)
        yield batch_of(schema, {"cell": found, "n": seen[found]})

    some = id_and_bytes(docs).where("doc_id is not null").where(F.pmod(F.xxhash64("doc_id"), F.lit(sample)) == 0)
    counts = some.mapInArrow(each, "cell long, n long").groupBy("cell").agg((F.sum("n") * sample).alias("n"))
    counts = materialize(counts)
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / CELLS
    out = np.zeros(CELLS, dtype=np.int64)
    found = counts.where(F.col("n") >= max(hot_rows, 8 * mean)).toArrow()
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    free(counts)
    return out


def segment_rows(docs: DataFrame, hot_cells: Broadcast) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        for batch in (part for whole in batches for part in slices(whole, 3 << 20)):
            found = []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for at in range(0, max(0, len(raw or b"") - LENGTH + 1), PIECE):
                    h, seg, first, count, place, codes = segments(raw[at : at + PIECE + LENGTH - 1])
                    found.append((h, seg, np.full(len(h), key, dtype=np.int64), first + at, count, place, codes))
            if not found:
                continue
            h, seg, doc, first, count, place, codes = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((first, doc, seg, h))
            same = (h[order][1:] == h[order][:-1]) & (seg[order][1:] == seg[order][:-1])
            again, later = np.empty(len(h), dtype=bool), np.empty(len(h), dtype=bool)
            again[order] = np.append(False, same)
            later[order] = _later(~np.append(False, same), doc[order], first[order])
            run_doc, run_first, run_count = _runs(doc[later], first[later], count[later])
            pos = (first << 14) | (place << 7) | count
            near, far = codes[~again].view(np.int64).T
            none = np.zeros(len(run_doc), dtype=np.int64)
            meet = np.where(hot_cells.value[_cell(h)] > 0, mixed(h + seg * np.uint64(_BASE)), h)[~again].view(np.int64)
            anywhere = mixed(mixed(run_doc.view(np.uint64)) + run_first.astype(np.uint64)).view(np.int64)
            yield batch_of(_ROW, {
                "meet": np.concatenate([meet, anywhere]),
                "h": np.concatenate([h[~again].view(np.int64), anywhere]),
                "seg": np.concatenate([seg[~again].view(np.int64), run_count]),
                "doc": np.concatenate([doc[~again], run_doc]),
                "pos": np.concatenate([pos[~again], -1 - run_first]),
                "near": np.concatenate([near, none]),
                "far": np.concatenate([far, none]),
            })

    texts = id_and_bytes(docs).where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    return texts.mapInArrow(each, ", ".join(f"{c} long" for c in _ROW.names))


def _settle(hot: int, hot_cells: np.ndarray, _: np.ndarray, h: np.ndarray, seg: np.ndarray, doc: np.ndarray, pos: np.ndarray, near: np.ndarray, far: np.ndarray) -> dict:
    """Rows of whole anchors, sorted: repeats of whole segments, and segments to be sorted by bytes."""
    run = pos < 0
    out = [(np.zeros(run.sum(), dtype=np.int64), doc[run], -1 - pos[run], seg[run], h[run], h[run])]
    h, seg, doc, pos, codes = h[~run], seg[~run], doc[~run], pos[~run], np.column_stack([near[~run], far[~run]])
    if len(h):
        new_h = np.append(True, h[1:] != h[:-1])
        new = new_h | np.append(True, seg[1:] != seg[:-1])
        later = _later(new, doc, pos >> 14)
        out.append((np.zeros(later.sum(), dtype=np.int64), doc[later], pos[later] >> 14, pos[later] & 127, h[later], h[later]))
        group = (np.cumsum(new_h) - 1)[new]
        rows = hot_cells[_cell(h[new])]
        several = (np.bincount(group)[group] > 1) | (rows > 0)
        group, h, doc, pos, rows = group[several], h[new][several], doc[new][several], pos[new][several], rows[several]
        codes = np.ascontiguousarray(codes[new][several]).view(np.uint16).reshape(-1, PARTS).astype(np.int64)
        parts = np.zeros(len(h), dtype=np.int64)
        for k in range(PARTS):
            _, which, n = np.unique(group << 16 | codes[:, k], return_inverse=True, return_counts=True)
            # of a hot anchor this task knows some segments only: any part may be shared
            parts |= (((n[which] > 1) | (rows > 0)) & (codes[:, k] > 0)).astype(np.int64) << k
        some = parts > 0
        first, place, count = pos[some] >> 14, (pos[some] >> 7) & 127, pos[some] & 127
        doc, anchor = doc[some], h[some]
        _, which, n = np.unique(anchor, return_inverse=True, return_counts=True)
        # a hot anchor has several blocks in any case: its segments are in other tasks too
        blocks = np.where(rows[some] > 0, np.maximum(2, -(-rows[some] // hot)), -(-n // hot)[which])
        block = mixed(mixed(doc.view(np.uint64)) + first.astype(np.uint64)) % blocks.astype(np.uint64)
        key = np.where(blocks > 1, mixed(anchor.view(np.uint64) + block * np.uint64(_BASE)).view(np.int64), anchor)
        # kind: 1 and above it the parts, the anchor's place, the number of windows, and whether there are several blocks
        out.append((1 | (parts[some] << 1) | (place << 9) | (count << 16) | ((blocks > 1).astype(np.int64) << 24), doc, first, count, key, anchor))
    return dict(zip(_SETTLED.names, (np.concatenate(x) for x in zip(*out, strict=True)), strict=True))


_SETTLED = pa.schema([(c, pa.int64()) for c in ("kind", "doc", "first", "count", "h", "anchor")])


def settled(rows: DataFrame, hot_cells: Broadcast, hot: int = HOT, most: int = 1 << 18) -> DataFrame:
    """(kind 0: repeats doc, first, count; kind 1: segments to compare by bytes)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        settle = lambda parts: batch_of(_SETTLED, _settle(hot, hot_cells.value, *(np.concatenate(x) for x in zip(*parts, strict=True))))
        for batch in batches:
            columns = tuple(batch.column(k).to_numpy() for k in range(len(_ROW)))
            if not len(columns[0]):
                continue
            change = np.flatnonzero(columns[0][1:] != columns[0][:-1])
            if held and held[-1][0][-1] != columns[0][0] or len(change):
                cut = change[-1] + 1 if len(change) else 0
                whole = [tuple(c[:cut] for c in columns)] if cut else []
                yield settle([*held, *whole])
                held = [tuple(c[cut:] for c in columns)]
            else:
                held.append(columns)
                if sum(len(c[0]) for c in held) > most and hot_cells.value[_cell(held[0][1][:1])][0]:
                    # one segment of a hot anchor: all rows but the first are repeats of it, and are let go
                    h, doc, pos = (np.concatenate([c[k] for c in held]) for k in (1, 3, 4))
                    later = _later(np.arange(len(doc)) == 0, doc, pos >> 14)
                    zero = np.zeros(int(later.sum()), dtype=np.int64)
                    yield batch_of(_SETTLED, dict(zip(_SETTLED.names, (zero, doc[later], pos[later] >> 14, pos[later] & 127, h[later], h[later]), strict=True)))
                    held = [tuple(c[:1] for c in held[0])]
        if held:
            yield settle(held)

    ordered = rows.repartition("meet").sortWithinPartitions("meet", "h", "seg", "doc", "pos")
    return ordered.mapInArrow(each, ", ".join(f"{c} long" for c in _SETTLED.names))


_STRING = pa.schema([*((c, pa.int64()) for c in ("h", "anchor", "hot", "doc", "first", "place", "windows")), ("bytes", pa.binary())])


def strings(docs: DataFrame, segments_: DataFrame) -> DataFrame:
    """The bytes of the windows to compare, one row per segment: document, first window, anchor's place in it, windows."""
    wanted = segments_.groupBy("doc").agg(F.collect_list(F.struct("first", "kind", "h", "anchor")).alias("of"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 3 << 20)):
            found, grams = [], []
            lists = batch.column(2)
            for k, (key, raw) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                raw = raw or b""
                for x in lists[k].as_py():
                    kind, first = x["kind"], x["first"]
                    parts, place, count = (kind >> 1) & 255, (kind >> 9) & 127, (kind >> 16) & 127
                    if first + count - 1 + LENGTH > len(raw):
                        continue  # the place of another row with this id
                    ends = [PLACES[q] for q in range(PARTS) if parts >> q & 1]
                    start = first + max(0, place - ends[-1][1])
                    stop = first + min(count, place - ends[0][0] + 1)
                    found.append((x["h"], x["anchor"], kind >> 24, key, start, place - (start - first), stop - start, raw[start : stop - 1 + LENGTH]))
                    grams.append(raw[first + place : first + place + GRAM])
            # a row with the same id and another text may have another anchor there
            same = gram_hashes(grams) == np.array([x[1] for x in found], dtype=np.int64).view(np.uint64)
            found = [x for x, s in zip(found, same.tolist(), strict=True) if s]
            out = {f.name: [x[k] for x in found] for k, f in enumerate(_STRING)}
            yield batch_of(_STRING, out)

    texts = marked(docs, segments_.select(F.col("doc").alias("id")).distinct())
    joined = texts.join(wanted, texts["doc_id"] == wanted["doc"]).select("doc_id", "raw", "of")
    return joined.mapInArrow(each, ", ".join(f"{c} long" for c in _STRING.names[:-1]) + ", bytes binary")


_SORTED = pa.schema([(c, pa.int64()) for c in ("doc", "first", "count", "high", "low")])
_WEIGHTS = mixed(np.arange(1, 2 * SPAN + 1, dtype=np.uint64) * np.uint64(_BASE)).reshape(SPAN, 2) | np.uint64(1)


def repeated_windows(rows: list[tuple]) -> dict[str, np.ndarray]:
    """What the windows of ``rows`` (as in ``strings``) repeat: runs of windows with an earlier equal one.

    All strings go into one sequence of symbols: bytes, one symbol above them for each anchor, and
    an end. A window is SPAN symbols long, from at most SPAN - 1 before the
    anchor, and equal windows are neighbours in the suffix array. Of anchors with several
    blocks the first of each equal windows comes out too, with a 128-bit hash (count 0).
    """
    pieces, starts, of_row, at, names = [], [], [], 0, {}
    for k, (h, _, _, _, _, place, windows, raw) in enumerate(rows):
        name = names.setdefault(h, len(names)) + 257
        data = np.frombuffer(raw, dtype=np.uint8).astype(np.int32) + 1
        # the anchor is at ``place`` of the string, whole
        pieces += [data[:place], np.array([name], dtype=np.int32), data[place + GRAM :], np.zeros(1, dtype=np.int32)]
        starts.append(np.arange(windows) + at)
        of_row.append(np.full(windows, k))
        at += len(data) - GRAM + 2
    symbols, where, row = np.concatenate(pieces), np.concatenate(starts), np.concatenate(of_row)
    numbers = np.array([r[1:6] for r in rows], dtype=np.int64)
    string_at = np.array([x[0] for x in starts])
    row_of = np.full(at, -1)
    row_of[where] = row
    order = suffix_array(np.append(symbols + 1, 0))[1:]
    order = order[row_of[order] >= 0]
    view = np.lib.stride_tricks.sliding_window_view(np.append(symbols, np.zeros(SPAN, dtype=np.int32)), SPAN)
    group = np.cumsum(np.append(False, (view[order[1:]] != view[order[:-1]]).any(axis=1)))
    row = row_of[order]
    offset = order - string_at[row]
    anchor, hot, doc, first, place = numbers[row].T
    first, place = first + offset, place - offset
    by = np.lexsort((first, doc, group))
    new = np.append(True, group[by][1:] != group[by][:-1])
    again = by[_later(new, doc[by], first[by])]
    runs = _runs(doc[again], first[again], np.ones(len(again), dtype=np.int64))
    left = by[new & (hot[by] > 0)]
    window = view[order[left]].astype(np.uint64)
    window[np.arange(len(left)), place[left]] = anchor[left].view(np.uint64)
    high, low = (mixed((window * _WEIGHTS[:, k]).sum(axis=1, dtype=np.uint64)).view(np.int64) for k in (0, 1))
    none = np.zeros(len(runs[0]), dtype=np.int64)
    columns = zip((*runs, none, none), (doc[left], first[left], np.zeros(len(left), dtype=np.int64), high, low), strict=True)
    return dict(zip(_SORTED.names, (np.concatenate(x) for x in columns), strict=True))


def sorted_repeats(rows: DataFrame) -> DataFrame:
    """(doc, first, count) of repeats among segments that share an anchor only."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        held, symbols, key = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != key and symbols >= SORT_SYMBOLS:
                    yield batch_of(_SORTED, repeated_windows(held))
                    held, symbols = [], 0
                key = row[0]
                held.append(row)
                symbols += len(row[-1]) - GRAM + 2
        if held:
            yield batch_of(_SORTED, repeated_windows(held))

    # a fixed number of tasks: sorting takes far more time than its bytes suggest
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(tasks, "h").sortWithinPartitions("h")
    found = materialize(ordered.mapInArrow(each, ", ".join(f"{c} long" for c in _SORTED.names)))
    left = found.where("count = 0")
    least = left.groupBy("high", "low").agg(F.min(F.struct("doc", "first")).alias("least"))
    again = left.join(least, ["high", "low"]).where(F.struct("doc", "first") != F.col("least")).select("doc", "first", F.lit(1).cast("long").alias("count"))
    return found.where("count > 0").select("doc", "first", "count").union(again)


def repeats(docs: DataFrame, hot: int = HOT, hot_rows: int = HOT_ROWS, sample: int = SAMPLE) -> DataFrame:
    """(doc, runs): per document the runs of repeated windows as (first, count)."""
    hot_cells = docs.sparkSession.sparkContext.broadcast(hot_anchors(docs, hot_rows, sample))
    known = materialize(settled(segment_rows(docs, hot_cells), hot_cells, hot))
    whole = known.where("kind = 0").select("doc", "first", "count")
    partial = sorted_repeats(strings(docs, known.where("kind <> 0")))
    runs = materialize(whole.union(partial))
    return runs.groupBy("doc").agg(F.collect_list(F.struct("first", "count")).alias("runs"))


def kept_and_runs(raw: bytes, runs: list[dict] | None) -> tuple[np.ndarray, int]:
    """(which bytes stay, number of maximal removed runs)."""
    change = np.zeros(len(raw) + 1, dtype=np.int64)
    if runs:
        first = np.array([r["first"] for r in runs])
        end = first + np.array([r["count"] for r in runs]) + LENGTH - 1
        np.add.at(change, np.minimum(first, len(raw)), 1)
        np.add.at(change, np.minimum(end, len(raw)), -1)
    gone = np.cumsum(change)[:-1] > 0
    return ~gone, int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())


def cut(docs: DataFrame, make: Callable[[bytes, np.ndarray, int], tuple], schema: pa.Schema, kinds: str, **how: int) -> DataFrame:
    """``make(raw, kept, n_spans)`` of every document that loses bytes, with its doc_id."""
    found = condensed(lambda: repeats(docs, **how))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 3 << 20)):
            out: dict[str, list] = {f.name: [] for f in schema}
            runs = batch.column(2)
            for k, (key, raw) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                raw = raw or b""
                for name, value in zip(out, (key, *make(raw, *kept_and_runs(raw, runs[k].as_py()))), strict=True):
                    out[name].append(value)
            yield batch_of(schema, out)

    texts = marked(docs, found.select(F.col("doc").alias("id")))
    joined = texts.join(found, texts["doc_id"] == found["doc"]).select("doc_id", "raw", "runs")
    return joined.mapInArrow(each, kinds)


_CUT = pa.schema([("doc_id", pa.int64()), ("was_sha256", pa.string()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def remove_repeats(docs: DataFrame, **how: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""

    def make(raw: bytes, kept: np.ndarray, spans: int) -> tuple:
        rest = np.frombuffer(raw, dtype=np.uint8)[kept].tobytes()
        return hashlib.sha256(raw).hexdigest(), len(raw) - len(rest), spans, hashlib.sha256(rest).hexdigest()

    lost = cut(docs, make, _CUT, "doc_id long, was_sha256 string, n_removed long, n_spans long, kept_sha256 string", **how).dropDuplicates(["doc_id", "was_sha256"])
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    every = docs.select("doc_id", F.length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("was_sha256"))
    zero = F.lit(0).cast("long")
    return every.join(lost, ["doc_id", "was_sha256"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "was_sha256").alias("kept_sha256"),
    )


_TEXT = pa.schema([("doc_id", pa.int64()), ("was_sha256", pa.string()), ("kept_text", pa.string())])


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``.

    A character of which some bytes stay keeps them all, so the text stays valid.
    """

    def make(raw: bytes, kept: np.ndarray, spans: int) -> tuple:
        data = np.frombuffer(raw, dtype=np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        whole = np.zeros(character[-1] + 1, dtype=bool)
        np.logical_or.at(whole, character, kept)
        return hashlib.sha256(raw).hexdigest(), data[whole[character]].tobytes().decode("utf-8", "replace")

    lost = cut(docs, make, _TEXT, "doc_id long, was_sha256 string, kept_text string").dropDuplicates(["doc_id", "was_sha256"])
    lost = lost.select(F.col("doc_id").alias("id"), F.col("was_sha256").alias("was"), F.col("kept_text").alias("kept"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256).alias("now"))
    joined = rows.join(lost, (F.col("row.doc_id") == F.col("id")) & (F.col("now") == F.col("was")), "left")
    own = lambda c: F.col(f"row.`{c}`")
    return joined.select(*((F.coalesce("kept", own("text")) if c == "text" else own(c)).alias(c) for c in docs.columns))
