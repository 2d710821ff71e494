"""Near duplicates and exact repeats: against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import minhash_odd, suffix_dedup
from lodestrata.llm.shingles import shingle_sets
from lodestrata.llm.suffix_sort import suffix_array

EXTRA = "doc_id long, text string, component_id string, runs int, id long"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], EXTRA)


def near_copies(seed: int, n: int = 120) -> list[tuple[int | None, str | None]]:
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 6)))
    bases = [[word() for _ in range(draw.choice([2, 5, 40, 200, 400]))] for _ in range(12)]
    rows = []
    for k in range(n):
        words = list(draw.choice(bases))
        for _ in range(draw.choice([0, 0, 1, 2, 4, 8, 20])):
            words[draw.randrange(len(words))] = word()
        rows.append((k * 3 % 1000 + 7, " ".join(w.upper() if draw.random() < 0.1 else w for w in words)))
    return [*rows, (1, None), (2, ""), (3, " \t\n"), (None, rows[0][1]), rows[5], rows[5]]


def shingles(text: str | None, size: int) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else frozenset([tuple(words)] if words else [])


def brute_components(rows, size: int, percent: int):
    sets = {d: shingles(t, size) for d, t in rows if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("seed", "size", "percent"), [(1, 3, 85), (2, 5, 80)])
def test_near_duplicates_equal_brute_force(spark, seed, size, percent):
    rows = near_copies(seed)
    got = minhash_odd.near_duplicates(table(spark, rows), size, percent).collect()
    assert len(got) == len(rows)
    want = brute_components(rows, size, percent)
    for r in got:
        if r.doc_id is None:
            assert (r.component_id, r.kept) == (None, False)
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_blocks_of_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash_odd, "BLOCK", 4)
    rows = near_copies(3)
    want = brute_components(rows, 3, 85)
    for r in minhash_odd.near_duplicates(table(spark, rows)).collect():
        assert r.doc_id is None or r.component_id == want[r.doc_id][1]


def test_pairs_of_one_hot_member_are_dealt_over_many_keys(spark):
    pairs = spark.range(1, 5001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).union(spark.createDataFrame([(7, 9)], "a long, b long"))
    values = spark.range(5001).select("id", (F.col("id") * 10).alias("of"))
    got = minhash_odd.both_ends(pairs, values)
    assert got.columns == ["b", "a", "of_a", "of_b"]
    assert sorted((r.a, r.b, r.of_a, r.of_b) for r in got.collect()) == sorted([*((0, b, 0, 10 * b) for b in range(1, 5001)), (7, 9, 70, 90)])
    keys = pairs.where("a = 0").groupBy(F.pmod(F.xxhash64("b"), F.lit(minhash_odd.SALTS))).count().collect()
    assert len(keys) == minhash_odd.SALTS and max(r["count"] for r in keys) < 60


def test_near_duplicates_of_nothing(spark):
    assert minhash_odd.near_duplicates(table(spark, []).limit(0)).count() == 0
    assert [r.kept for r in minhash_odd.near_duplicates(table(spark, [(1, None)])).collect()] == [True]


def test_shingles_ignore_case_of_ascii_letters_only():
    one, two, other = shingle_sets([b"Alpha  beta\tgamma DELTA", b"alpha beta gamma delta", "alpha beta gamma deltÉ".encode()], 3)
    assert (one == two).all() and len(one) == 2
    assert not np.isin(other, one).all()
    few, more, none = shingle_sets([b"a b", b"a  B ", b" \n"], 3)
    assert (few == more).all() and len(few) == 1 and len(none) == 0


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(4)
    common, own = rng.integers(0, 2**63, 900, dtype=np.uint64), rng.integers(0, 2**63, 200, dtype=np.uint64)
    for extra, j in ((50, 0.9), (0, 1.0), (112, 0.8)):
        samples = np.array([minhash_odd.minima(np.concatenate([common, own[:extra]])), minhash_odd.minima(np.concatenate([common, own[100 : 100 + extra // 1]]) if extra <= 100 else np.concatenate([common, own[:112][::-1] + np.uint64(1)]))])
        one, two = minhash_odd.odd_sketches(samples)
        real = 900 / (900 + 2 * extra)
        assert abs(int(np.bitwise_count(one ^ two).sum()) - minhash_odd.most_different_bits(real)) < 110
        assert j >= real - 0.1


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array_equals_sorting(seed):
    rng = np.random.default_rng(seed)
    for _ in range(40):
        n, letters = rng.integers(0, 60), rng.integers(1, 5)
        symbols = np.append(rng.integers(1, 1 + letters, n), 0)
        items = symbols.tolist()
        assert suffix_array(symbols).tolist() == sorted(range(len(items)), key=lambda i: items[i:])


def brute_repeats(rows, length: int = 100):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for k in range(len(raw) - length + 1):
            window = raw[k : k + length]
            if window in seen:
                gone[k : k + length] = True
            seen.add(window)
        rest = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
        out[doc_id] = (len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(rest).hexdigest())
    return out


def repeating(seed: int) -> list[tuple[int, str | None]]:
    draw = random.Random(seed)
    line = lambda n: "".join(draw.choice("abcdé \n") for _ in range(n))
    shared = [line(draw.choice([60, 99, 100, 101, 150, 400, 1500])) for _ in range(15)]
    rows = []
    for k in range(80):
        parts = [draw.choice(shared) if draw.random() < 0.6 else line(draw.randint(0, 300)) for _ in range(draw.randint(0, 5))]
        rows.append((k * 7 % 401, "".join(parts)))
    rows[3] = (rows[3][0], rows[2][1])
    return [*rows, (1000, None), (1001, ""), (1002, "a" * 5000), (1003, "ab" * 1000), (1004, "x" * 99), (1005, "a" * 5000 + "b"), (1006, "abc" * 700 + "a" * 120)]


@pytest.mark.parametrize("seed", range(3))
def test_repeats_equal_brute_force(spark, seed):
    rows = repeating(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(table(spark, rows)).collect()}
    assert got == brute_repeats(rows)


@pytest.mark.parametrize("hot", [1, 3])
def test_blocks_of_hot_anchors_lose_no_repeat(spark, hot):
    draw = random.Random(hot)
    passage = "".join(draw.choice("abcdefgh ") for _ in range(130))
    rows = repeating(4) + [(2000 + k, "".join(draw.choice("xy") for _ in range(draw.randint(0, 4))) + passage + "".join(draw.choice("xy") for _ in range(draw.randint(0, 4)))) for k in range(60)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(table(spark, rows), hot=hot).collect()}
    assert got == brute_repeats(rows)


@pytest.mark.parametrize(("hot_rows", "sample"), [(1, 1), (5, 1), (20, 3)])
def test_a_line_in_all_rows_is_dealt_to_many_tasks(spark, hot_rows, sample):
    draw = random.Random(hot_rows)
    line = "".join(draw.choice("abcdefgh ") for _ in range(210))
    rows = [(k, f"{''.join(draw.choice('xyz') for _ in range(90))}{line}{''.join(draw.choice('uvw') for _ in range(90))}") for k in range(120)]
    rows += [(40000 + d, t) for d, t in repeating(7)[70:]]
    rows += [(5000, line), (5001, line[3:]), (5002, "x" * 3000)]
    docs = table(spark, rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, hot=4, hot_rows=hot_rows, sample=sample).collect()}
    assert got == brute_repeats(rows)
    cells = docs.sparkSession.sparkContext.broadcast(suffix_dedup.hot_anchors(docs, hot_rows, 1))
    assert (cells.value > 0).any()
    # the segments at the line's edges all have one anchor; none of their meeting places holds more than a few
    found = suffix_dedup.segment_rows(docs, cells)
    hottest = found.where("pos >= 0").groupBy("h").count().orderBy(F.desc("count")).first()
    assert hottest["count"] >= 100
    assert found.where(F.col("h") == hottest["h"]).groupBy("meet").count().agg(F.max("count")).first()[0] <= 8


def test_different_texts_with_one_id(spark):
    draw = random.Random(11)
    rows = repeating(5)
    again = [(d, "".join(draw.choice("abc") for _ in range(draw.randint(0, 200))) + (t or "")[: draw.randint(0, 300)]) for d, t in rows]
    out = suffix_dedup.remove_repeats(table(spark, rows + again), hot=2, hot_rows=1, sample=1).collect()
    assert len(out) == 2 * len(rows) and all(0 <= r.n_removed <= r.n_bytes for r in out)


def test_streamed_rows_of_one_segment_are_folded(spark):
    draw = random.Random(2)
    line = "".join(draw.choice("abcdefgh") for _ in range(150))
    docs = table(spark, [(k, line) for k in range(300)])
    cells = spark.sparkContext.broadcast(np.full(suffix_dedup.CELLS, 9, dtype=np.int64))
    segments = suffix_dedup.segment_rows(docs.repartition(40), cells)
    whole, folded = (sorted(map(tuple, suffix_dedup.settled(segments, cells, most=n).where("kind = 0").select("doc", "first", "count").collect())) for n in (1 << 18, 2))
    assert whole == folded and {d for d, _, _ in whole} == set(range(1, 300))


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    rows = repeating(9)
    whole = brute_repeats(rows)
    monkeypatch.setattr(suffix_dedup, "PIECE", 512)
    for raw in (b"q" * 3000, "".join(t or "" for _, t in rows).encode()[:9000]):
        for at in range(0, len(raw) - 99, 512):
            assert suffix_dedup.segments(raw[at : at + 512 + 99])[2].max() < 512
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(table(spark, rows)).collect()}
    assert got == {d: v[1] for d, v in whole.items()}


def test_repeated_and_null_ids(spark):
    text = "".join(chr(97 + (k * k + k // 26) % 26) for k in range(150))
    assert brute_repeats([(1, text)])[1][1] == 0
    got = suffix_dedup.remove_repeats(table(spark, [(None, text), (5, text), (5, text), (9, text)])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 0), (5, 0), (5, 0), (9, 150)]
    assert suffix_dedup.remove_repeats(table(spark, []).limit(0)).count() == 0


def test_cut_texts_stay_valid(spark):
    text = "é" * 130
    out = suffix_dedup.without_repeats(table(spark, [(1, text + "tail"), (2, "x" + text + "end"), (3, None)]))
    assert out.columns == ["doc_id", "text", "component_id", "runs", "id"]
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept[3] is None
    # within one document, too, all but the first window of the run of one letter goes
    assert kept[1].endswith("tail") and kept[2].startswith("x") and kept[2].endswith("end") and "�" not in kept[1] + kept[2]
    assert "é" not in kept[2]


@pytest.mark.parametrize("jaccard", [0.6, 0.8, 0.85])
def test_sketch_limit_follows_the_spread_at_the_threshold(jaccard):
    draw = np.random.default_rng(5)
    limit = minhash_odd.bits_limit(jaccard)
    far = []
    for differ in draw.binomial(minhash_odd.SAMPLES, 1 - jaccard, 20_000):
        hits = np.bincount(draw.integers(0, minhash_odd.SKETCH_BITS, 2 * differ), minlength=minhash_odd.SKETCH_BITS)
        far.append(int((hits & 1).sum()))
    spread = np.std(far)
    assert max(far) <= limit and 4.5 * spread < limit - np.mean(far) < 5.5 * spread
