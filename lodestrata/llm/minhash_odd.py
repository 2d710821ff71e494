"""MinHash near-duplicates with odd sketches.

1. Every text becomes the set of its distinct hashed word shingles. Equal sets
   form a class with the smallest doc_id as its representative; only
   representatives go on.
2. MinHash: SAMPLES minima per set. BANDS times some of them make the band keys;
   a bucket is the set of representatives with one band key.
3. Odd sketch: the samples are folded into a parity bitmap of SKETCH_BITS bits (sample i
   with value v toggles bit h(i, v)). For two sets the population count of the XOR is
   about n/2 (1 - exp(-2d/n)) with d = 2 SAMPLES (1 - J), which is precise where J
   is high. Pairs that differ in no more bits than one at the threshold does, but for a chance of MISS,
   are verified on their full sets.
4. Links inside a bucket are first sought with its smallest member only.
   Connected components of the verified links are formed by alternating large and small
   stars. Only buckets that still hold several components are compared member
   by member, and only across components, in blocks of at most BLOCK members, so
   that no task sees more than two blocks; a pair is looked at in the first band that it shares. Links found there
   and verified complete the components.

A pair at the threshold shares no band with probability below 1e-5 (3e-7 at 0.85) and
exceeds the sketches' limit with probability below 1e-6 (for ideal samples); farther above, both vanish. Shingles are told apart by 64-bit
hashes, classes by 128-bit sums over them.

Nothing but a bitmap of fixed size (see ``marked``) reaches the driver.

Defined cases: null, empty or blank texts have an empty set and are linked with nothing, as is a
row with a null id; fewer words than a shingle make one shingle; rows that repeat a doc_id are one
node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe_chunks import slices
from .common import batch_of, id_and_bytes, marked, materialize, resident
from .shingles import mixed, shingle_sets

SHINGLE = 3
LINK_PERCENT = 85
SAMPLES = 1024
BANDS = 32
#: Most samples in a band key; lower thresholds take fewer (see ``band_rows``).
MOST_ROWS = 6
SKETCH_BITS = 2048
#: Chance that a pair at the threshold has sketches too far apart to be verified.
MISS = 1e-6
BLOCK = 4096
#: Keys over which the pairs of one smallest member are dealt.
SALTS = 256

_WORDS = SKETCH_BITS // 64
_FACTORS = np.random.default_rng(6).integers(0, 2**64, SAMPLES, dtype=np.uint64) | np.uint64(1)
_PLACES = mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64))


def most_different_bits(jaccard: float) -> int:
    """Population count of the XOR that a pair of this similarity is expected to have."""
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - jaccard) / SKETCH_BITS)))


def bits_limit(jaccard: float) -> int:
    """Least population count of the XOR that a pair of this similarity exceeds with a chance below MISS.

    Exact for ideal samples: as many differ as a binomial draw says, and each that
    differs toggles two bits at random.
    """
    if not 0 < jaccard < 1:
        return 0 if jaccard >= 1 else SKETCH_BITS
    odd = np.arange(SKETCH_BITS + 1) / SKETCH_BITS
    now, above = np.zeros(SKETCH_BITS + 1), np.zeros(SKETCH_BITS + 1)
    now[0] = 1.0
    for differ in range(SAMPLES + 1):
        ways = math.lgamma(SAMPLES + 1) - math.lgamma(differ + 1) - math.lgamma(SAMPLES - differ + 1)
        above += now * math.exp(ways + differ * math.log(1 - jaccard) + (SAMPLES - differ) * math.log(jaccard))
        for _ in range(2):
            up, down = now * (1 - odd), now * odd
            now = np.append(0.0, up[:-1]) + np.append(down[1:], 0.0)
    return int(np.flatnonzero(np.cumsum(above[::-1])[::-1] >= MISS)[-1])


def minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(SAMPLES, 2**64 - 1, dtype=np.uint64)
    for k in range(0, len(hashes), 256):
        np.minimum(out, (hashes[k : k + 256, None] * _FACTORS).min(axis=0), out=out)
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps, as 64-bit words, of rows of samples."""
    bits = (mixed(samples ^ _PLACES) % np.uint64(SKETCH_BITS)).astype(np.int64)
    rows = np.arange(len(bits))[:, None] * SKETCH_BITS
    parity = np.bincount((rows + bits).ravel(), minlength=len(bits) * SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.uint64).reshape(len(bits), _WORDS)


def band_rows(jaccard: float) -> int:
    """Samples per band, as many as keep the chance to miss a pair at the threshold below 1e-5."""
    return max([r for r in range(1, MOST_ROWS + 1) if (1 - jaccard**r) ** BANDS < 1e-5], default=1)


def band_keys(samples: np.ndarray, rows: int) -> np.ndarray:
    parts = samples[:, : BANDS * rows].reshape(len(samples), BANDS, rows)
    keys = np.broadcast_to(_PLACES[:BANDS], (len(samples), BANDS)).copy()
    for k in range(rows):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys


def set_hash(hashes: np.ndarray) -> tuple[int, int]:
    two = (mixed(hashes ^ _PLACES[k]).sum(dtype=np.uint64) + np.uint64(len(hashes)) for k in (0, 1))
    return tuple(int(x.view(np.int64)) for x in two)


def signatures(docs: DataFrame, size: int = SHINGLE, percent: int = LINK_PERCENT) -> DataFrame:
    """(doc_id, n_shingles, set_hi, set_lo, odd, bands) of every row."""
    rows = band_rows(percent / 100)
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hi", pa.int64()), ("set_lo", pa.int64()),
        ("odd", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64())),
    ])

    def lists(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], pa.array(values.view(np.int64).ravel()))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        for batch in (part for whole in batches for part in slices(whole, 2 << 20)):
            sets = shingle_sets([x or b"" for x in batch.column(1).to_pylist()], size)
            samples = np.array([minima(x) for x in sets]).reshape(len(sets), SAMPLES)
            hi, lo = zip(*(set_hash(x) for x in sets), strict=True)
            columns = [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()),
                       lists(odd_sketches(samples)), lists(band_keys(samples, rows))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return id_and_bytes(docs).mapInArrow(each, "doc_id long, n_shingles long, set_hi long, set_lo long, odd array<bigint>, bands array<bigint>")


def full_sets(docs: DataFrame, ids: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(id, hashes) for at least all rows whose id is in ``ids``; no text is shuffled."""
    schema = pa.schema([("id", pa.int64()), ("hashes", pa.binary())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for whole in batches for part in slices(whole, 2 << 20)):
            sets = shingle_sets([x or b"" for x in part.column(1).to_pylist()], size)
            yield batch_of(schema, {"id": part.column(0).to_pylist(), "hashes": [x.tobytes() for x in sets]})

    return marked(docs, ids, each, "id long, hashes binary")


def both_ends(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """``pairs`` (a, b), a written step, with the columns of ``values`` (id, ...) for both ends, named ..._a and ..._b.

    The smallest member of a large bucket is ``a`` in as many pairs as the bucket has members, so the pairs
    of one ``a`` are dealt over SALTS keys, each with its own copy of the values (never more copies than pairs).
    """
    ends = [values.select(*(F.col(c).alias(s if c == "id" else f"{c}_{s}") for c in values.columns)) for s in "ab"]
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt"))
    copies = dealt.select("a", "salt").distinct().join(ends[0], "a")
    return dealt.join(copies, ["a", "salt"]).join(ends[1], "b").drop("salt")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets are similar enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(one, two, assume_unique=True))
                linked.append(100 * both >= percent * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(linked, pa.bool_()))

    return both_ends(pairs, sets.select("id", F.col("hashes").alias("of"))).select("a", "b", "of_a", "of_b").mapInArrow(each, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of all ends of ``edges`` (a, b), root the smallest id connected.

    Alternating large and small stars: every step links nodes to the smallest
    neighbour they know, until nothing changes.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        # large star: of a node's neighbours the larger ones are tied to its smallest neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node's smaller neighbours and the node itself are tied to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.sum(F.xxhash64("v", "u") % 998_244_353)).first()
        if now == before or not now[0]:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def across_components(members: DataFrame, bits: int) -> DataFrame:
    """Pairs (a, b) of different components whose sketches are close, from
    (k, x, y, block, id, comp, odd, bands): buckets k, or two blocks x, y of a large one."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def close(key: tuple, held: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        block, ids, comp = (np.concatenate([h[k] for h in held]) for k in range(3))
        odd, bands = (np.concatenate([h[k] for h in held]) for k in (3, 4))
        for k in range(len(ids) - 1):
            other = comp[k + 1 :] != comp[k]
            if key[1] != key[2]:
                other &= block[k + 1 :] != block[k]
            at = np.flatnonzero(other) + k + 1
            if len(at):
                at = at[np.bitwise_count(odd[at] ^ odd[k]).sum(axis=1, dtype=np.int64) <= bits]
            if len(at):
                shared = bands[at] == bands[k]
                at = at[bands[k][shared.argmax(axis=1)] == key[0]]  # else an earlier band has the pair
                yield np.minimum(ids[k], ids[at]), np.maximum(ids[k], ids[at])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            found = list(close(key, held)) if held else []
            if found:
                yield batch_of(schema, {"a": np.concatenate([x for x, _ in found]), "b": np.concatenate([x for _, x in found])})

        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in range(3)]
            cut = np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1])) + 1
            for start, stop in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
                if start == stop:
                    continue
                mine = tuple(int(c[start]) for c in keys)
                if mine != key:
                    yield from flush()
                    key, held = mine, []
                part = batch.slice(start, stop - start)
                lists = [part.column(c).flatten().to_numpy().reshape(stop - start, -1) for c in (6, 7)]
                held.append((*(part.column(c).to_numpy() for c in (3, 4, 5)), lists[0].view(np.uint64), lists[1]))
        yield from flush()

    ordered = members.select("k", "x", "y", "block", "id", "comp", "odd", "bands").repartition("k", "x", "y").sortWithinPartitions("k", "x", "y")
    return ordered.mapInArrow(each, "a long, b long").distinct()


def _blocks(members: Column) -> Column:
    return F.ceil(members / BLOCK).cast("int")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = LINK_PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    bits = bits_limit(percent / 100)
    rows = materialize(signatures(docs, size, percent))
    real = rows.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(real.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("doc_id")))
    reps = materialize(real.join(classes, ["set_hi", "set_lo", "doc_id"], "left_semi").select(F.col("doc_id").alias("id"), "odd", "bands").dropDuplicates(["id"]))

    keyed = reps.select("id", F.explode("bands").alias("k"))
    shared = keyed.groupBy("k").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most")
    members = materialize(keyed.join(shared, "k"))
    near = members.select("id").distinct()
    sketches = materialize(reps.join(near, "id", "left_semi"))
    sets = materialize(full_sets(docs, near, size))

    stars = materialize(members.where("id > least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct())
    apart = F.aggregate(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)
    likely = materialize(both_ends(stars, sketches.select("id", "odd")).where(apart <= bits).select("a", "b"))
    found = components(verified(likely, sets, percent))

    tied = members.join(found, "id", "left").select("k", "id", F.coalesce("root", "id").alias("comp"))
    sizes = tied.groupBy("k", "comp").agg(F.count("*").alias("n"))
    split = sizes.groupBy("k").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("comps")).where("comps > 1")
    blocks = split.select("k", F.col("main.comp").alias("main"), _blocks(F.col("main.n")).alias("mains"), _blocks(F.col("n") - F.col("main.n")).alias("others"))
    placed = tied.join(blocks, "k").withColumn("in_main", F.col("comp") == F.col("main"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    # the largest component's blocks are -1, -2, ...; they meet those of all others, never each other
    all_mains, all_others = F.sequence(-F.col("mains"), F.lit(-1)), F.sequence(F.lit(0), F.col("others") - 1)
    meets = F.when(F.col("in_main"), all_others).otherwise(F.concat(all_mains, all_others))
    dealt = placed.withColumn("block", F.when(F.col("in_main"), -1 - own).otherwise(own)).withColumn("with", F.explode(meets))
    dealt = dealt.select("k", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), "block", "id", "comp")
    more = verified(materialize(across_components(dealt.join(sketches, "id"), bits)), sets, percent)
    linked = found.select(F.col("id").alias("a"), F.col("root").alias("b")).union(more)
    final = components(linked)

    of_class = classes.select("set_hi", "set_lo", F.col("doc_id").alias("rep"))
    rooted = of_class.join(final, of_class["rep"] == final["id"], "left").select("set_hi", "set_lo", F.coalesce("root", "rep").alias("root"))
    known = rows.select("doc_id", "n_shingles", F.when(F.expr("n_shingles > 0 and doc_id is not null"), F.col("set_hi")).alias("set_hi"), "set_lo")
    out = known.join(rooted, ["set_hi", "set_lo"], "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))
