"""SimHash near-duplicates with pivot distance tables.

A text becomes a fingerprint: every bit is the majority of that bit over the
hashes of its word shingles. Two fingerprints link when few bits differ.

Which pairs are looked at: those that agree in a block key (exact blocks of
the fingerprint, or bands of minimal shingle hashes for wide radii). In a
block, a table of the Hamming distances to fixed reference fingerprints, the
pivots, is computed once per fingerprint. By the triangle inequality a pair
whose distances to some pivot differ by more than the radius cannot link; it
is discarded by this largest coordinate difference, and only the rest is
compared bit by bit.

Fingerprints are made distinct first, so exact copies cost one row. A block
with many fingerprints is cut into chunks by a hash, and every pair of chunks
is a cell of its own in some other task; cells return the edges of a spanning
forest, never all their pairs. Nothing is dropped: all chunk pairs are cells.

Searches by similarity (``one_of_each``) use the bits only to discard pairs
of a point and the smallest of its block; the shingle sets decide. Bands find
practically all pairs at little cost; those they miss are found by a prefix
filter over all sets, so the result is that of all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.components import components
from spanloom.llm.frames import col_of, stored

SEED = 42
#: Fingerprints of one block that meet in one cell, from each of its two chunks.
CHUNK = 512
PIVOTS = 12
#: Members of sets, 8 bytes each, that meet in one cell from each of its two chunks; a larger set is not cut.
CELL_MEMBERS = 1 << 20
#: Classes of shingle hashes whose texts are counted, and slices in which the counts are added up.
LOAD_BITS, LOAD_SLICES = 18, 16
#: Points that share one rare shingle and are paired at once; more meet in cells.
CROWD = 128
#: Texts a task remembers, so that copies are not taken apart again.
SEEN = 1_000_000


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, A-Z lower-cased; of all words when there are fewer; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[: len(words) - size])).tolist()
    return np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts, (ends[size - 1:] - 1).tolist())), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit number."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0]) if len(hashes) else 0


def fingerprints(shingle: int, words: int = 1, bands: int = 0, rows: int = 4) -> Column:
    """A pandas function from text to an array: ``words`` 64-bit parts of the fingerprint, then ``bands`` keys.

    Part 0 is the majority over the hashes themselves, later parts over
    multiplied hashes. A band key combines ``rows`` minimal values of
    multiplied hashes. With bands, a hash counts once in a text, and a hash
    of the set of hashes and its size come last.
    """
    signed = lambda data, seed: int(np.int64(np.uint64(xxhash.xxh64_intdigest(data, seed))))
    rng = np.random.default_rng(SEED)
    odd = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    part_factors, band_factors = odd(words), odd(bands * rows)

    def make(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            h = shingle_hashes(text, shingle)
            h = np.unique(h) if bands else h
            values = [majority(h)]
            for f in part_factors[1:]:
                m = h * f
                values.append(majority(m ^ (m >> np.uint64(29))))
            if bands:
                lows = np.array([(h * f).min() if len(h) else 0 for f in band_factors], np.uint64).reshape(bands, rows)
                values += [signed(low.tobytes(), i) for i, low in enumerate(lows)] + [signed(h.tobytes(), SEED), len(h)]
            out.append(values)
        return pd.Series(out)

    return F.pandas_udf(make, "array<bigint>")


def block_keys(fp: Column, radius: int, spare: int = 3) -> list[Column]:
    """Keys of which two fingerprints within the radius share at least one.

    The 64 bits are cut into ``radius + spare`` blocks; that many differing
    bits leave ``spare`` blocks equal, so every choice of ``spare`` blocks is
    a key. The number of the choice fills the other bits.
    """
    blocks = radius + spare
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for no, chosen in enumerate(combinations(range(blocks), spare)):
        mask = sum(((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(no), fp.bitwiseAND(F.lit(signed))))
    return keys


def links(points: DataFrame, keys: list[Column], parts: list[str], radius: int, chunk: int = CHUNK) -> DataFrame:
    """Edges ``a``, ``b`` of a spanning forest, per cell, of all points within the radius that share a key.

    ``points`` has ``node`` (long, distinct) and the fingerprint's ``parts``.
    """
    keyed = points.select("node", *parts, F.explode(F.array(*keys)).alias("key"))
    hot = stored(keyed.groupBy("key").count().filter(F.col("count") > chunk), "hot_blocks")
    pivots = _pivots(len(parts))

    def edges_of(rows: np.ndarray) -> pa.RecordBatch:
        a, b = near_pairs(rows[:, 0], rows[:, 2:].astype(np.uint64), pivots, radius)
        label = forest(len(rows), a, b)
        own = np.flatnonzero(label != np.arange(len(rows)))
        return pa.record_batch({"a": rows[own, 1], "b": rows[label[own], 1]})

    return _in_cells(keyed.join(hot, "key", "left"), ["node", *parts], chunk, edges_of)


def _pivots(parts: int) -> np.ndarray:
    return np.random.default_rng(SEED + 1).integers(0, 1 << 63, (PIVOTS, parts), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _in_cells(keyed: DataFrame, carried: list[str], chunk: int, edges_of: Callable[[np.ndarray], pa.RecordBatch]) -> DataFrame:
    """``edges_of`` rows (cell, ``carried``) of whole cells; ``keyed`` has ``key`` and the ``count`` of its block, null when small."""
    chunks = F.coalesce(F.ceil(F.col("count") / chunk).cast("int"), F.lit(1))
    dealt = keyed.withColumn("n", chunks).withColumn("c", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    cells = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")).alias("cell"), *carried)
    width = 1 + len(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, width), np.int64)
        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)])
            rows = np.concatenate((held, rows)) if len(held) else rows
            cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            held = rows[cut:]
            if cut:
                yield edges_of(rows[:cut])
        if len(held):
            yield edges_of(held)

    return cells.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(run, "a bigint, b bigint")


def near_pairs(cell: np.ndarray, prints: np.ndarray, pivots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of equal cell (sorted) at most ``radius`` bits apart."""
    n = len(cell)
    table = np.stack([np.bitwise_count(prints ^ p).sum(axis=1, dtype=np.int16) for p in pivots], axis=1)
    stop = np.searchsorted(cell, cell, side="right")
    left, right = [], []
    rows, gap = np.arange(n), 1
    while len(rows := rows[rows + gap < stop[rows]]):
        i, j = rows, rows + gap
        for p in range(len(pivots)):
            near = np.abs(table[i, p] - table[j, p]) <= radius
            i, j = i[near], j[near]
        near = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1) <= radius
        left.append(i[near])
        right.append(j[near])
        gap += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest reachable position of every position."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id``, ``fp`` (long) and ``component_id`` of every row.

    Rows link when their 64-bit fingerprints differ in at most ``radius``
    bits; ``component_id`` is the smallest id reachable. Null and empty texts
    have fingerprint 0 and link like any other. Repeated rows and ids each
    give a row; null ids are reached but never name a component, unless all
    its ids are null. An empty table gives an empty result.
    """
    make = fingerprints(shingle)
    prints = stored(df.select(col_of(df, id).alias("doc_id"), make(col_of(df, text))[0].alias("fp")), "fingerprints")
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    edges = links(points.select(F.col("fp").alias("node"), "fp"), block_keys(F.col("fp"), radius), ["fp"], radius)
    return prints.join(_named(points.select(F.col("fp").alias("node"), "first"), edges, "first").withColumnRenamed("node", "fp"), "fp", "left").select(
        "doc_id", "fp", F.col("first").alias("component_id"))


def _named(points: DataFrame, edges: DataFrame, first: str) -> DataFrame:
    """``node`` and the smallest ``first`` of its component."""
    return _named_by(points, components(edges), first)


def _named_by(points: DataFrame, roots: DataFrame, first: str) -> DataFrame:
    joined = points.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = joined.groupBy("root").agg(F.min(first).alias("_best"))
    return joined.join(best, "root").select("node", F.col("_best").alias(first))


#: For similarity searches: 256 bits, and 12 bands of 4 minimal hashes, so that a pair of similarity 0.8 shares a band in 99.8 of 100 cases.
PARTS, BANDS, BAND_ROWS = 4, 12, 4
#: Standard deviations by which the bits of a pair may exceed their mean. The bits only discard, so the bound is wide.
SPREAD = 6


def radius_of(similarity: float, bits: int = 64 * PARTS) -> int:
    """Bits in which shingle sets of this Jaccard similarity practically always differ at most."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(bits * share + SPREAD * np.sqrt(bits * share * (1 - share))))


def jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two sets, each given as its distinct 64-bit members; 1 for two empty ones."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / max(1, len(x) + len(y) - shared) if len(x) or len(y) else 1.0


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (``a``, ``b``) whose ``sets`` (``node``, ``members``) are similar."""
    alike = F.pandas_udf(lambda a, b: pd.Series([jaccard(x, y) >= similarity for x, y in zip(a, b)], dtype=bool), "boolean")
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("ma")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("members").alias("mb")), "b")
    return both.filter(alike("ma", "mb")).select("a", "b")


def _similar_edges(points: DataFrame, sets_of: Callable[[DataFrame], DataFrame], keys: list[Column], parts: list[str], similarity: float, chunk: int = CHUNK) -> DataFrame:
    """Edges ``a``, ``b`` that connect what all similar pairs of points that share a key connect.

    ``points`` has ``node``, ``size`` (members of its set) and ``parts``;
    ``sets_of`` gives the sets of a table of nodes. First every point is
    compared with the smallest of its block (bits and sizes discard, the sets
    decide), so that a large group of copies grows together by few
    comparisons. Blocks that still hold points that are apart are cut into
    cells, whose sets meet and return the edges of a forest, not their pairs.
    """
    radius = radius_of(similarity)
    point = F.struct("node", "size", *parts)
    keyed = points.select("node", "size", *parts, F.explode(F.array(*keys)).alias("key"))
    blocks = keyed.groupBy("key").agg(F.count("*").alias("count"), F.min(point).alias("least")).filter(F.col("count") > 1)
    blocks = stored(keyed.join(blocks, "key"), "shared_blocks")
    sets = stored(sets_of(blocks.select("node").distinct()), "shingle_sets")
    apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"least.{p}"))) for p in parts), F.lit(0))
    fit = F.least("size", "least.size") >= similarity * F.greatest("size", "least.size") - 1e-6
    stars = blocks.filter((F.col("node") != F.col("least.node")) & (apart <= radius) & fit).select(F.col("least.node").alias("a"), F.col("node").alias("b"))
    joined = stored(_similar(stored(stars.distinct(), "star_pairs"), sets, similarity), "star_edges")
    roots = components(joined)
    labelled = blocks.join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    still = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("count"), F.sum("size").alias("total"))
    n = F.ceil(F.greatest(F.col("count") / chunk, F.col("total") / CELL_MEMBERS)).cast("int")
    crowded = still.filter(F.col("low") != F.col("high")).select("key", F.greatest(n, F.lit(1)).alias("n"))
    rest = _in_set_cells(labelled.join(crowded, "key"), sets, similarity)
    return joined.union(stored(rest.distinct(), "cell_edges"))


def _in_set_cells(crowded: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges of the blocks ``key`` of ``crowded`` (``node``, ``root``), each cut into ``n`` chunks whose ``sets`` meet in pairs."""
    dealt = crowded.withColumn("c", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    cells = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")).alias("cell"), "node", "root").join(sets, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        of = None
        for batch in batches:
            for cell, *row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if cell != of and held:
                    yield _edges_of_sets(held, similarity)
                    held = []
                of = cell
                held.append(tuple(row))
        if held:
            yield _edges_of_sets(held, similarity)

    return cells.select("cell", "node", "root", "members").repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(run, "a bigint, b bigint")


def _edges_of_sets(rows: list[tuple[int, int, bytes]], similarity: float) -> pa.RecordBatch:
    """Edges of similar pairs of the rows (node, root, members) that join what has different roots.

    Two sets this similar share one of their rarest members, so many of them
    that the others are too few (prefix filter); only such pairs are compared.
    """
    sets = [np.frombuffer(x, np.uint64) for _, _, x in rows]
    a, b = _maybe_similar(sets, similarity)
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    left, right = [], []
    for i, j in zip(a.tolist(), b.tolist()):
        x, y = top(rows[i][1]), top(rows[j][1])
        if x != y and jaccard(rows[i][2], rows[j][2]) >= similarity:
            up[max(x, y)] = min(x, y)
            left.append(min(rows[i][0], rows[j][0]))
            right.append(max(rows[i][0], rows[j][0]))
    return pa.record_batch({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def _maybe_similar(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of sets that can have this Jaccard similarity, by sizes and rarest members."""
    m = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    _, member, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), size)
    order = np.lexsort((member, uses[member], owner))
    # As many of the rarest that the others are fewer than a similar set has to share.
    first = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
    place = np.arange(len(member)) - np.repeat(np.cumsum(size) - size, size)
    rare = order[place < np.repeat(first, size)]
    rare = rare[uses[member[rare]] > 1]
    rare = rare[np.lexsort((owner[rare], member[rare]))]
    of, who = member[rare], owner[rare]
    met = np.zeros((m, m), bool)
    at, gap = np.arange(len(of)), 1
    while len(at := at[at + gap < len(of)]) and len(at := at[of[at] == of[at + gap]]):
        met[who[at], who[at + gap]] = True
        gap += 1
    a, b = np.nonzero(met)
    fit = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-6
    return a[fit], b[fit]


def _kept_of(size: Column, similarity: float) -> Column:
    """Members that a similar set has to share at least."""
    return F.ceil(size * similarity - 1e-9)


def _loads(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many texts hold a shingle of each class of hashes: 2^LOAD_BITS numbers, whatever the table."""
    width = (1 << LOAD_BITS) // LOAD_SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = np.zeros(1 << LOAD_BITS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(load, _class(np.unique(shingle_hashes(text, shingle))), 1)
        if load.any():
            yield pa.record_batch({"slice": np.arange(LOAD_SLICES, dtype=np.int32), "load": pa.array([load[i * width:(i + 1) * width].tobytes() for i in range(LOAD_SLICES)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for no, load in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[no] = held.get(no, 0) + np.frombuffer(load, np.int64)
        if held:
            yield pa.record_batch({"slice": pa.array(list(held), pa.int32()), "load": pa.array([x.tobytes() for x in held.values()], pa.binary())})

    schema = "slice int, load binary"
    out = np.zeros((LOAD_SLICES, width), np.int64)
    for row in texts.mapInArrow(count, schema).repartition(LOAD_SLICES, "slice").mapInArrow(add, schema).collect():
        out[row["slice"]] += np.frombuffer(row["load"], np.int64)
    return out.reshape(-1)


def _class(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - LOAD_BITS)).astype(np.int64)


def first_members(hashes: np.ndarray, load: np.ndarray, similarity: float) -> np.ndarray:
    """So many of the distinct members, those of the rarest classes first, that the others are fewer than a similar set has to share.

    All sets take them in one order, so two similar ones have at least one in common (prefix filter).
    """
    if not len(hashes):
        return hashes
    count = len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1
    return hashes[np.lexsort((hashes, load[_class(hashes)]))[:count]]


def _missed_edges(members: DataFrame, points: DataFrame, sets_of: Callable[[DataFrame], DataFrame], roots: DataFrame, similarity: float, crowd: int = CROWD, chunk: int = CHUNK) -> DataFrame:
    """Edges ``a``, ``b`` that connect what all similar pairs of different ``roots`` connect.

    ``members`` has ``node`` and a ``key`` for each of its first members,
    ``points`` ``node`` and ``size``. Keys that only copies of one root share
    go; the points of the others make pairs. A similar pair has so many keys
    in common that few others remain to be compared. Keys of more than
    ``crowd`` points are cut into cells, whose sets meet, instead.
    """
    own = Window.partitionBy("key")
    shared = members.withColumn("low", F.min("node").over(own)).withColumn("high", F.max("node").over(own)).filter("low <> high").select("key", "node")
    shared = stored(shared.distinct(), "shared_members")
    labelled = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    still = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("count")).filter("low <> high")
    still = labelled.join(still.select("key", "count"), "key").join(points.select("node", "size"), "node")
    still = stored(still.select("key", "count", "node", "root", "size"), "open_members")
    few = still.filter(F.col("count") <= crowd).select("key", "node", "root", "size")
    left, right = (few.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "root", "size")]) for side in "ab")
    fit = F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-6
    met = left.join(right, "key").filter((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & fit).groupBy("node_a", "node_b").agg(
        F.count("*").alias("common"), F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"))
    # What is not among the first members of the set that ends first in the order can be common, too.
    rest = F.greatest(_kept_of(F.col("size_a"), similarity), _kept_of(F.col("size_b"), similarity)) - 1
    enough = F.col("common") + rest >= (F.col("size_a") + F.col("size_b")) * (similarity / (1 + similarity)) - 1e-6
    pairs = stored(met.filter(enough).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), "near_pairs")
    crowded = still.filter(F.col("count") > crowd)
    total = crowded.groupBy("key").agg(F.greatest(F.ceil(F.greatest(F.max("count") / chunk, F.sum("size") / CELL_MEMBERS)).cast("int"), F.lit(1)).alias("n"))
    met_nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(crowded.select("node")).distinct()
    sets = stored(sets_of(met_nodes), "near_sets")
    return stored(_similar(pairs, sets, similarity).union(_in_set_cells(crowded.join(total, "key"), sets, similarity)).distinct(), "missed_edges")


def one_of_each(df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``df`` without near copies: of every group linked by similar texts, the row of smallest id.

    Texts link when their sets of ``shingle``-word shingles have at least
    this Jaccard similarity. Bands of minimal shingle hashes propose pairs,
    256-bit fingerprints discard those that are far apart, and the sets
    decide; then texts that are still apart but share one of their rarest
    shingles are compared, so that no similar pair is left out. All texts without words are one group. Null ids come last; of
    equal ids (repeated rows) one row stays.
    """
    names = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    make = fingerprints(shingle, PARTS, BANDS, BAND_ROWS)
    parts = [f"_f{i}" for i in range(PARTS)]
    renamed = df.select(*[col_of(df, c).alias(n) for c, n in names.items()])
    table = stored(renamed.withColumn("_p", make(F.col(names[text]))).withColumn("_row", F.monotonically_increasing_id()), "signed_documents")
    node, size = F.get("_p", F.lit(PARTS + BANDS)), F.get("_p", F.lit(PARTS + BANDS + 1))
    rank = F.struct(F.col(names[id]).isNull().alias("none"), F.col(names[id]).alias("id"), F.col("_row").alias("row"))
    signed = table.select(node.alias("node"), "_p", rank.alias("rank"))
    points = stored(signed.groupBy("node").agg(F.min("rank").alias("rank"), F.first("_p").alias("_p")), "distinct_texts")
    shown = points.select("node", size.alias("size"), "_p", *[F.get("_p", F.lit(i)).alias(f) for i, f in enumerate(parts)])
    keys = [F.get("_p", F.lit(PARTS + i)) for i in range(BANDS)]
    members = F.pandas_udf(lambda texts: pd.Series([np.unique(shingle_hashes(t, shingle)).tobytes() for t in texts]), "binary")

    def sets_of(nodes: DataFrame) -> DataFrame:
        rows = points.join(nodes, "node", "left_semi").select("node", F.col("rank.row").alias("_row"))
        return table.select("_row", F.col(names[text]).alias("_t")).join(rows, "_row").select("node", members("_t").alias("members"))

    edges = _similar_edges(shown, sets_of, keys, parts, similarity)
    roots = components(edges)
    load = df.sparkSession.sparkContext.broadcast(_loads(table.select(names[text]), shingle))

    @F.pandas_udf("array<bigint>")
    def firsts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        seen: set[int] = set()
        for nodes, texts in batches:
            out = []
            for n, t in zip(nodes, texts):
                # Copies have the same members.
                out.append(np.empty(0, np.int64) if n in seen else first_members(np.unique(shingle_hashes(t, shingle)), load.value, similarity).view(np.int64))
                seen.add(n)
            if len(seen) > SEEN:
                seen.clear()
            yield pd.Series(out)

    members_first = table.select(node.alias("node"), F.explode(firsts(node, F.col(names[text]))).alias("key"))
    missed = _missed_edges(members_first, points.select("node", size.alias("size")), sets_of, roots, similarity)
    if not missed.isEmpty():
        roots = components(edges.union(missed))
    best = _named_by(points.select("node", "rank"), roots, "rank").select(F.col("rank.row").alias("_row")).distinct()
    return table.join(best.hint("merge"), "_row", "left_semi").select(*[F.col(n).alias(c) for c, n in names.items()])
