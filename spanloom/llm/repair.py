"""Token id files compressed by Re-Pair grammars.

A shard is a run of documents in ascending id order. Its ids become a grammar:
frequent neighbouring pairs are replaced by new symbols, again and again until
none is left, and what remains is a shorter sequence and the rules. A round
replaces all pairs that are frequent at its start (the rarer ones still as
often as they are left over), which makes few passes of array work out of
thousands of single steps. Pairs only grow rarer unless a new symbol is in
them, so after the first round only places next to new symbols, and those of
frequent pairs that were left over, are looked at again. Each symbol's expansion length is stored, so any range of ids is decoded by
finding the symbols that cover it and expanding only those.

A file is a Parquet table with a row per shard: Spark's committer writes it
and a lost executor's shards are written again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.frames import col_of, stored
from spanloom.llm.token_ids import encoder, groups

#: Ids a shard closes at; a longer document is a shard of its own.
SHARD_IDS = 500_000
#: A pair is worth a rule from this many replacements on.
LEAST_PAIRS = 12
#: Slots of the table that numbers pairs (a power of two), and how many pairs are sorted instead.
_BITS, _FEW = 18, 20_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

SHARD = "part int, shard int, symbols int, doc_ids binary, null_ids binary, sizes binary, left binary, right binary, spans binary, sequence binary"


def _slots(pairs: np.ndarray, way: int) -> np.ndarray:
    return ((pairs.view(np.uint64) * _MIX[way]) >> np.uint64(64 - _BITS)).view(np.int64)


def _numbered(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal pairs from 0 on, and the pair of each number.

    A slot numbers the pair that it holds; pairs that share it take part in the next of three ways, what is left is sorted.
    """
    if len(pairs) <= _FEW:
        held, number = np.unique(pairs, return_inverse=True)
        return number, held
    number, held, todo, rest, first = np.empty(len(pairs), np.int64), [], np.arange(len(pairs)), pairs, 0
    for way in range(len(_MIX)):
        slot, table, used = _slots(rest, way), np.zeros(1 << _BITS, np.int64), np.zeros(1 << _BITS, bool)
        table[slot] = rest
        own = table[slot] == rest
        used[slot[own]] = True
        number[todo[own]] = (np.cumsum(used) + (first - 1))[slot[own]]
        held.append(table[used])
        first += len(held[-1])
        todo = todo[~own]
        rest = pairs[todo]
    last, of = np.unique(rest, return_inverse=True)
    number[todo] = first + of
    return number, np.concatenate([*held, last])


def compress(ids: np.ndarray, symbols: int, least: int = LEAST_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, and left and right side of the rules; rule ``i`` is symbol ``symbols + i``. ``symbols`` is over every id.

    Goes on until no pair stands ``least`` times in places that do not overlap.
    """
    n, top, lefts, rights = len(ids), symbols, [], []
    # Places keep their numbers; a place that was joined to the one before it is skipped by its neighbours.
    seq, after, before, open_ = ids.astype(np.int64), np.arange(1, n + 1), np.arange(-1, n), np.ones(n, bool)
    touched = np.zeros(n + 1, bool)
    at = np.arange(max(n - 1, 0))
    while len(at):
        pairs = seq[at] << 32 | seq[after[at]]
        if len(at) > _FEW:
            slot = _slots(pairs, 0)
            maybe = (np.bincount(slot, minlength=1 << _BITS) >= least)[slot]
            at, pairs = at[maybe], pairs[maybe]
        number, held = _numbered(pairs)
        counts = np.bincount(number, minlength=len(held))
        often = (counts >= least)[number]
        at, number = at[often], number[often]
        if not len(at):
            break
        near = after[at[:-1]] == at[1:]
        take = _apart(near)
        got = np.bincount(number[take], minlength=len(held))
        if got.max() < least:
            # All are in each other's way: a pair gives way to a more frequent neighbour.
            rank = np.empty(len(held), np.int64)
            rank[np.argsort(-counts, kind="stable")] = np.arange(len(held))
            own = rank[number]
            free = np.ones(len(at), bool)
            free[1:] &= ~near | (own[1:] <= own[:-1])
            free[:-1] &= ~near | (own[:-1] <= own[1:])
            kept = np.flatnonzero(free)
            take = kept[_apart(after[at[kept[:-1]]] == at[kept[1:]])]
            got = np.bincount(number[take], minlength=len(held))
            if got.max() < least:
                # The most frequent pair overlaps itself too often, and is done.
                at = at[own != own.min()]
                continue
        good = got >= least
        take = take[good[number[take]]]
        rule = top + np.cumsum(good) - 1
        lefts.append(held[good] >> 32)
        rights.append(held[good] & 0xFFFFFFFF)
        top += int(good.sum())
        first, second = at[take], after[at[take]]
        third = after[second]
        touched[first] = touched[second] = True
        stay = at[~(touched[at] | touched[after[at]])]
        touched[first] = touched[second] = False
        seq[first], open_[second], after[first], before[third] = rule[number[take]], False, third, first
        at = np.concatenate((stay, first[third < n], before[first][before[first] >= 0]))
        at = np.unique(at) if len(at) <= _FEW else np.flatnonzero(np.bincount(at, minlength=n))
    empty = np.empty(0, np.int64)
    return seq[open_], np.concatenate(lefts or [empty]), np.concatenate(rights or [empty])


def _apart(near: np.ndarray) -> np.ndarray:
    """Every other place of each run of neighbours; ``near`` says of each place but the first whether it is next to the one before."""
    alone = np.append(True, ~near)
    starts = np.flatnonzero(alone)
    since = np.arange(len(alone)) - np.repeat(starts, np.diff(np.append(starts, len(alone))))
    return np.flatnonzero(since % 2 == 0)


def spans_of(left: np.ndarray, right: np.ndarray, symbols: int) -> np.ndarray:
    """How many ids every rule stands for. Rules only use symbols of earlier rounds."""
    size = np.ones(symbols + len(left), np.int64)
    done = 0
    while done < len(left):
        # All following rules whose sides are known by now.
        fits = np.maximum(left[done:], right[done:]) < symbols + done
        n = len(fits) if fits.all() else int(np.argmin(fits))
        size[symbols + done:symbols + done + n] = size[left[done:done + n]] + size[right[done:done + n]]
        done += n
    return size[symbols:]


def expand(seq: np.ndarray, left: np.ndarray, right: np.ndarray, symbols: int) -> np.ndarray:
    """The ids that a sequence of symbols stands for."""
    while len(big := np.flatnonzero(seq >= symbols)):
        width = np.ones(len(seq), np.int64)
        width[big] = 2
        start = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.int64)
        out[start] = seq
        out[start[big]], out[start[big] + 1] = left[seq[big] - symbols], right[seq[big] - symbols]
        seq = out
    return seq


def expand_all(seq: np.ndarray, left: np.ndarray, right: np.ndarray, spans: np.ndarray, symbols: int) -> np.ndarray:
    """As ``expand``, by expanding every rule once: what the rules stand for is far shorter than a whole shard."""
    known = np.concatenate((np.arange(symbols), expand(symbols + np.arange(len(left)), left, right, symbols)))
    size = np.concatenate((np.ones(symbols, np.int64), spans))
    begin = np.cumsum(size) - size
    own = size[seq]
    ends = np.cumsum(own)
    return known[np.repeat(begin[seq] - ends + own, own) + np.arange(ends[-1] if len(ends) else 0)]


def slice_ids(shard: dict, start: int, stop: int) -> np.ndarray:
    """Ids from ``start`` to ``stop`` of a shard row, expanding only what covers them."""
    seq, left, right, spans = (np.frombuffer(shard[k], "<u4").astype(np.int64) for k in ("sequence", "left", "right", "spans"))
    symbols = shard["symbols"]
    size = np.where(seq < symbols, 1, spans[np.maximum(seq - symbols, 0)] if len(spans) else 1)
    ends = np.cumsum(size)
    first, last = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left"))
    before = int(ends[first - 1]) if first else 0
    return expand(seq[first:last + 1], left, right, symbols)[start - before:stop - before].astype(np.uint32)


def encode_shards(df: DataFrame, tokenizer: str, end_id: int, id: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Shard rows of all documents in ascending id order; null ids come first, equal ids in the order of their texts' hashes."""
    own = df.select(col_of(df, id).cast("long").alias("doc_id"), F.coalesce(col_of(df, text), F.lit("")).alias("text"))
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = own.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text")).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, held, total, number, part = encoder(tokenizer), [], 0, 0, 0
        for batch in batches:
            ids, texts, parts = (batch.column(i).to_pylist() for i in range(3))
            for own in groups(texts):
                flat, sizes = enc.encode_all(texts[own])
                for doc_id, one in zip(ids[own], np.split(flat, np.cumsum(sizes)[:-1])):
                    held.append((doc_id, np.append(one, np.uint32(end_id))))
                    total += len(held[-1][1])
                    if total >= shard_ids:
                        yield _shard(held, parts[0], number)
                        held, total, number = [], 0, number + 1
            part = parts[0] if parts else part
        if held:
            yield _shard(held, part, number)

    return ordered.mapInArrow(run, SHARD)


def _shard(docs: list[tuple[int | None, np.ndarray]], part: int, number: int) -> pa.RecordBatch:
    ids = np.concatenate([x for _, x in docs])
    symbols = int(ids.max()) + 1
    seq, left, right = compress(ids, symbols)
    packed = lambda x, kind="<u4": [np.asarray(x).astype(kind).tobytes()]
    return pa.record_batch({
        "part": pa.array([part], pa.int32()), "shard": pa.array([number], pa.int32()), "symbols": pa.array([symbols], pa.int32()),
        "doc_ids": packed([0 if d is None else d for d, _ in docs], "<i8"), "null_ids": packed([d is None for d, _ in docs], "u1"), "sizes": packed([len(x) for _, x in docs]),
        "left": packed(left), "right": packed(right), "spans": packed(spans_of(left, right, symbols)), "sequence": packed(seq)})


def write(df: DataFrame, path: str, tokenizer: str, end_id: int = 1, **options) -> None:
    """Encode and write a table of shards."""
    encode_shards(df, tokenizer, end_id, **options).write.option("compression", "zstd").parquet(path)


def read(spark, path: str) -> DataFrame:
    """The shard rows of a written table."""
    return spark.read.schema(SHARD).parquet(path)


def documents(shards: DataFrame) -> DataFrame:
    """``part``, ``shard``, ``at`` (ids before it in its shard), ``doc_id`` and ``ids`` (little-endian unsigned 32-bit) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seq, left, right, spans = (np.frombuffer(row[k], "<u4").astype(np.int64) for k in ("sequence", "left", "right", "spans"))
                ids = expand_all(seq, left, right, spans, row["symbols"]).astype("<u4")
                sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
                ends = np.cumsum(sizes)
                nulls = np.frombuffer(row["null_ids"], "u1").astype(bool)
                n = len(sizes)
                yield pa.record_batch({
                    "part": pa.array([row["part"]] * n, pa.int32()), "shard": pa.array([row["shard"]] * n, pa.int32()), "at": ends - sizes,
                    "doc_id": pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=nulls), "ids": pa.array([ids[e - s:e].tobytes() for s, e in zip(sizes, ends)], pa.binary())})

    return shards.mapInArrow(run, "part int, shard int, at bigint, doc_id bigint, ids binary")


def starts(shards: DataFrame) -> DataFrame:
    """``part``, ``shard`` and ``before``, the ids of all earlier shards: sums over the shards of a part, on top of sums over parts."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [int(np.frombuffer(x, "<u4").astype(np.int64).sum()) for x in batch.column(2).to_pylist()]
            yield pa.record_batch({"part": batch.column(0), "shard": batch.column(1), "n": pa.array(n, pa.int64())})

    counted = stored(shards.select("part", "shard", "sizes").mapInArrow(sizes, "part int, shard int, n bigint"), "shard_sizes")
    parts = counted.groupBy("part").agg(F.sum("n").alias("n"))
    # As many rows as the range partitions of the writer.
    earlier = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.withColumn("own", own).join(earlier, "part").select("part", "shard", (F.col("own") + F.col("earlier")).alias("before"))


def digests(shards: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, decoded from the shards."""
    docs = documents(shards).select("part", "shard", "at", "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return docs.join(starts(shards), ["part", "shard"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
