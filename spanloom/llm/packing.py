"""Best-two-fit packing of token sequences.

A bin is filled greedily, the largest remaining piece that fits first. Then
its smallest piece is taken out again, and if two remaining pieces fill the
expanded gap better than it did, they take its place.

Only lengths matter for that, and a sequence length has few of them: the plan
is made from a histogram, in which equal bins are made as often as the counts
allow. Plans have at most a few thousand patterns whatever the corpus, and
are the same for any partitioning. Pieces then look up their place by length
and rank. A piece is ranked among those of its length while its task encodes
it, so what is summed afterwards are counts by task and length, and no piece
has to move to get its rank; a length that a third of all pieces share is
counted by all tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.frames import col_of, stored
from spanloom.llm.token_ids import encoder, groups

CAPACITY = 2048
#: Pieces and parts of pieces a worker keeps at most, about 120 MB: in the pipeline the workers share an executor with what earlier stages left.
KEPT_PIECES, KEPT_PARTS = 400_000, 200_000


@dataclass(frozen=True)
class Pattern:
    """``times`` bins that hold pieces of these lengths; the first has the number ``first``."""

    lengths: tuple[int, ...]
    times: int
    first: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Best-two-fit over a histogram of lengths from 1 to ``capacity``."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    patterns, number = [], 0
    while left.any():
        used = np.zeros(capacity + 1, np.int64)
        gap, chosen = capacity, []
        while gap:
            open_ = np.flatnonzero(left[: gap + 1] > used[: gap + 1])
            if not len(open_):
                break
            chosen.append(int(open_[-1]))
            used[open_[-1]] += 1
            gap -= chosen[-1]
        need = used.copy()
        if gap and len(chosen) > 1:
            smallest = chosen[-1]
            used[smallest] -= 1
            if pair := _best_pair(left - used, gap + smallest, smallest):
                chosen[-1:] = pair
                used[list(set(pair))] += [pair.count(x) for x in set(pair)]
                # What was weighed has to be there each time, also the piece that was put back.
                need = np.maximum(need, used)
            else:
                used[smallest] += 1
        of = np.flatnonzero(used)
        # Counts fall by what a bin uses; it can be made again while all that led to it is still there.
        times = max(1, min(int((left[x] - need[x]) // used[x]) + 1 for x in of))
        left -= times * used
        patterns.append(Pattern(tuple(chosen), times, number))
        number += times
    return patterns


def _best_pair(left: np.ndarray, room: int, over: int) -> list[int] | None:
    """Two remaining lengths with the largest sum up to ``room`` that is more than ``over``; of equal sums the one with the largest piece."""
    lengths = np.flatnonzero(left[: room + 1] > 0)
    best, pair, low = over, None, 0
    for high in lengths[::-1].tolist():
        fits = lengths[: np.searchsorted(lengths, min(high, room - high), side="right")]
        if len(fits) and fits[-1] == high and left[high] < 2:
            fits = fits[:-1]
        if len(fits) and high + fits[-1] > best:
            best, pair = high + int(fits[-1]), [high, int(fits[-1])]
        if best == room or 2 * high <= best:
            break
    return pair


def pieces(df: DataFrame, id: str, text: str, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids``, ``ids_crc32``, ``part`` and ``rank`` of every piece.

    A document is its ids and the end id. Only a longer one than the capacity
    is cut, into pieces of full length; its first piece takes the remainder.
    ``ids`` are unsigned and little-endian, of two bytes if every id of the
    tokenizer fits, else of four; ``ids_crc32`` is that of the four bytes.
    ``rank`` counts the pieces of the length in the task ``part``; store the rows before use.
    """
    kind = df.select(col_of(df, id)).schema[0].dataType.simpleString()
    own = df.select(col_of(df, id).alias("doc_id"), col_of(df, text).cast("string").alias("text"), F.spark_partition_id().alias("part"))
    small = _small(tokenizer, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(tokenizer, KEPT_PIECES, KEPT_PARTS), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for group in groups(texts):
                flat, sizes = enc.encode_all(texts[group])
                ends = np.cumsum(sizes)
                flat = np.insert(flat, ends, np.uint32(end_id)).astype("<u4")
                sizes = sizes + 1
                n = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                head = (sizes - 1) % capacity + 1
                length = np.where(piece == 0, head[doc], capacity)
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                stops = np.cumsum(length)
                # The rank of a piece: how many of its length came before it here.
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                first = np.searchsorted(ordered, ordered)
                rank = np.empty(len(length), np.int64)
                rank[order] = seen[ordered] + np.arange(len(length)) - first
                seen += np.bincount(length, minlength=capacity + 1)
                data = flat.astype("<u2") if small else flat
                offsets = np.concatenate(([0], stops * data.itemsize)).astype(np.int32)
                crc = np.array([zlib.crc32(flat[a:b]) for a, b in zip((stops - length).tolist(), stops.tolist())], np.int64)
                yield pa.record_batch({
                    "doc_id": batch.column(0).take(pa.array(doc + group.start)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length.astype(np.int32)),
                    "ids": pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())]), "ids_crc32": pa.array(crc),
                    "part": batch.column(2).take(pa.array(doc + group.start)), "rank": pa.array(rank)})

    return own.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length int, ids binary, ids_crc32 bigint, part int, rank bigint")


def _small(tokenizer: str, end_id: int) -> bool:
    return max(end_id, *encoder(tokenizer, KEPT_PIECES, KEPT_PARTS).tokenizer.get_vocab(with_added_tokens=True).values()) < 1 << 16


def place(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows with ``length``, ``part`` and ``rank`` get ``sequence_id`` and ``offset`` in place of the last two.

    Every other column stays as it is; ``table`` should be stored, as it is
    read twice. No rows give no rows.
    """
    others = [c for c in table.columns if c not in ("part", "rank")]
    # At most capacity lengths for every task that encoded.
    sizes = table.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = stored(sizes.withColumn("before", earlier), "length_ranks")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(plan(histogram, capacity), capacity)
    # Spark broadcasts the counts while they are small, and joins by task and length beyond that.
    ranked = table.join(sizes.select("part", "length", "before"), ["part", "length"]).withColumn("_rank", F.col("rank") + F.col("before"))

    def seek(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        ids, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        ls, rs = lengths.to_numpy(), ranks.to_numpy()
        for length in np.unique(ls):
            own = np.flatnonzero(ls == length)
            begins, firsts, places = slots[int(length)]
            at = np.searchsorted(begins, rs[own], side="right") - 1
            ids[own] = firsts[at] + rs[own] - begins[at]
            offsets[own] = places[at]
        return pd.DataFrame({"s": ids, "o": offsets})

    found = ranked.withColumn("_at", F.pandas_udf(seek, "s bigint, o bigint")("length", "_rank"))
    return found.select(*others, F.col("_at.s").alias("sequence_id"), F.col("_at.o").alias("offset"))


def _slots(patterns: list[Pattern], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For every length: first rank, first sequence and offset of each run of equal slots, by rank."""
    made: dict[int, list[tuple[int, int, int]]] = {}
    taken = np.zeros(capacity + 1, np.int64)
    for p in patterns:
        offset = 0
        for length in p.lengths:
            made.setdefault(length, []).append((int(taken[length]), p.first, offset))
            taken[length] += p.times
            offset += length
    return {length: tuple(np.array(x, np.int64) for x in zip(*runs)) for length, runs in made.items()}


def pack(df: DataFrame, tokenizer: str, end_id: int = 0, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with their ids (little-endian unsigned 32-bit) and their place.

    Null and empty texts are documents of the end id alone. Repeated rows and
    equal or null ids are documents of their own, told apart by their rows.
    Very long texts are encoded whole and cut. An empty table gives no pieces.
    Other columns are not read.
    """
    packed = place(stored(pieces(df, id, text, tokenizer, end_id, capacity), "pieces"), capacity)
    if not _small(tokenizer, end_id):
        return packed
    wide = F.pandas_udf(lambda ids: pd.Series([np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in ids], dtype=object), "binary")
    return packed.withColumn("ids", wide("ids"))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and ``ids`` of every packed sequence; a group is one sequence, at most its capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    joined = F.array_join(F.transform(parts, lambda p: p["ids"]), "")
    return packed.groupBy("sequence_id").agg(F.unhex(joined).alias("ids"))
