"""Line dedup by pairwise alignment.

Documents overlap when they share a rare line hash: here the hash of a run of
lines, the shortest from its first line on that has ``min_words`` words. One
long line is such a run; short lines that stand everywhere are rare only
together with their neighbours. Every common block of ``min_words`` words
starts with a shared run, so no such overlap is missed.

Each document is paired with the earliest document of each of its shared runs,
never with all that share them, so pairs grow with the occurrences of runs. A
pair is aligned by patience diff: runs that are unique on both sides, in their
longest ascending order, are anchors and grow while lines are equal. Aligned
blocks are deleted from the later document. What was moved or repeated within
the later document is aligned in further passes over its remaining lines.

A line is deleted only if an earlier document holds it, so its first copy
stays. Alignment works on arrays of line hashes; texts move once, at the end.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.frames import col_of, stored

MIN_WORDS = 50
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def line_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of words of every line; space around a line doesn't count."""
    lines = [line.strip() for line in text.encode("utf-8", "surrogatepass").split(b"\n")]
    return np.array([xxhash.xxh64_intdigest(x) for x in lines], np.uint64), np.array([len(x.split()) for x in lines], np.int64)


def runs(h: np.ndarray, w: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and end of the shortest run of ``min_words`` words from every line on; end 0 where no run is long enough or the line is blank."""
    n = len(h)
    total = np.concatenate(([0], np.cumsum(w)))
    ends = np.searchsorted(total, total[:n] + min_words)
    fits = (ends <= n) & (w > 0)
    ends = np.where(fits, ends, 0)
    with np.errstate(over="ignore"):
        one = np.ones(1, np.uint64)
        power = np.cumprod(np.concatenate((one, np.full(n, _FACTOR, np.uint64))), dtype=np.uint64)
        back = np.cumprod(np.concatenate((one, np.full(n, _INVERSE, np.uint64))), dtype=np.uint64)
        summed = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[:n], dtype=np.uint64)))
        value = (summed[ends] - summed[:n]) * back[:n] + (ends - np.arange(n)).astype(np.uint64)
        value ^= value >> np.uint64(31)
    return np.where(fits, value, 0).astype(np.uint64), ends


def aligned(dh: np.ndarray, dw: np.ndarray, kh: np.ndarray, kw: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Line ranges of the later document that align with the keeper."""
    d_runs, d_ends = runs(dh, dw, min_words)
    k_runs, k_ends = runs(kh, kw, min_words)
    places: dict[int, list[int]] = {}
    for at in np.flatnonzero(k_ends).tolist():
        places.setdefault(int(k_runs[at]), []).append(at)
    open_ = np.ones(len(dh), bool)
    shared = [i for i in np.flatnonzero(d_ends).tolist() if int(d_runs[i]) in places]
    ranges: list[tuple[int, int]] = []
    while shared:
        times = Counter(int(d_runs[i]) for i in shared)
        anchors = [(i, places[int(d_runs[i])][0]) for i in shared if times[int(d_runs[i])] == 1 and len(places[int(d_runs[i])]) == 1]
        for i, k in _ascending(anchors) or [(shared[0], places[int(d_runs[shared[0]])][0])]:
            if not open_[i]:
                continue
            stop, k_stop, start, k_start = i, k, i, k
            while stop < len(dh) and k_stop < len(kh) and open_[stop] and dh[stop] == kh[k_stop]:
                stop, k_stop = stop + 1, k_stop + 1
            while start > 0 and k_start > 0 and open_[start - 1] and dh[start - 1] == kh[k_start - 1]:
                start, k_start = start - 1, k_start - 1
            if stop > start:
                open_[start:stop] = False
                ranges.append((start, stop))
        taken = np.concatenate(([0], np.cumsum(~open_)))
        left = [i for i in shared if taken[d_ends[i]] == taken[i]]
        if len(left) == len(shared):
            break
        shared = left
    return sorted(ranges)


def _ascending(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of anchors whose second parts ascend (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(anchors)
    for n, (_, k) in enumerate(anchors):
        pile = bisect_left(tops, k)
        back[n] = at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(k)
            at.append(n)
        else:
            tops[pile], at[pile] = k, n
    chain, n = [], at[-1] if at else -1
    while n >= 0:
        chain.append(anchors[n])
        n = back[n]
    return chain[::-1]


def deletions(df: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``key`` (of ``document_key``) and ``ranges``, the line ranges (start, end) to delete, for documents that lose lines."""

    def make(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            h, w = line_hashes(t)
            out.append((h.view(np.int64), w.astype(np.int32), runs(h, w, min_words)[0].view(np.int64)))
        return pd.DataFrame(out, columns=["h", "w", "run"])

    described = F.pandas_udf(make, "h array<bigint>, w array<int>, run array<bigint>")
    own = df.select(col_of(df, id).alias("id"), F.coalesce(col_of(df, text), F.lit("")).alias("text")).select("id", "text", document_key(F.col("id"), F.col("text")).alias("key"))
    docs = stored(own.select("id", "key", described("text").alias("d")).select("id", "key", "d.*"), "line_hashes")
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("key").alias("key"))
    starts = docs.select(place.alias("place"), F.explode(F.array_distinct("run")).alias("run")).filter(F.col("run") != 0)
    first = starts.groupBy("run").agg(F.min("place").alias("keeper"), F.max("place").alias("last")).filter(F.col("keeper") != F.col("last")).select("run", "keeper")
    pairs = starts.join(first, "run").filter(F.col("place") != F.col("keeper")).select(F.col("place.key").alias("key"), F.col("keeper.key").alias("keeper")).distinct()
    side = docs.select("key", "h", "w").dropDuplicates(["key"])
    both = pairs.join(side, "key").join(side.select(F.col("key").alias("keeper"), F.col("h").alias("kh"), F.col("w").alias("kw")), "keeper").select("key", "h", "w", "kh", "kw")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts, ends = [], [], []
            for key, *arrays in zip(batch.column(0).to_pylist(), *[batch.column(i) for i in range(1, 5)]):
                dh, dw, kh, kw = (x.values.to_numpy(zero_copy_only=False) for x in arrays)
                for start, end in aligned(dh.view(np.uint64), dw, kh.view(np.uint64), kw, min_words):
                    keys.append(key)
                    starts.append(start)
                    ends.append(end)
            yield pa.record_batch({"key": pa.array(keys, pa.int64()), "start": pa.array(starts, pa.int32()), "end": pa.array(ends, pa.int32())})

    ranges = both.mapInArrow(align, "key bigint, start int, end int")
    return ranges.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("ranges"))


def document_key(id: Column, text: Column) -> Column:
    """Rows of equal id and text are one document."""
    return F.xxhash64(id, F.lit("|"), text)


def dedup_lines(df: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, counts: bool = True, length: str | None = None) -> DataFrame:
    """``df`` with shortened texts and, with ``counts``, the columns ``lines`` (before) and ``removed_lines``.

    Documents are in the order of their ids, null last, equal ids in the
    order of a hash. Rows of equal id and text are one document and stay
    alike. A null text stays null with 0 lines; an empty text is one empty
    line. A document all of whose lines are aligned keeps an empty text.
    The counts replace columns of their names. ``length`` names a column with
    the length of the text, set anew where the text was shortened. An empty
    table gives an empty result.
    """
    names = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    renamed = df.select(*[col_of(df, c).alias(n) for c, n in names.items()])
    gone = stored(deletions(renamed, names[id], names[text], min_words), "line_ranges")
    t = F.coalesce(F.col(names[text]), F.lit(""))
    joined = renamed.withColumn("_key", document_key(F.col(names[id]), t)).join(gone.withColumnRenamed("key", "_key").hint("merge"), "_key", "left")
    kept = F.filter(F.split(t, "\n", -1), lambda x, i: ~F.exists("ranges", lambda r: (i >= r["start"]) & (i < r["end"])))
    removed = F.when(F.col("ranges").isNull(), 0).otherwise(F.size(F.split(t, "\n", -1)) - F.size(kept))
    short = F.when(F.col("ranges").isNull(), F.col(names[text])).otherwise(F.array_join(kept, "\n"))
    lines = F.when(F.col(names[text]).isNull(), 0).otherwise(F.size(F.split(t, "\n", -1)))
    joined = joined.withColumn("_short", short)
    renewed = {text: F.col("_short")}
    if length is not None:
        renewed[length] = F.when(F.col("ranges").isNull(), F.col(names[length])).otherwise(F.length("_short").cast(df.schema[length].dataType))
    added = [lines.cast("long").alias("lines"), removed.cast("long").alias("removed_lines")] if counts else []
    return joined.select(*[renewed.get(c, F.col(n)).alias(c) for c, n in names.items() if not counts or c.lower() not in ("removed_lines", "lines")], *added)
