"""Language model scoring with a probabilistic suffix tree over bytes.

A text is the bytes of its words in lower case, a space after each word and
an end symbol. The tree's states are contexts, the last few bytes, of any
length up to ``DEPTH``. A context is kept when it came ``LEAST_COUNT`` times and
when what follows it differs from what follows its suffix: the divergence of the
two distributions, over all its occurrences, has to reach ``GAIN`` nats.
Suffixes of kept contexts are kept. A symbol's probability comes from the
longest kept suffix of what precedes it; distributions are smoothed with that
of the next shorter suffix, the more the more different symbols follow.

Counting: tasks add up (context, symbol) counts of the longest contexts and
word counts, Spark sums them, and shorter contexts are sums of longer ones.
Both bars are absolute, so the tree grows with the corpus. It is broadcast in
pieces of about ``PIECE`` (context, symbol) counts, cut by the two bytes before a
symbol; texts are scored once a piece, each symbol in the piece of its context,
and the sums added up. Words are not bounded either: common words (a share of
all tokens bounds their number) are looked up in the task, all others are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.frames import col_of, stored

DEPTH = 5
LEAST_COUNT, GAIN = 4, 6.0
#: (context, symbol) counts of one piece of the tree, and pairs of bytes before a symbol.
PIECE, PAIRS = 1 << 21, 1 << 16
#: Share of all tokens from which a word is common.
COMMON_SHARE = 1e-6
SPACE, END = 0x20, 0xFF
#: Bytes that are counted and that are scored at once (some 80 bytes of arrays each); words and codes a task holds before it passes them on; slots of the score memory.
CHUNK, SCORED, HELD_WORDS, HELD_CODES, MEMORY = 1 << 20, 1 << 18, 300_000, 2_000_000, 1 << 21


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def codes(parts: list[bytes]) -> np.ndarray:
    """For every byte of the texts (each ending in ``END``): the byte and the ``DEPTH`` before it, nearest first, as one number.

    Before a text lie end symbols, so neighbouring texts don't see each other.
    """
    flat = np.frombuffer(b"".join(parts), np.uint8)
    # Bytes since the last end symbol.
    ends = np.flatnonzero(flat == END)
    sizes = np.diff(np.append(-1, ends))
    place = np.arange(len(flat)) - np.repeat(np.append(0, ends[:-1] + 1), sizes)
    value = flat.astype(np.uint64) << np.uint64(8 * DEPTH)
    for back in range(1, DEPTH + 1):
        before = np.full(len(flat), END, np.uint64)
        before[back:] = flat[:-back]
        before[place < back] = END
        value |= before << np.uint64(8 * (DEPTH - back))
    return value


def spelled(words: list[bytes]) -> bytes:
    return b"".join((b" ".join(words), b" " if words else b"", bytes([END])))


def is_held_out(id: Column) -> Column:
    return F.crc32(F.coalesce(id.cast("string"), F.lit(""))) % 7 == 2


def counts(docs: DataFrame) -> DataFrame:
    """``word``, ``code``, ``n``: counts of words (code null) and of longest contexts with their symbol (word null) over ``text``.

    The end of a text is counted with the symbols, not as a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            keys = list(words)
            result = pa.record_batch({"word": pa.array(keys, pa.binary()).cast(pa.string()), "code": pa.nulls(len(keys), pa.int64()), "n": pa.array([words[k] for k in keys], pa.int64())})
            words.clear()
            return result

        def summed(value: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch({"word": pa.nulls(len(value), pa.string()), "code": value.astype(np.int64), "n": n})

        held, times, parts, size = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                own = words_of(text)
                words.update(own)
                parts.append(spelled(own))
                size += len(parts[-1])
                if size >= 2 * CHUNK:
                    held, times = _merged(held, times, parts)
                    parts, size = [], 0
                if len(held) >= HELD_CODES:
                    yield summed(held, times)
                    held, times = held[:0], times[:0]
                if len(words) >= HELD_WORDS:
                    yield out()
        if parts:
            held, times = _merged(held, times, parts)
        if len(held):
            yield summed(held, times)
        if words:
            yield out()

    return docs.select("text").mapInArrow(run, "word string, code bigint, n bigint").groupBy("word", "code").agg(F.sum("n").alias("n"))


def _merged(held: np.ndarray, times: np.ndarray, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and their counts, with those of further texts added."""
    value, n = np.unique(codes(parts), return_counts=True)
    both = np.concatenate((held, value))
    order = np.argsort(both, kind="stable")
    both = both[order]
    first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
    return both[first], np.add.reduceat(np.concatenate((times, n))[order], first)


@dataclass(frozen=True)
class Tree:
    """Kept states by length: contexts with totals and numbers of following symbols, and (context, symbol) counts; all sorted."""

    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    kinds: list[np.ndarray]
    pairs: list[np.ndarray]
    pair_counts: list[np.ndarray]

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of the symbols of ``codes``, from the empty context to the longest kept one."""
        p = np.full(len(code), 1 / 256)
        symbol = code >> np.uint64(8 * DEPTH)
        before = code & np.uint64((1 << 8 * DEPTH) - 1)
        for k in range(len(self.contexts)):
            context = before >> np.uint64(8 * (DEPTH - k))
            at = _find(self.contexts[k], context)
            has = at >= 0
            if not has.any():
                break
            pair = _find(self.pairs[k], (context << np.uint64(8)) | symbol)
            n = np.where(pair >= 0, self.pair_counts[k][np.maximum(pair, 0)], 0)
            total, kinds = self.totals[k][np.maximum(at, 0)], self.kinds[k][np.maximum(at, 0)]
            p = np.where(has, (n + kinds * p) / np.maximum(total + kinds, 1), p)
        return np.log10(p)


def _find(table: np.ndarray, value: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.full(len(value), -1)
    at = np.searchsorted(table, value)
    at[at == len(table)] = 0
    return np.where(table[at] == value, at, -1)


def states(deepest: DataFrame, least: int = LEAST_COUNT, gain: float = GAIN) -> DataFrame:
    """The tree as a table, ``k`` (length), ``context``, ``symbol`` and ``n`` of all kept contexts, from ``code`` and ``n`` of the longest contexts."""
    low = F.col("code").bitwiseAND(F.lit((1 << 8 * DEPTH) - 1))
    pairs = {}
    for k in range(DEPTH, -1, -1):
        source = deepest.select(F.shiftright(low, 0).alias("context"), F.shiftright("code", 8 * DEPTH).alias("symbol"), "n") if k == DEPTH else pairs[k + 1]
        context = F.col("context") if k == DEPTH else F.shiftright("context", 8)
        level = source.select(context.alias("context"), "symbol", "n").groupBy("context", "symbol").agg(F.sum("n").alias("n"))
        pairs[k] = stored(level, f"contexts_{k}") if k < DEPTH else level
    kept, below = {}, None
    for k in range(DEPTH, 0, -1):
        own = pairs[k].groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).filter(F.col("total") >= least)
        shorter = pairs[k - 1].groupBy("context").agg(F.sum("n").alias("of"))
        here = pairs[k].join(own, "context").withColumn("parent", F.shiftright("context", 8))
        there = pairs[k - 1].select(F.col("context").alias("parent"), "symbol", F.col("n").alias("m")).join(shorter.withColumnRenamed("context", "parent"), "parent")
        ratio = F.log(F.col("n") / F.col("total") * F.col("of") / F.col("m"))
        told = here.join(there, ["parent", "symbol"]).groupBy("context").agg(F.sum(F.col("n") * ratio).alias("gain")).filter(F.col("gain") >= gain).select("context")
        names = told if below is None else told.union(below.select(F.shiftright("context", 8).alias("context"))).distinct()
        kept[k] = below = stored(names, f"states_{k}")
    levels = [(pairs[k] if k == 0 else pairs[k].join(kept[k], "context", "left_semi")).select(F.lit(k).alias("k"), "context", "symbol", "n") for k in range(DEPTH + 1)]
    return stored(reduce(DataFrame.union, levels), "tree")


def _nearest() -> Column:
    """The two bytes before a symbol as a number; null for contexts of less than two bytes, of which there are few."""
    return F.when(F.col("k") >= 2, F.expr("shiftright(context, 8 * (k - 2))"))


def pieces(tree: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of the two bytes before a symbol that hold about ``most`` counts each, or what a single pair of bytes has."""
    found, low, held = [], 0, 0
    for row in tree.groupBy(_nearest().alias("at")).count().filter("at is not null").orderBy("at").collect():
        if held and held + row["count"] > most:
            found.append((low, row["at"]))
            low, held = row["at"], 0
        held += row["count"]
    return [*found, (low, PAIRS)]


def piece(tree: DataFrame, low: int, high: int) -> Tree:
    """The contexts of a range of ``pieces``, and those of less than two bytes."""
    at = _nearest()
    rows = tree.filter(at.isNull() | (at >= low) & (at < high)).toPandas().sort_values(["k", "context", "symbol"])
    contexts, totals, kinds, keys, numbers = [], [], [], [], []
    for k in range(DEPTH + 1):
        level = rows[rows["k"] == k]
        context, n = level["context"].to_numpy(np.uint64), level["n"].to_numpy(float)
        own, first = np.unique(context, return_index=True)
        contexts.append(own)
        totals.append(np.add.reduceat(n, first) if len(first) else n)
        kinds.append(np.diff(np.append(first, len(n))).astype(float))
        keys.append((context << np.uint64(8)) | level["symbol"].to_numpy(np.uint64))
        numbers.append(n)
    return Tree(contexts, totals, kinds, keys, numbers)


def grow(deepest: DataFrame, least: int = LEAST_COUNT, gain: float = GAIN) -> Tree:
    """The whole tree. No rows give a tree whose symbols are all equally likely."""
    return piece(states(deepest, least, gain), 0, PAIRS)


class _Scorer:
    """Scores positions whose two bytes before lie in the range, keeping the values of codes seen before in a table of one slot per hash."""

    def __init__(self, tree: Tree, low: int = 0, high: int = PAIRS):
        self.tree, self.low, self.high = tree, low, high
        self.key = np.full(MEMORY, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.value = np.zeros(MEMORY, np.float64)

    def sums(self, parts: list[bytes]) -> np.ndarray:
        """One sum of log10 probabilities per text."""
        code = codes(parts)
        slot = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MEMORY.bit_length() + 1)).astype(np.int64)
        value = self.value[slot]
        missed = self.key[slot] != code
        if self.low > 0 or self.high < PAIRS:
            at = (code >> np.uint64(8 * (DEPTH - 2))) & np.uint64(PAIRS - 1)
            own = (at >= self.low) & (at < self.high)
            missed &= own
        missed = np.flatnonzero(missed)
        if len(missed):
            new, back = np.unique(code[missed], return_inverse=True)
            found = self.tree.log10(new)
            value[missed] = found[back]
            at = ((new * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MEMORY.bit_length() + 1)).astype(np.int64)
            self.key[at], self.value[at] = new, found
        if self.low > 0 or self.high < PAIRS:
            value[~own] = 0.0
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.add.reduceat(value, np.cumsum(sizes) - sizes)


def _scored_by(texts: DataFrame, tree: DataFrame, low: int, high: int) -> DataFrame:
    """``row`` and the ``score`` of the symbols whose context lies in one piece of the tree, written."""
    shared = texts.sparkSession.sparkContext.broadcast(piece(tree, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value, low, high)
        for batch in batches:
            scores, parts, size = [], [], 0
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                parts.append(spelled(words_of(text)))
                size += len(parts[-1])
                if size >= SCORED:
                    scores.append(scorer.sums(parts))
                    parts, size = [], 0
            if parts:
                scores.append(scorer.sums(parts))
            yield pa.record_batch({"row": batch.column("row"), "score": np.concatenate(scores) if scores else np.empty(0)})

    found = stored(texts.select("row", "text").mapInArrow(run, "row bigint, score double"), "piece_scores")
    shared.destroy()
    return found


def score(docs: DataFrame, id: str = "doc_id", text: str = "text", held_out: Column | None = None) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row.

    Rows that are not held out are learned from, repeated rows as often as
    they come. ``base_score`` is that of single tokens with add-one
    smoothing, ``score`` that of the tree. Null and empty texts are the end
    symbol alone. Equal and null ids are scored row by row. If nothing is
    learned, all symbols are equally likely. An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    out = is_held_out(col_of(docs, id)) if held_out is None else held_out
    own = docs.select(col_of(docs, id).alias("doc_id"), out.alias("held_out"), F.coalesce(col_of(docs, text), F.lit("")).alias("text"))
    learned = own.filter(~F.col("held_out"))
    table = stored(counts(learned), "counts")
    words = table.filter(F.col("code").isNull()).select("word", "n")
    deepest = table.filter(F.col("code").isNotNull()).select("code", "n")
    seen = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    ends = deepest.filter(F.shiftright("code", 8 * DEPTH) == END).agg(F.sum("n")).first()[0] or 0
    n, v = (seen["n"] or 0) + ends, seen["v"] + (ends > 0)
    floor = COMMON_SHARE * n
    common = {bytes(r["word"], "utf-8"): float(np.log10(r["n"] + 1)) for r in words.filter(F.col("n") >= floor).collect()} if n else {}
    tree = states(deepest)
    ranges = pieces(tree, PIECE)
    if len(ranges) > 1:
        # Every piece has to meet the same rows.
        own = stored(own.withColumn("row", F.monotonically_increasing_id()), "texts")
    shared = spark.sparkContext.broadcast((piece(tree, *ranges[0]), common))
    bounds = ranges[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, logs = shared.value
        scorer = _Scorer(tree, *bounds)
        end_log = float(np.log10(ends + 1))
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            tokens, base, hits, rare, ks, ends_at, scores, parts, size = [], [], [], [], [], [0], [], [], 0
            for i, text in enumerate(texts):
                own = words_of(text)
                parts.append(spelled(own))
                size += len(parts[-1])
                times = Counter(own)
                total, sure = end_log, int(ends > 0)
                for w, k in times.items():
                    if (log := logs.get(w)) is None:
                        rare.append(w)
                        ks.append(k)
                    else:
                        total += k * log
                        sure += k
                ends_at.append(len(rare))
                tokens.append(len(own) + 1)
                base.append(total)
                hits.append(sure)
                if size >= SCORED or i == len(texts) - 1:
                    scores.append(scorer.sums(parts))
                    parts, size = [], 0
            yield pa.record_batch({
                **{c: batch.column(c) for c in kept}, "n_tokens": pa.array(tokens, pa.int64()), "sure": pa.array(hits, pa.int64()), "part": pa.array(base, pa.float64()),
                "score": np.concatenate(scores) if scores else np.empty(0), "rare": pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), pa.StructArray.from_arrays([pa.array(rare, pa.binary()).cast(pa.string()), pa.array(ks, pa.int32())], ["word", "k"]))})

    kind = docs.schema[id].dataType.simpleString() if id in docs.columns else "bigint"
    kept = [c for c in own.columns if c != "text"]
    row = "row bigint, " if "row" in kept else ""
    scored = own.mapInArrow(run, f"doc_id {kind}, held_out boolean, {row}n_tokens bigint, sure bigint, part double, score double, rare array<struct<word:string,k:int>>")
    scored = stored(scored if row else scored.withColumn("row", F.monotonically_increasing_id()), "scores")
    if len(ranges) > 1:
        others = reduce(DataFrame.union, [_scored_by(own, tree, *r) for r in ranges[1:]])
        scored = stored(scored.join(others.groupBy("row").agg(F.sum("score").alias("other")), "row").withColumn("score", F.col("score") + F.col("other")).drop("other"), "scores")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.k")
    found = rare.join(words.filter(F.col("n") < floor), "word").groupBy("row").agg(F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("more"), F.sum("k").alias("hits"))
    zero = F.lit(0).cast("long")
    base = F.col("part") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    return scored.drop("rare").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("sure") + F.coalesce("hits", zero)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
