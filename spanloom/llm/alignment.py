"""Two tokenizers side by side: which of their tokens overlap, in every text and in the whole corpus.

The bytes of a text are cut twice, by a byte-level file (A) and a
sentencepiece file (B). Where tokens of both end, a group ends; every stretch
between two neighbouring ends of either kind lies in one token of A and one of
B, so stretches and links (pairs of tokens that overlap) are the same thing.

Links are counted by an inverted index. Documents are numbered in containers;
for every pair of ids a container has the bitmap of its documents, in planes:
plane ``p`` has the documents whose number of links of that pair has bit ``p``
set. Planes merged by OR have the documents of the pair; planes weighed by
their bit have its links. The counts of the corpus then go back along the same
postings and add up to the scores of each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from spanloom.llm.frames import col_of, stored
from spanloom.llm.token_ids import Encoder, groups

#: A container closes at so many links or documents; a document is in one container whole.
CONTAINER_LINKS, CONTAINER_DOCS = 4_000_000, 1 << 16
#: A plane with fewer documents is a list of 16-bit numbers, any other a bitmap of all places.
DENSE, BITMAP = 4096, CONTAINER_DOCS // 8
#: Units (a word and what stands before it) that are kept at most; then the memory starts anew.
KEPT_UNITS = 600_000
#: Pair rows in one batch of output.
ROWS = 100_000


class Aligner:
    """Aligns texts of one pair of tokenizer files; what is known of a word is kept."""

    def __init__(self, path_a: str, path_b: str):
        self.a = tokenizers.Tokenizer.from_file(path_a)
        # Strings of special tokens in a text are plain text.
        self.a.encode_special_tokens = True
        self.pieces = Encoder(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {chr(shown): b for b, shown in self.pieces.visible.items()}
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for shown, i in vocabulary.items():
            self.bytes_a[i] = bytes(map(byte_of.__getitem__, shown)) if all(c in byte_of for c in shown) else shown.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(s[3:5], 16)]) if self.b.is_byte(i) else s.replace("▁", " ").encode() for i, s in enumerate(names)]
        self.size_a, self.size_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.bytes_a, self.bytes_b))
        self.cuts = self.pieces.byte_level and self._cuts_at_words(names)
        self._clear()

    def _cuts_at_words(self, names: list[str]) -> bool:
        """Whether merges of B never cross a line end, nor the place before a space: no piece has either inside."""
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.b.serialized_model_proto())
        normal = model.normalizer_spec
        plain = normal.name == "identity" and normal.add_dummy_prefix and normal.escape_whitespaces and not normal.remove_extra_whitespaces
        whole = any("\n" in s or "▁" in s.lstrip("▁") for s in names)
        return plain and not whole and model.trainer_spec.model_type == 2 and all(p.type != 4 for p in model.pieces)

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        #: Of every unit: tokens of A and B, groups, links and where they begin; links of all units; the groups as text.
        self.numbers = np.zeros((5, 1 << 14), np.int64)
        self.links, self.used = np.empty(1 << 16, np.int64), 0
        self.shown: list[str | None] = []

    def _units(self, text: str) -> list[str] | None:
        """Words with the line end before them, if any; every other one has a space before it. None for texts to be taken whole."""
        if not self.cuts or self.pieces._pieces(text) is None:
            return None
        return text.replace("\n", " \n").split(" ")

    def _learn(self, new: list[str]) -> None:
        ids_b = self.b.encode(new)
        cut = []
        for unit, b in zip(new, ids_b):
            line = unit[0] == "\n"
            # B puts a space before every text it is given; before a line end none belongs there.
            cut.append((self.pieces.ids_of(unit), b[1:] if line else b, (unit if line else " " + unit).encode()))
        numbers, links, shown = self.measured(cut)
        first = len(self.shown)
        while first + len(new) > self.numbers.shape[1]:
            self.numbers = np.concatenate((self.numbers, np.zeros_like(self.numbers)), axis=1)
        while self.used + len(links) > len(self.links):
            self.links = np.concatenate((self.links, self.links))
        self.numbers[:4, first:first + len(new)] = numbers
        self.numbers[4, first:first + len(new)] = self.used + np.cumsum(numbers[3]) - numbers[3]
        self.links[self.used:self.used + len(links)] = links
        self.used += len(links)
        self.shown += shown

    def measured(self, cut: list[tuple[list[int], list[int], bytes]]) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
        """Of stretches of bytes with their ids in A and B: numbers of tokens in A and B, groups and links; all links; the groups as text.

        Where the bytes of the ids are not those of the stretch, nothing is counted and the text is None.
        """
        right = [b"".join(map(self.bytes_a.__getitem__, a)) == data == b"".join(map(self.bytes_b.__getitem__, b)) for a, b, data in cut]
        cut = [x if ok else ([], [], b"") for x, ok in zip(cut, right)]
        n_a, n_b, size = (np.array([len(x[i]) for x in cut], np.int64) for i in range(3))
        a = np.fromiter((i for x in cut for i in x[0]), np.int64, n_a.sum())
        b = np.fromiter((i for x in cut for i in x[1]), np.int64, n_b.sum())
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        # Where a stretch ends, both of its tokens end, so places in all stretches together tell them apart.
        ends = np.unique(np.concatenate((ends_a, ends_b)))
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        links = a[np.searchsorted(ends_a, ends)] * len(self.bytes_b) + b[np.searchsorted(ends_b, ends)]
        to = np.cumsum(size)
        count = lambda places: np.diff(np.searchsorted(places, to, side="right"), prepend=0)
        group = np.concatenate((np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)))
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((side, group))
        ids, group, side = np.concatenate((a, b))[order], group[order], side[order]
        last = np.append((group[1:] != group[:-1]) | (side[1:] != side[:-1]), True) if len(ids) else np.empty(0, bool)
        items = [f"{i}{mark}" for i, mark in zip(ids.tolist(), np.where(last, np.where(side == 0, "|", ";"), ",").tolist())]
        stops = np.cumsum(n_a + n_b).tolist()
        shown = ["".join(items[x:y]) if ok else None for x, y, ok in zip([0, *stops], stops, right)]
        return np.array([n_a, n_b, count(common), count(ends)]), links, shown

    def align(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
        """Of every text the numbers of tokens in A and B, groups and links; its links, ``a * ids of B + b``; its groups as text, '' without tokens."""
        if len(self.known) > KEPT_UNITS:
            self._clear()
        units = [self._units(text) if text else [] for text in texts]
        # What is new in any of the texts is cut and measured at once.
        if new := [u for u in dict.fromkeys(chain.from_iterable(filter(None, units))) if u not in self.known]:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self._learn(new)
        none = np.zeros(4, np.int64), np.empty(0, np.int64), ""
        for text, own in zip(texts, units):
            if own is None:
                numbers, links, shown = self.measured([(self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text), (" " + text).encode())])
                yield (numbers[:, 0], links, shown[0][:-1]) if shown[0] else none
                continue
            at = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))
            parts = [self.shown[i] for i in at.tolist()]
            if not parts or None in parts:
                yield none
                continue
            numbers = self.numbers[:, at]
            stops = np.cumsum(numbers[3])
            links = self.links[np.repeat(numbers[4] - stops + numbers[3], numbers[3]) + np.arange(stops[-1])]
            yield numbers[:4].sum(axis=1), links, "".join(parts)[:-1]


def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of two files, one per process (functions travel to workers without the globals of this module)."""
    kept = tokenizers.__dict__.setdefault("_aligners_by_paths", {})
    if (path_a, path_b) not in kept:
        kept[path_a, path_b] = Aligner(path_a, path_b)
    return kept[path_a, path_b]


def planes_of(keys: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Pairs and their planes from ``pair << 16 | document`` of every link, which are sorted in place."""
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    times = np.diff(np.append(first, len(keys)))
    pairs, docs = keys[first] >> 16, keys[first] & 0xFFFF
    begin = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
    number = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(pairs))))
    n_planes = np.frexp(np.maximum.reduceat(times, begin).astype(float))[1].astype(np.int64)
    base = np.cumsum(n_planes) - n_planes
    flat, places = [], []
    for p in range(int(n_planes.max())):
        own = np.flatnonzero(times >> p & 1)
        flat.append(base[number[own]] + p)
        places.append(docs[own])
    flat, places = np.concatenate(flat), np.concatenate(places)
    # Every plane is in the order of pairs and documents already.
    places = places[np.argsort(flat, kind="stable")].astype("<u2")
    counts = np.bincount(flat, minlength=int(n_planes.sum()))
    ends = np.cumsum(counts)
    parts, done = [], 0
    for dense in np.flatnonzero(counts >= DENSE).tolist():
        start, end = int(ends[dense] - counts[dense]), int(ends[dense])
        bits = np.zeros(CONTAINER_DOCS, np.uint8)
        bits[places[start:end]] = 1
        parts += [places[done:start].tobytes(), np.packbits(bits, bitorder="little").tobytes()]
        done = end
    parts.append(places[done:].tobytes())
    offsets = np.concatenate(([0], np.cumsum(np.where(counts < DENSE, 2 * counts, BITMAP)))).astype(np.int32)
    data = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(parts))])
    return pairs[begin], pa.ListArray.from_arrays(pa.array(np.append(base, len(counts)).astype(np.int32)), data)


class Planes:
    """A column of planes in arrays: of every plane its row, bit and bytes."""

    def __init__(self, column: pa.Array):
        self.rows = len(column)
        per_row = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten().cast(pa.binary())
        self.row = np.repeat(np.arange(self.rows), per_row)
        self.bit = np.arange(len(flat)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        self.size = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset:flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
        self.at = offsets[:-1].astype(np.int64)
        self.data = np.frombuffer(flat.buffers()[2], np.uint8) if len(flat) and flat.buffers()[2] else np.empty(0, np.uint8)
        self.dense = self.size == BITMAP

    def bitmap(self, plane: int) -> np.ndarray:
        """A plane as a bitmap, whatever its form."""
        own = self.data[self.at[plane]:self.at[plane] + self.size[plane]]
        if self.dense[plane]:
            return own
        bits = np.zeros(CONTAINER_DOCS, np.uint8)
        bits[own.view("<u2")] = 1
        return np.packbits(bits, bitorder="little")

    def entries(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Plane and document of every entry of some planes."""
        sparse, places, planes = which & ~self.dense, [], []
        own = np.flatnonzero(sparse)
        n = self.size[own] // 2
        ends = np.cumsum(n)
        if len(ends) and ends[-1]:
            words = self.data[: len(self.data) // 2 * 2].view("<u2")
            places.append(words[np.repeat(self.at[own] // 2 - ends + n, n) + np.arange(ends[-1])].astype(np.int64))
            planes.append(np.repeat(own, n))
        for plane in np.flatnonzero(which & self.dense).tolist():
            places.append(np.flatnonzero(np.unpackbits(self.bitmap(plane), bitorder="little")))
            planes.append(np.full(len(places[-1]), plane))
        empty = [np.empty(0, np.int64)]
        return np.concatenate(planes or empty), np.concatenate(places or empty)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Documents and links of every row: bits of its planes merged by OR, and bits of each plane times its weight."""
        cards = self.size // 2
        for plane in np.flatnonzero(self.dense).tolist():
            cards[plane] = int(np.bitwise_count(self.bitmap(plane)).sum())
        links = np.zeros(self.rows, np.int64)
        np.add.at(links, self.row, cards << self.bit)
        docs = np.zeros(self.rows, np.int64)
        single = np.bincount(self.row, minlength=self.rows) == 1
        docs[self.row[single[self.row]]] = cards[single[self.row]]
        many = ~single[self.row]
        with_bitmap = np.zeros(self.rows, bool)
        with_bitmap[self.row[many & self.dense]] = True
        plane, place = self.entries(many & ~with_bitmap[self.row])
        docs += np.bincount(np.unique(self.row[plane] << 16 | place) >> 16, minlength=self.rows)
        for row in np.flatnonzero(with_bitmap).tolist():
            merged = np.zeros(BITMAP, np.uint8)
            for own in np.flatnonzero(self.row == row).tolist():
                merged |= self.bitmap(own)
            docs[row] = int(np.bitwise_count(merged).sum())
        return docs, links


def index(df: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of documents (``pair`` is null) and of the inverted index (``pair``, ``planes``), by container; store it before use."""
    kind = df.select(col_of(df, id)).schema[0].dataType.simpleString()
    own = df.select(col_of(df, id).alias("id"), col_of(df, text).cast("string").alias("text"), F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, number = aligner(path_a, path_b), 0
        rows, keys, total, part = [], [], 0, 0

        def closed() -> Iterator[pa.RecordBatch]:
            container = part << 32 | number
            n = len(rows)
            ids, numbers, digests = zip(*rows)
            numbers = np.array(numbers)
            yield batch_of(n, container, at=pa.array(np.arange(n, dtype=np.int32)), id=pa.concat_arrays(ids), sha=pa.array(digests, pa.string()),
                           **{k: pa.array(numbers[:, i]) for i, k in enumerate(("n_a", "n_b", "n_groups", "n_links"))})
            if total:
                pairs, planes = planes_of(np.concatenate(keys))
                for a in range(0, len(pairs), ROWS):
                    yield batch_of(len(pairs[a:a + ROWS]), container, pair=pa.array(pairs[a:a + ROWS]), planes=planes.slice(a, ROWS))

        def batch_of(n: int, container: int, **columns: pa.Array) -> pa.RecordBatch:
            whole = {"container": pa.array(np.full(n, container, np.int64))} | columns
            return pa.record_batch([whole.get(k, pa.nulls(n, t)) for k, t in types.items()], names=list(types))

        types = None
        for batch in batches:
            types = types or {"container": pa.int64(), "at": pa.int32(), "id": batch.schema.field(0).type, "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(),
                              "n_links": pa.int64(), "sha": pa.string(), "pair": pa.int64(), "planes": pa.list_(pa.binary())}
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            texts = batch.column(1).to_pylist()
            for group in groups(texts):
                for i, (numbers, links, shown) in enumerate(tool.align(texts[group]), group.start):
                    if rows and (len(rows) == CONTAINER_DOCS or total + len(links) > CONTAINER_LINKS):
                        yield from closed()
                        rows, keys, total, number = [], [], 0, number + 1
                    keys.append(links << 16 | len(rows))
                    rows.append((batch.column(0).slice(i, 1), numbers, hashlib.sha256(shown.encode()).hexdigest() if shown else ""))
                    total += len(links)
        if rows:
            yield from closed()

    return own.mapInArrow(run, f"container bigint, at int, id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, sha string, pair bigint, planes array<binary>")


def pairs(indexed: DataFrame, path_b: str) -> DataFrame:
    """``pair``, ``a``, ``b``, ``n_docs``, ``n_links`` and ``best`` (no pair of its ``b`` has more links) of every pair that is linked anywhere."""
    ids = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, links = Planes(batch.column(1)).counts()
            yield pa.record_batch([batch.column(0), pa.array(docs), pa.array(links)], names=["pair", "n_docs", "n_links"])

    counted = indexed.filter("pair is not null").select("pair", "planes").mapInArrow(run, "pair bigint, n_docs bigint, n_links bigint")
    summed = counted.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    own = summed.select("pair", F.expr(f"cast(pair div {ids} as int)").alias("a"), (F.col("pair") % ids).cast("int").alias("b"), "n_docs", "n_links")
    # At most as many rows of a b as A has ids.
    return own.withColumn("best", F.col("n_links") == F.max("n_links").over(Window.partitionBy("b")))


def scores(indexed: DataFrame, counts: DataFrame) -> DataFrame:
    """``container``, ``at``, ``n_best`` and ``count_sum`` of every document with links, from its postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, best, sums = None, None, None

        def closed() -> pa.RecordBatch:
            own = np.flatnonzero(sums)
            return pa.record_batch({"container": pa.array(np.full(len(own), open_, np.int64)), "at": pa.array(own.astype(np.int32)), "n_best": pa.array(best[own]), "count_sum": pa.array(sums[own])})

        for batch in batches:
            containers = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(containers)) + 1).tolist(), len(containers)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if containers[a] != open_:
                    if open_ is not None:
                        yield closed()
                    open_, best, sums = int(containers[a]), np.zeros(CONTAINER_DOCS, np.int64), np.zeros(CONTAINER_DOCS, np.int64)
                planes = Planes(batch.column(1).slice(a, b - a))
                plane, place = planes.entries(np.ones(len(planes.row), bool))
                weight, row = np.int64(1) << planes.bit[plane], planes.row[plane]
                np.add.at(sums, place, weight * batch.column(2).slice(a, b - a).to_numpy()[row])
                np.add.at(best, place, weight * batch.column(3).slice(a, b - a).to_numpy(zero_copy_only=False)[row])
        if open_ is not None:
            yield closed()

    found = indexed.filter("pair is not null").select("container", "pair", "planes").join(counts.select("pair", "n_links", "best").hint("merge"), "pair")
    ordered = found.select("container", "planes", "n_links", "best").repartition("container").sortWithinPartitions("container")
    return ordered.mapInArrow(run, "container bigint, at int, n_best bigint, count_sum bigint")


def align(df: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256`` of every row.

    Texts that are null, empty or not given back by the bytes of both
    tokenizers have no tokens: zeros and ''. Null and repeated ids and repeated rows stay
    documents of their own; an empty table gives no rows. Very long texts are
    aligned whole. Other columns are not read.
    """
    indexed = stored(index(df, path_a, path_b, id, text), "pair_index")
    counts = stored(pairs(indexed, path_b), "pair_counts")
    docs = indexed.filter("pair is null").join(scores(indexed, counts), ["container", "at"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return docs.select(F.col("id").alias(id), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), F.col("sha").alias("groups_sha256"))
