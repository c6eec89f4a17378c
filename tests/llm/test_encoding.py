"""Token ids, Re-Pair shards and packing."""

import random
import zlib

import cases
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanloom.llm import packing, repair
from spanloom.llm.queries import QUERIES
from spanloom.llm.token_ids import Encoder

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "a  b", "a\n\nb", "\ta b", "don't we'll IT'S", "x\xa0y", "É́ ß ÑÑ", "日本 語", "a <|endoftext|> b", "A.B\nC d ", "ﬁ Σας ΟΔΟΣ", "it's\nhe'S 12,000.5!! ~`", " lead", "a \nb", "a\n b", "e\x00f", "½ ² ª µ"]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encoder_equals_the_tokenizer(path):
    plain, own = Tokenizer.from_file(path), Encoder(path)
    for text in TEXTS + [t for _, t in cases.documents()]:
        assert own.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def apart(seq, pair):
    """In how many places that do not overlap a pair stands."""
    n, i = 0, 0
    while i < len(seq) - 1:
        hit = (seq[i], seq[i + 1]) == pair
        n, i = n + hit, i + 1 + hit
    return n


def test_a_rare_last_pair_starves_no_frequent_one():
    rng = np.random.default_rng(1)
    ids = np.concatenate((np.tile([7, 8, 9], 300), rng.integers(10, 40_000, 60_000)))
    seq, left, right = repair.compress(ids.astype(np.uint32), 40_000)
    assert len(seq) < 60_000 + 40 and repair.expand(seq, left, right, 40_000).tolist() == ids.tolist()


def test_grammars_give_back_every_range():
    rng = np.random.default_rng(3)
    for ids in (rng.integers(0, 9, 5000), np.zeros(1000, int), np.arange(50), np.array([5]), np.tile([1, 2, 3, 1, 2], 400)):
        top = int(ids.max()) + 1
        seq, left, right = repair.compress(ids.astype(np.uint32), top)
        assert repair.expand(seq, left, right, top).tolist() == ids.tolist() and len(seq) <= len(ids)
        spans = repair.spans_of(left, right, top)
        assert repair.expand_all(seq, left, right, spans, top).tolist() == ids.tolist()
        # No pair is left in as many places that do not overlap.
        assert all(apart(seq.tolist(), p) < repair.LEAST_PAIRS for p in set(zip(seq.tolist(), seq.tolist()[1:])))
        assert all(len(repair.expand(np.array([top + i]), left, right, top)) == s for i, s in enumerate(spans.tolist()))
        row = {k: v.astype("<u4").tobytes() for k, v in (("sequence", seq), ("left", left), ("right", right), ("spans", spans))} | {"symbols": top}
        for _ in range(20):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
            if a < b:
                assert repair.slice_ids(row, a, b).tolist() == ids[a:b].tolist()
    assert len(repair.compress(np.tile([1, 2, 3, 1, 2], 4000), 4)[0]) < 500


def test_written_ids_come_back(spark):
    plain, at = Tokenizer.from_file(WORDS), 0
    found = cases.rows_of(QUERIES["op4_token_id_output"](spark, cases.SF))
    for d, text in cases.documents():
        ids = np.array(plain.encode(text, add_special_tokens=False).ids + [1], "<u4")
        assert (found[d]["start"], found[d]["n_tokens"], found[d]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_small_shards_and_odd_rows(spark, tmp_path):
    for name, df, n in (("odd", cases.odd(spark), len(cases.odd_rows())), ("empty", cases.empty(spark), 0)):
        repair.write(df, str(tmp_path / name), WORDS, 1, shard_ids=50)
        shards = repair.read(spark, str(tmp_path / name))
        rows = sorted(repair.digests(shards).collect(), key=lambda r: r["start"])
        assert len(rows) == n
        at = 0
        for r in rows:
            assert r["start"] == at
            at += r["n_tokens"]
        ids = [r["doc_id"] for r in rows]
        assert ids == sorted(ids, key=lambda x: -1 if x is None else x)


def best_two_fit(lengths, capacity):
    """One bin at a time, one piece at a time."""
    left, bins = sorted(lengths), []
    while left:
        bin_, gap = [], capacity
        while fits := [x for x in left if x <= gap]:
            bin_.append(fits[-1])
            left.remove(fits[-1])
            gap -= fits[-1]
        if gap and len(bin_) > 1:
            low = bin_[-1]
            pairs = [(a + b, max(a, b), [max(a, b), min(a, b)]) for i, a in enumerate(left) for b in left[:i] if low < a + b <= gap + low]
            if pairs:
                pair = max(pairs)[2]
                bin_[-1:] = pair
                left.append(low)
                for x in pair:
                    left.remove(x)
                left.sort()
        bins.append(sorted(bin_))
    return bins


def test_plan_equals_packing_piece_by_piece():
    rng = random.Random(6)
    for trial in range(60):
        capacity = rng.choice([10, 37, 100])
        lengths = [rng.randint(1, rng.choice([capacity, capacity // 2 + 1, 5])) for _ in range(rng.randint(0, 120))]
        plan = packing.plan({x: lengths.count(x) for x in set(lengths)}, capacity)
        made = [sorted(p.lengths) for p in plan for _ in range(p.times)]
        assert sorted(x for b in made for x in b) == sorted(lengths) and all(sum(b) <= capacity for b in made)
        assert made == best_two_fit(lengths, capacity)


def check_packed(rows, want, capacity=2048):
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packed_documents(spark):
    plain, want, total = Tokenizer.from_file(BYTES), {}, 0
    for d, text in cases.documents():
        ids = np.array(plain.encode(text, add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, piece] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    bins = check_packed(QUERIES["op5_best_fit_packing"](spark, cases.SF).collect(), want)
    assert bins <= 1.01 * total / 2048 + 1


def test_sequences_and_odd_rows(spark):
    packed = packing.pack(cases.odd(spark), BYTES)
    rows = packed.collect()
    assert sum(r["piece"] == 0 for r in rows) == len(cases.odd_rows())
    made = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    for r in rows:
        assert made[r["sequence_id"]][4 * r["offset"]:4 * (r["offset"] + r["length"])] == bytes(r["ids"])
    assert packing.pack(cases.empty(spark), BYTES).count() == 0


def test_small_memory_gives_the_same_ids():
    texts = [" ".join(f"w{i * 31 + j} common{j}" for j in range(40)) for i in range(30)]
    small, plain = Encoder(BYTES, kept_pieces=100, kept_parts=50), Encoder(BYTES)
    for text in texts:
        assert small.encode(text).tolist() == plain.encode(text).tolist()
        assert len(small.known) <= 200 and len(small.parts) <= 50


def test_long_texts_reach_python_in_small_batches(spark):
    texts = spark.range(0, 64, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"n": [sum(map(len, batch.column(0).to_pylist()))]})

    found = [r["n"] for r in texts.mapInArrow(sizes, "n bigint").collect()]
    assert sum(found) == 64 << 20 and max(found) <= 8 << 20
