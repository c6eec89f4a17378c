"""Spaced seeds against a comparison of every diagonal."""

import random
from itertools import combinations

import cases
import pyarrow.parquet as pq
import regex

from spanloom.llm import decontam
from spanloom.llm.queries import QUERIES


def words_of(text):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


def all_diagonals(docs, items):
    want = {}
    for d, text in docs:
        x = words_of(text)
        for i, item in items:
            y = words_of(item)
            for shift in range(-len(y) + 1, len(x)):
                equal = [y[k] == x[k + shift] for k in range(max(0, -shift), min(len(y), len(x) - shift))]
                if len(equal) >= 13 and sum(equal) >= 11 and max(sum(equal[k:k + 13]) for k in range(len(equal) - 12)) >= 11:
                    want[d, i] = max(want.get((d, i), (0, 0)), (sum(equal), len(equal)))
    return want


def test_masks_see_every_stretch():
    for gone in combinations(range(decontam.STRETCH), decontam.REPLACED):
        assert any(not {s + p for p in mask} & set(gone) for mask in decontam.MASKS for s in range(decontam.STRETCH - mask[-1]))


def test_replaced_words_and_parts(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    item = rng.choices(words, k=30)
    docs = {}
    for n in range(40):
        part = list(item[rng.randint(0, 10):rng.randint(18, 30)])
        for k in rng.sample(range(len(part)), rng.randint(0, 4)):
            part[k] = "other"
        docs[n] = " ".join(rng.choices(words, k=rng.randint(0, 30)) + part + rng.choices(words, k=5))
    docs[90] = " ".join(rng.choices(words, k=200))
    found = decontam.overlaps(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), spark.createDataFrame([(7, " ".join(item).upper() + "!")], "item_id bigint, text string"))
    want = all_diagonals(docs.items(), [(7, " ".join(item))])
    assert {(r["doc_id"], r["item_id"]): (r["matched_words"], r["compared_words"]) for r in found.collect()} == want
    assert 5 < len(want) < 40
    shuffled = decontam.overlaps(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string"), bound=0)
    assert {r["doc_id"] for r in shuffled.collect()} == {d for d, _ in want}


def test_query_equals_all_diagonals(spark):
    found = {(r["doc_id"], r["item_id"]) for r in QUERIES["op6_benchmark_decontamination"](spark, cases.SF).collect()}
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{cases.SF}/benchmark.parquet").to_pylist()]
    grams = {}
    for i, text in items:
        w = words_of(text)
        for k in range(len(w) - 3):
            grams.setdefault(tuple(w[k:k + 4]), set()).add(i)
    want = {}
    for d, text in cases.documents():
        w = words_of(text)
        near = {i for k in range(len(w) - 3) for i in grams.get(tuple(w[k:k + 4]), ())}
        want |= all_diagonals([(d, text)], [x for x in items if x[0] in near])
    assert found == set(want)


def test_odd_rows(spark):
    docs = cases.odd(spark)
    items = docs.withColumnRenamed("doc_id", "item_id")
    found = decontam.overlaps(docs, items).collect()
    assert all(r["matched_words"] <= r["compared_words"] for r in found)
    assert {(6, 6), (6, 7), (9, 9), (10, 9)} <= {(r["doc_id"], r["item_id"]) for r in found}
    nothing = cases.empty(spark).withColumnRenamed("doc_id", "item_id")
    assert decontam.overlaps(docs, nothing).count() == 0 and decontam.overlaps(cases.empty(spark), items).count() == 0
    kept = decontam.clean_rows(docs, nothing)
    assert kept.columns == docs.columns and kept.count() == docs.count()
