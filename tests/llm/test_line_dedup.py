"""Aligned lines: what goes, and that nothing is lost."""

import random

import cases

from spanloom.llm import line_dedup
from spanloom.llm.queries import QUERIES


def run(spark, docs, **options):
    found = line_dedup.dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), **options)
    return {r["doc_id"]: r["text"] for r in found.collect()}


def line(rng, n):
    return " ".join(rng.choices([f"w{i}" for i in range(5000)], k=n))


def test_blocks_go_from_the_later_document(spark):
    rng = random.Random(1)
    passage, short, parts = line(rng, 60), line(rng, 12), [line(rng, 20) for _ in range(3)]
    own = {i: [line(rng, 15) for _ in range(4)] for i in range(8)}
    docs = {
        0: [own[0][0], passage, short, *own[0][1:]], 1: [*own[1], passage], 2: [short, own[2][0], passage, own[2][1], passage], 3: [*parts, *own[3]], 4: [own[4][0], *parts, own[4][1]],
        5: [own[5][0], parts[0], own[5][1], parts[2], short], 6: [*own[0][1:], passage, own[6][0], own[0][0]], 7: own[7],
    }
    found = {i: t.split("\n") for i, t in run(spark, {i: "\n".join(t) for i, t in docs.items()}).items()}
    assert found[0] == docs[0] and found[3] == docs[3] and found[7] == docs[7]
    assert found[1] == own[1] and found[2] == [short, own[2][0], own[2][1]] and found[4] == [own[4][0], own[4][1]]
    assert found[5] == docs[5]
    assert found[6] == [*own[0][1:], own[6][0], own[0][0]]


def test_moved_blocks_and_copies(spark):
    rng = random.Random(2)
    a, b, c = ([line(rng, 30) for _ in range(3)] for _ in range(3))
    found = run(spark, {1: "\n".join(a + b + c), 2: "\n".join(c + ["here"] + a), 3: "\n".join(a + b + c), 9: "\n".join(b + a + b)})
    assert found == {1: "\n".join(a + b + c), 2: "here", 3: "", 9: ""}


def test_whole_table(spark):
    found = cases.rows_of(QUERIES["op9_line_dedup"](spark, cases.SF))
    docs = dict(cases.documents())
    holders, kept = {}, {}
    for d, text in docs.items():
        for x in {x.strip() for x in text.split("\n")}:
            holders.setdefault(x, []).append(d)
    for d, row in found.items():
        left = row["text"].split("\n") if row["removed_lines"] < row["lines"] else []
        before = docs[d].split("\n")
        it = iter(before)
        assert all(x in it for x in left) and row["lines"] == len(before) and row["removed_lines"] == len(before) - len(left)
        for x in {x.strip() for x in left}:
            kept.setdefault(x, []).append(d)
    # The first copy of every line stays; of long lines nothing else does.
    assert all(min(kept[x]) == min(ids) for x, ids in holders.items())
    assert all(len(ids) == 1 for x, ids in kept.items() if len(x.split()) >= line_dedup.MIN_WORDS)
    assert sum(r["removed_lines"] for r in found.values()) > 0


def test_odd_rows(spark):
    df = cases.odd(spark)
    found = line_dedup.dedup_lines(df, length="n_chars")
    assert found.columns == [*df.columns, "lines", "removed_lines"] and found.count() == len(cases.odd_rows())
    rows = found.collect()
    assert {r["text"] for r in rows if r["doc_id"] == 10} == {"other tail"} and {r["text"] for r in rows if r["doc_id"] == 9} == {"line " * 60 + "\ntail"}
    assert {r["n_chars"] for r in rows if r["doc_id"] == 10} == {10}
    assert all(r["lines"] == 0 for r in rows if r["text"] is None)
    assert line_dedup.dedup_lines(cases.empty(spark), counts=False).columns == df.columns
