"""Personal data: base spans against the plain patterns, candidates, redaction."""

import hashlib
import re

import cases
import pytest
from pyspark.sql import functions as F

from spanloom.llm import pii
from spanloom.llm.queries import QUERIES

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    found = []
    for no, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                found.append((m.start(), no, m.end()))
    return sorted(found)


def test_query_equals_plain_patterns(spark):
    found = cases.rows_of(QUERIES["op7_personal_data"](spark, cases.SF))
    for d, text in cases.documents():
        spans = base(text)
        listed = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans]
        assert found[d]["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(found[d]["spans"].split(",")) | {""}
        assert all(found[d][f"n_{kind}"] == sum(k == no for _, k, _ in spans) for no, kind in enumerate(pii.KINDS))


TRICKY = ["a@b.c_d@e.f", "a@b@c.d", "x@y..z", "..@a-.b", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.0003.255", "9" * 3000 + ".1.2", "a" * 3000, "4111 1111-1111 1111", "4111  1111 1111 1111",
          "+1 (988) 555-2485 4111111111111111", "+1+2 345 678 901", "+44 20 7946 0958.", "😀 a@b.co 😀 10.0.0.1", "q@" + "a." * 4000 + "b", "+" + "1-" * 2000, ""]


def test_tricky_texts(spark):
    rows = pii.scan(spark.createDataFrame(list(enumerate(TRICKY)), "doc_id int, text string"), "doc_id", "text").collect()
    for r in rows:
        assert [(s["start"], s["kind"], s["end"]) for s in r["spans"]] == base(TRICKY[r["doc_id"]])


def test_trees_add_what_the_patterns_miss(spark):
    rows = [(i, f"mail to user{i}.x@host{i % 7}.example.com or call +1 (5{i % 90 + 10}) 555-{1000 + i} from 10.{i % 250}.3.{i % 99} card {card(i)}") for i in range(400)]
    odd = [(1000, "write user12.x (at) host3 dot example dot com today"), (1001, "call (512) 555-1234 now"), (1002, "nothing to see here in 2024, only 12 words")]
    found = {r["doc_id"]: r for r in pii.detect(spark.createDataFrame(rows + odd, "doc_id int, text string")).collect()}
    assert all(len(found[i]["spans"]) >= 4 for i in range(400))
    assert [s["kind"] for s in found[1000]["added"]] == [0]
    assert not found[1002]["added"] and not found[1002]["spans"]
    for r in found.values():
        spans = sorted((s["start"], s["end"]) for s in r["added"])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        assert not any(s["start"] < x["end"] and x["start"] < s["end"] for s in r["added"] for x in r["spans"])


def card(i):
    stem = f"4{i * 7919:014d}"
    return stem + next(c for c in "0123456789" if luhn(stem + c))


def test_redaction_and_odd_rows(spark):
    done = pii.redact(spark.createDataFrame([(1, "😀 a@b.co and 10.0.0.1!"), (2, "none"), (3, None)], "doc_id int, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in done} == {1: "😀 <email> and <ip>!", 2: "none", 3: ""}
    assert pii.detect(cases.odd(spark)).count() == len(cases.odd_rows()) and pii.detect(cases.empty(spark)).count() == 0


def test_candidates_do_not_depend_on_the_rest_of_the_text(spark):
    spans = [(0, "joe at example.com"), (0, "joe at example[dot]com"), (0, "joe at example dot com"), (0, "joe (at) example.com"), (1, "10[.]2[.]3[.]4"), (1, "10 (.) 2 (.) 3 (.) 4"), (1, "10,2,3,4")]
    rows = pii.scan(spark.createDataFrame([(i, f"from {s} today") for i, (_, s) in enumerate(spans)], "doc_id int, text string"), "doc_id", "text").collect()
    assert len(rows) == len(spans)
    for r in rows:
        kind, match = spans[r["doc_id"]]
        assert (kind, match) in [(c["kind"], c["match"]) for c in r["candidates"]]


def test_numbers_that_run_into_others_are_proposed_and_chosen(spark):
    rows = [(i, f"reach user{i}@host{i % 7}.example.com, card {card(i)} paid, or call +1 (5{i % 90 + 10}) 555-{1000 + i}") for i in range(400)]
    text = "my card 4111 1111 1111 1111 12/27 thanks"
    df = spark.createDataFrame([*rows, (1000, text)], "doc_id int, text string")
    proposed = pii.scan(df.filter("doc_id = 1000"), "doc_id", "text").first()["candidates"]
    assert {(8, 27), (8, 30)} <= {(c["start"], c["end"]) for c in proposed if c["kind"] == 2}
    assert all(text[c["start"]:c["end"]] == c["match"] for c in proposed)
    found = pii.detect(df).filter("doc_id = 1000").first()
    assert [(s["kind"], s["start"], s["end"]) for s in found["added"]] == [(2, 8, 27)]


def test_very_long_texts_with_many_spans(spark):
    text = " ".join(f"u{i}@h{i}.org 10.0.{i % 250}.7 +44 20 7946 {i % 9000 + 1000}" for i in range(20_000))
    found = pii.scan(spark.createDataFrame([(1, text)], "doc_id int, text string"), "doc_id", "text").first()
    assert [(s["start"], s["kind"], s["end"]) for s in found["spans"]] == base(text)
    assert all(text[s["start"]:s["end"]] == s["match"] and text[max(0, s["start"] - 24):s["start"]].endswith(s["before"]) and text[s["end"]:].startswith(s["after"]) for s in found["candidates"])


def test_trees_learn_from_all_spans(spark, monkeypatch):
    seen = {}

    class Stop(Exception):
        pass

    def fit(self, train):
        seen.update(rows=train.count(), bins=self.getMaxBins())
        raise Stop

    monkeypatch.setattr(pii.GBTClassifier, "fit", fit)
    spans = spark.range(7000).select(F.lit(0).alias("kind"), F.concat(F.lit("u"), "id", F.lit("@h.org")).alias("match"), F.lit("").alias("before"), F.lit("").alias("after"))
    with pytest.raises(Stop):
        pii.fit(spans)
    assert seen["rows"] == pii.examples(spans).filter(F.pmod("origin", F.lit(5)) != 0).count() > 20_000
    # From this many bins on no row is left out where split points are proposed.
    assert seen["bins"] ** 2 >= seen["rows"]
