"""Toxicity: made-up slurs, unseen forms of them, whole texts."""

import random
import zlib

import cases
import numpy as np

from spanloom.llm import toxicity
from spanloom.llm.queries import QUERIES


_RNG = random.Random(1)
#: One language for all texts.
WORDS = ["".join(_RNG.choices(["ba", "re", "ti", "lo", "mu", "sen"], k=_RNG.randint(1, 4))) for _ in range(800)]


def texts(rng, n, toxic, slurs):
    words = WORDS
    out = []
    for _ in range(n):
        t = rng.choices(words, k=rng.randint(30, 300))
        if toxic:
            for _ in range(rng.randint(2, 5)):
                t[rng.randrange(len(t))] = rng.choice(slurs)
        out.append(" ".join(t))
    return out


def test_unseen_forms_and_long_texts():
    rng = random.Random(8)
    slurs = ["zgrumpf" + e for e in ("", "er", "en", "ling", "isch")]
    pos, neg = texts(rng, 150, True, slurs), texts(rng, 250, False, slurs)
    model = toxicity.train(pos + neg, np.array([1] * 150 + [0] * 250))
    assert (model.scores(texts(rng, 100, True, slurs)) >= 0.7).mean() > 0.9
    assert (model.scores(texts(rng, 100, True, ["zgrumpfheit", "zgrumpfton"])) >= 0.7).mean() > 0.8
    clean = texts(rng, 100, False, slurs)
    assert (model.scores(clean) >= 0.7).mean() < 0.05
    long = " ".join(clean)
    assert (model.scores([long, long + " zgrumpfer you zgrumpf zgrumpfen", "", None]) >= 0.7).tolist() == [False, True, False, False]


def test_subwords_belong_to_their_words():
    rows, counts = toxicity.subwords(["stupid", "a", "É日"])
    alone = [toxicity.subwords([w])[0] for w in ("stupid", "a", "É日")]
    assert counts.tolist() == [len(a) for a in alone] and rows.tolist() == [x for a in alone for x in a.tolist()]
    shared = set(toxicity.subwords(["stupid"])[0].tolist()) & set(toxicity.subwords(["stupids"])[0].tolist())
    assert len(shared) > 5


def test_query(spark):
    found = cases.rows_of(QUERIES["op3_toxicity"](spark, cases.SF))
    assert set(found) == {d for d, _ in cases.documents()}
    for d, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)


def test_odd_rows(spark):
    labels = spark.createDataFrame([(0, 1), (3, None), (3, 0), (6, 1), (9, 0), (None, 1), (77, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(cases.odd(spark), labels)
    assert toxicity.score(cases.odd(spark), model).count() == len(cases.odd_rows())
    nothing = toxicity.fit(cases.empty(spark), labels)
    assert toxicity.score(cases.empty(spark), nothing).count() == 0
    assert {round(r["score"], 3) for r in toxicity.score(cases.odd(spark), nothing).collect()} == {0.0, 0.018}
