"""Quality rules against plain counts, and EM on votes with known accuracies."""

import random
import re
from collections import Counter

import cases
import pyarrow.parquet as pq

from spanloom.llm import quality
from spanloom.llm.queries import QUERIES


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {p for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_plain_code(spark):
    found = cases.rows_of(QUERIES["op10_quality_rules"](spark, cases.SF))
    texts = dict(cases.documents())
    assert set(found) == set(texts)
    for doc_id, row in found.items():
        want = plain(texts[doc_id])
        assert tuple(row[c] for c in quality.COUNTS) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert row["base_failed"] == failed and (not failed or not row["kept"])


def test_junk_goes_and_clean_texts_stay(spark):
    found = cases.rows_of(QUERIES["op10_quality_rules"](spark, cases.SF.replace("0.001", "0.1")))
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(cases.SF.replace("0.001", "0.1") + "/labels.parquet").to_pylist()}
    open_ = [(labels[d], r["kept"]) for d, r in found.items() if d in labels and not r["base_failed"]]
    assert sum(kept for good, kept in open_ if good) >= 0.99 * sum(1 for good, _ in open_ if good)
    assert sum(not kept for good, kept in open_ if not good) >= 0.9 * sum(1 for good, _ in open_ if not good)


PRIORS = [rule.prior() for rule in quality.RULES]


def test_em_finds_how_often_rules_see_junk():
    rng, rates, patterns = random.Random(3), (0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15), Counter()
    speaking = [rule.good_to is not None or rule.good_from is not None for rule in quality.RULES]
    for _ in range(20_000):
        good = rng.random() < 0.8
        rest = [quality.GOOD if s and rng.random() < (0.95 if good else 0.6) else quality.ABSTAIN for s in speaking]
        patterns[tuple(quality.BAD if not good and rng.random() < x else v for x, v in zip(rates, rest))] += 1
    model = quality.fit(dict(patterns), PRIORS)
    assert abs(model.prior - 0.8) < 0.03
    assert all(abs(table[quality.BAD][quality.BAD] - x) < 0.05 for table, x in zip(model.tables, rates))
    assert quality.fit({}, PRIORS).prior == 0.8


def test_every_kind_of_junk_goes_at_every_size():
    clean = tuple(quality.GOOD if rule.good_to is not None or rule.good_from is not None else quality.ABSTAIN for rule in quality.RULES)
    single = [tuple(quality.BAD if i == r else v for i, v in enumerate(clean)) for r in range(len(clean))]
    silent = tuple(quality.ABSTAIN if rule.name == "sentences" else v for rule, v in zip(quality.RULES, clean))
    for times in (0.1, 1, 10, 1000):
        patterns = Counter({clean: round(9000 * times), silent: round(300 * times), **{v: round(100 * times) for v in single}})
        for a, b in zip(range(8), range(1, 8)):
            patterns[tuple(quality.BAD if i in (a, b) else v for i, v in enumerate(clean))] += round(50 * times)
        model = quality.fit(dict(patterns), PRIORS)
        assert all((model.posterior(v) >= 0.5) == (quality.BAD not in v) for v in patterns)


def test_planted_junk_of_every_kind(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("bar", "len", "tor", "mis", "gal") for b in ("en", "us", "ick", "ot", "ara", "")]
    prose = lambda n=60: " ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(n))
    junk = [
        lambda: " ".join(rng.choice(words) + rng.choice((" #", " $$", "")) for _ in range(60)) + ".", lambda: prose().upper(), lambda: prose().replace(" ", "! ", 40),
        lambda: " ".join(str(rng.randrange(10**6)) if rng.random() < 0.5 else rng.choice(words) for _ in range(60)) + ".",
        lambda: prose(60) + " " + (line := prose(8)) + " " + line, lambda: "\n".join([prose(40), *[rng.choice(words)] * 9]), lambda: " ".join(prose(8).replace(" ", "") for _ in range(30)),
        lambda: ". ".join(rng.choice(words) for _ in range(60))]
    texts = [(i, prose()) for i in range(2000)] + [(10_000 + 100 * k + i, make()) for k, make in enumerate(junk) for i in range(25)]
    found = cases.rows_of(quality.judge(spark.createDataFrame(texts, "doc_id int, text string"))[0])
    assert all(found[i]["kept"] for i in range(2000))
    for k in range(len(junk)):
        assert sum(found[10_000 + 100 * k + i]["kept"] for i in range(25)) <= 2, quality.RULES[k].name


def test_columns_named_like_results_are_replaced(spark):
    df = spark.createDataFrame([(1, "one two", 7, 8)], "doc_id int, text string, n_words int, KEPT int")
    assert quality.judge(df)[0].columns == ["doc_id", "text", *quality.COUNTS, "base_failed", "quality", "kept"]
    assert quality.kept_rows(df).columns == df.columns


def test_odd_rows(spark):
    found = quality.judge(cases.odd(spark), "text", ["doc_id", "row.key"])[0]
    assert found.count() == len(cases.odd_rows()) and quality.judge(cases.empty(spark))[0].count() == 0
    for row, text in zip(sorted(found.collect(), key=str), sorted(cases.odd_rows(), key=str)):
        assert row["n_words"] >= 0 and (row["n_words"] >= 20 or not row["kept"])
    kept = quality.kept_rows(cases.odd(spark))
    assert kept.columns == cases.odd(spark).columns
    assert {r["doc_id"] for r in kept.collect()} <= {r[0] for r in cases.odd_rows()}
