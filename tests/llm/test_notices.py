"""Fuzzy notices against plain dynamic programming."""

import random
import re

import cases
from spanloom.llm import notices
from spanloom.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def base(text):
    own, places, labels = words(text), [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        parts = phrase.split()
        at = [i for i in range(len(own)) if own[i:i + len(parts)] == parts]
        places += at
        labels |= {label} if at else set()
    return len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def least_edits(pattern, text):
    """Fewest edits of any stretch of ``text`` (Sellers)."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, p in enumerate(pattern, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_edits_by_bits_equal_the_table():
    rng = random.Random(8)
    for _ in range(400):
        a, b = ("".join(rng.choice("ab ") for _ in range(rng.randrange(1, n))) for n in (9, 14))
        counts = notices.least_edits(a, b)
        assert min(counts) == least_edits(a, b) and len(counts) == len(b) + 1
        whole = [list(range(len(a) + 1))]
        for j, c in enumerate(b, 1):
            row = [j]
            for i, p in enumerate(a, 1):
                row.append(min(row[-1] + 1, whole[-1][i] + 1, whole[-1][i - 1] + (p != c)))
            whole.append(row)
        assert notices.least_edits(a, b, anchored=True) == [r[-1] for r in whole]
        if hit := notices.verified(a, len(a), b):
            assert hit[2] == min(counts) and least_edits(a, b[hit[0]:hit[1]]) == hit[2]


def columns(r):
    return tuple(r[k] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels"))


def test_query_equals_plain_code(spark):
    found, wanted, fuzzy = cases.rows_of(QUERIES["op11_license_notices"](spark, cases.SF)), notices.notices(), 0
    for d, text in cases.documents():
        r = found[d]
        assert columns(r) == base(text)
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        if "licen" in text.lower() or "rights" in text.lower():
            near = {n.label for n in wanted if least_edits(n.text, " ".join(words(text))) <= n.edits}
            assert set(filter(None, r["labels"].split(","))) <= near | set(r["base_labels"].split(","))
            assert bool(r["labels"]) == bool(near or r["base_labels"])
            fuzzy += bool(near)
    assert fuzzy


def broken(rng, text, edits):
    for _ in range(edits):
        at, kind = rng.randrange(len(text)), rng.randrange(3)
        text = text[:at] + ("" if kind == 0 else rng.choice("aqz é日")) + text[at + (kind != 2):]
    return text


def test_edited_notices_are_found_with_their_edits(spark):
    rng, wanted, rows, want = random.Random(4), notices.notices(), [], {}
    for i in range(300):
        n = rng.choice(wanted)
        noise = [" ".join(rng.choice(("ein", "Zwei", "drei,", "日本", "é")) for _ in range(rng.randrange(12))) for _ in range(2)]
        text = noise[0] + " | " + broken(rng, n.text, rng.randrange(n.edits + 3)).upper() + " \n" + noise[1]
        shown = " ".join(words(text))
        rows.append((i, text))
        want[i] = {m.text: e for m in wanted if (e := least_edits(m.text, shown)) <= m.edits}
    found = cases.rows_of(notices.scan(spark.createDataFrame(rows, "doc_id bigint, text string")))
    for i, text in rows:
        spans = found[i]["spans"]
        assert all(want[i][s["notice"]] <= s["edits"] for s in spans)
        assert bool(spans) == bool(want[i])
        if want[i]:
            # The best of all is never displaced by another.
            least = min(e / len(t) for t, e in want[i].items())
            assert min(s["edits"] / len(s["notice"]) for s in spans) == least
        for s in spans:
            own = words(text)
            assert words(text[s["start"]:s["end"]]) == own[s["first_word"]:s["last_word"] + 1]
            assert text[s["start"]].translate(LOWER) == own[s["first_word"]][0]


def test_notices_that_follow_each_other_and_overlap(spark):
    text = "Released under the MIT License. Relaesed under the MIT Licence. Licensed under CC BY-NC 4.0, licensed under the GNU General Public License, version 3"
    rows = [(1, text), (2, "licensed under the mit license " * 20_000), (3, "x" + "released under the mit license"), (4, "日" * 40 + "released under the mit license" + "é" * 40)]
    found = cases.rows_of(notices.scan(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert [(s["label"], s["edits"]) for s in found[1]["spans"]] == [("mit", 0), ("mit", 3), ("cc-by-nc", 0), ("gpl", 0)]
    assert (found[1]["labels"], found[1]["base_labels"], found[1]["score"]) == ("cc-by-nc,gpl,mit", "gpl,mit", 1.0)
    assert found[2]["n_base"] == 20_000 and found[2]["last_word"] == 5 * 19_999 + 3
    assert [(s["label"], s["edits"], s["first_word"], s["last_word"]) for s in found[3]["spans"]] == [("mit", 0, 0, 4)]
    assert [(s["label"], s["edits"], s["start"], s["end"]) for s in found[4]["spans"]] == [("mit", 0, 0, 110)]


def test_odd_rows(spark):
    rows = notices.scan(cases.odd(spark)).collect()
    assert sorted(map(columns, rows), key=str) == sorted((base(r[1]) for r in cases.odd_rows()), key=str)
    assert notices.scan(cases.empty(spark)).count() == 0
    none = next(r for r in rows if r["doc_id"] == 0)
    assert (none["n_words"], none["first_word"], none["base_labels"], none["labels"], none["score"], none["spans"]) == (0, None, "", "", 0.0, [])


def test_small_blocks_give_the_same(spark, monkeypatch):
    texts = [t.encode() for _, t in cases.documents()][:60] + [b"", b" "]
    whole = list(notices._search(texts, notices.PHRASES, notices.notices()))
    assert whole == [next(notices._search([t], notices.PHRASES, notices.notices())) for t in texts]
