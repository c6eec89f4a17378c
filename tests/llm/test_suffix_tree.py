"""Suffix tree scores: counts and base by plain code, the tree by a slow walk, and gain over single tokens."""

import math
import zlib
from collections import Counter, defaultdict

import cases
import numpy as np

from spanloom.llm import suffix_tree as tree
from spanloom.llm.queries import QUERIES


def test_base_equals_plain_code(spark):
    docs = cases.documents()
    counts, total = Counter(), 0
    for d, text in docs:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            words = text.encode().lower().split() + [None]
            counts.update(words)
            total += len(words)
    found = cases.rows_of(QUERIES["op1_lm_scoring"](spark, cases.SF))
    for d, text in docs:
        words, row = text.encode().lower().split() + [None], found[d]
        assert (row["held_out"], row["n_tokens"], row["train_tokens"]) == (zlib.crc32(str(d).encode()) % 7 == 2, len(words), total)
        assert row["n_known"] == sum(counts[w] > 0 for w in words)
        want = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in words)
        assert math.isclose(row["base_score"], want, rel_tol=1e-9) and row["score"] < 0


def slow(trained, text, scored, least, gain):
    """The same tree, grown and walked with dictionaries."""
    seen = defaultdict(Counter)
    for x in trained:
        padded = bytes([tree.END]) * tree.DEPTH + x
        for i in range(tree.DEPTH, len(padded)):
            for k in range(tree.DEPTH + 1):
                seen[padded[i - k:i]][padded[i]] += 1
    kept = {b""}
    for context, after in seen.items():
        total, of = sum(after.values()), seen[context[1:]]
        told = sum(n * math.log(n / total * sum(of.values()) / of[s]) for s, n in after.items())
        if context and total >= least and told >= gain:
            kept |= {context[k:] for k in range(len(context))}

    def p(context, symbol):
        if context not in kept:
            return p(context[1:], symbol)
        below = p(context[1:], symbol) if context else 1 / 256
        after = seen[context]
        return (after[symbol] + len(after) * below) / (sum(after.values()) + len(after))

    padded = bytes([tree.END]) * tree.DEPTH + scored
    return sum(math.log10(p(padded[i - tree.DEPTH:i], padded[i])) for i in range(tree.DEPTH, len(padded)))


def test_tree_equals_a_slow_walk(spark):
    texts = [t for _, t in cases.documents()[:12]]
    grown = tree.grow(tree.counts(spark.createDataFrame([(t,) for t in texts[:10]], "text string")).filter("code is not null").select("code", "n"))
    scorer = tree._Scorer(grown)
    parts = [tree.spelled(tree.words_of(t.encode())) for t in texts]
    sums = scorer.sums(parts)
    for i in (0, 10, 11):
        assert math.isclose(sums[i], slow(parts[:10], None, parts[i], tree.LEAST_COUNT, tree.GAIN), rel_tol=1e-9)
    assert np.allclose(scorer.sums(parts), sums)


def test_probabilities_add_up(spark):
    grown = tree.grow(tree.counts(spark.createDataFrame([("abc abd abc",), ("xyz abc",)], "text string")).filter("code is not null").select("code", "n"))
    before = int(tree.codes([b"abc ab" + bytes([255])])[5]) & ((1 << 40) - 1)
    every = np.array([(s << 40) | before for s in range(256)], np.uint64)
    assert math.isclose((10 ** grown.log10(every)).sum(), 1, rel_tol=1e-9)


def test_held_out_texts_are_likelier_than_by_single_tokens(spark):
    rows = QUERIES["op1_lm_scoring"](spark, cases.SF.replace("0.001", "0.1")).filter("held_out").groupBy().sum("base_score", "score").first()
    assert rows["sum(score)"] > rows["sum(base_score)"]


def test_odd_rows(spark):
    found = tree.score(cases.odd(spark)).collect()
    assert len(found) == len(cases.odd_rows()) and all(r["score"] < 0 and r["n_tokens"] > 0 for r in found)
    assert tree.score(cases.empty(spark)).count() == 0
    only = tree.score(spark.createDataFrame([(2, "a b")], "doc_id int, text string"), held_out=None).first()
    assert only["train_tokens"] in (0, 3)


def test_a_context_is_kept_however_large_the_corpus(spark):
    rare = np.unique(tree.codes([b"qzx " + bytes([tree.END])] * 8), return_counts=True)
    common = tree.codes([tree.spelled([b"hello", b"world"])])
    rows = [(int(c), int(n)) for c, n in zip(*rare)] + [(int(c), 10**9) for c in common]
    grown = tree.grow(spark.createDataFrame(rows, "code bigint, n bigint"))
    assert grown.log10(tree.codes([b"qzx " + bytes([tree.END])])[1:2])[0] > math.log10(0.5)


def test_a_tree_in_pieces_scores_like_a_whole_one(spark, monkeypatch):
    docs = spark.createDataFrame(cases.documents()[:60] + [(None, None), (7, "")], "doc_id bigint, text string")
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"])
    whole = sorted(tree.score(docs).collect(), key=key)
    monkeypatch.setattr(tree, "PIECE", 3_000)
    grown = tree.states(tree.counts(docs.select("text")).filter("code is not null").select("code", "n"))
    assert 3 <= len(tree.pieces(grown, tree.PIECE)) < 40
    cut = sorted(tree.score(docs).collect(), key=key)
    assert [r[:6] for r in cut] == [r[:6] for r in whole] and len(whole) == 62
    assert np.allclose([r["score"] for r in cut], [r["score"] for r in whole], rtol=1e-9)
