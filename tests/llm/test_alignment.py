"""Token alignment against comparing every two tokens."""

import hashlib
from collections import Counter

import cases
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from spanloom.llm import alignment
from spanloom.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "one", "a  b", "a\n\nb", "\ta b", " lead", "trail ", "x\ny z\nw", "don't <|endoftext|> <s> <unk> <0x41>", "a ▁ b", "▁", "É́ 日本 \U0001f600 ok", "e\x00f", "½ ² ª µ",
         "12,000.5!! x", "line\r\nend", "tab\tin word​", "the the the the"]


def tokens():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = alignment.Encoder(A).visible
    back = {chr(s): i for i, s in shown.items()}

    def cut(text):
        if not text:
            return [], []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        own_a = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in ids_a]
        own_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in ids_b]
        want = (" " + text).encode()
        return (own_a, own_b) if b"".join(x for _, x in own_a) == want == b"".join(x for _, x in own_b) else ([], [])

    return cut


def placed(own):
    at, out = 0, []
    for i, data in own:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def brute(texts):
    """Columns of every text, and documents and links of every pair."""
    cut, rows, links, docs = tokens(), [], Counter(), Counter()
    for text in texts:
        a, b = map(placed, cut(text))
        own, first = [], 0
        for i, s, e in a:
            while first < len(b) and b[first][2] <= s:
                first += 1
            j = first
            while j < len(b) and b[j][1] < e:
                own.append((i, b[j][0]))
                j += 1
        links.update(own)
        docs.update(set(own))
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, before = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in side if before < e <= end) for side in (a, b))) if len(ends) < 400 else None
            before = end
        rows.append((len(a), len(b), len(ends), own, ";".join(groups) if len(ends) < 400 else None))
    top = Counter()
    for (_, b), n in links.items():
        top[b] = max(top[b], n)
    return [(a, b, g, len(own), sum(links[p] == top[p[1]] for p in own), sum(links[p] for p in own), text) for a, b, g, own, text in rows], links, docs


def check(row, want):
    assert (row["n_a"], row["n_b"], row["n_groups"], row["n_links"], row["n_best"], row["count_sum"]) == want[:6]
    if want[6] is not None:
        assert row["groups_sha256"] == (hashlib.sha256(want[6].encode()).hexdigest() if want[0] else "")


def test_query_equals_all_pairs_of_tokens(spark):
    found, docs = cases.rows_of(QUERIES["op12_token_alignment"](spark, cases.SF)), cases.documents()
    want, _, _ = brute([t for _, t in docs])
    assert len(found) == len(docs)
    for (d, _), w in zip(docs, want):
        check(found[d], w)


def test_unusual_texts_and_small_containers(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "n_a int, body string, pair string").repartition(3)
    want, links, docs = brute(TEXTS)
    found = cases.rows_of(alignment.align(df, A, B, id="n_a", text="body").toDF("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), "id")
    for i, w in enumerate(want):
        check(found[i], w)
    assert want[11][0] == want[12][0] == 0 and want[13][0] > 0
    indexed = alignment.index(df, A, B, "n_a", "body").cache()
    counted = {(r["a"], r["b"]): (r["n_docs"], r["n_links"]) for r in alignment.pairs(indexed, B).collect()}
    assert counted == {p: (docs[p], n) for p, n in links.items()}


def test_planes_of_every_density():
    rng = np.random.default_rng(2)
    entries = []
    for pair, n, top in ((5, 3, 1), (6, 5000, 1), (7, 60_000, 9), (8, 4096, 3), (9, 4095, 2), (10, 1, 1000), (1 << 30, 200, 40)):
        for doc in rng.choice(alignment.CONTAINER_DOCS, n, replace=False).tolist():
            entries += [pair << 16 | doc] * int(rng.integers(1, top + 1))
    want = Counter(entries)
    keys = np.array(entries)
    rng.shuffle(keys)
    pairs, planes = alignment.planes_of(keys)
    column = alignment.Planes(planes)
    plane, place = column.entries(np.ones(len(column.row), bool))
    found = Counter()
    for p, d in zip(plane.tolist(), place.tolist()):
        found[int(pairs[column.row[p]]) << 16 | d] += 1 << int(column.bit[p])
    assert found == want
    docs, links = column.counts()
    assert dict(zip(pairs.tolist(), docs.tolist())) == Counter(k >> 16 for k in want)
    assert dict(zip(pairs.tolist(), links.tolist())) == Counter(k >> 16 for k in entries)
    part = alignment.Planes(pa.concat_arrays([planes.slice(2, 3)]))
    assert part.counts()[1].tolist() == links[2:5].tolist()


def test_odd_rows(spark):
    rows = alignment.align(cases.odd(spark), A, B).collect()
    want, _, _ = brute([r[1] for r in cases.odd_rows()])
    assert sorted((r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) for r in rows) == sorted(w[:6] for w in want)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in cases.odd_rows())
    assert alignment.align(cases.empty(spark), A, B).count() == 0
