"""Toxicity by bags of subword embeddings.

A word is the mean of the embeddings of itself and its character n-grams, a
passage the mean of its words, and a linear softmax tells the classes of
passages apart. Embeddings and softmax are trained together. A misspelt or
inflected word that was never seen still shares n-grams with seen ones.

A text is as toxic as its worst passage, so a few words don't drown in a long
text; a word said again within a passage's length counts once, so that mild
words don't add up by repetition: training starts on means of whole texts and goes on with the worst
passage of each. The classifier is fitted on a bounded sample of labelled
texts; all texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.frames import col_of

BUCKETS, DIMENSIONS, GRAMS = 1 << 19, 8, (3, 4, 5)
#: Words of a passage.
PASSAGE = 32
#: Labelled texts of each class that are learned from at most, those whose ids have the lowest hashes.
TRAINING_TEXTS = 2_500
WARM_STEPS, STEPS, RATE = 25, 35, 0.15
#: Code points that are hashed at once.
CHUNK = 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of all words, and how many each word has (itself first, then its n-grams with the word's ends)."""
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    blank = np.zeros(len(points), bool)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths
    blank[0] = True
    blank[starts + lengths] = True
    place = np.arange(len(points)) - np.repeat(np.append(0, starts), np.append(1, lengths + 1))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(64, _M, np.uint64), dtype=np.uint64)
        whole = np.add.reduceat(points * powers[place % 64] * ~blank, starts)
        rows, owner = [_bucket(whole, 1)], [np.arange(len(words))]
        word = np.repeat(np.append(0, np.arange(len(words))), np.append(1, lengths + 1))
        blanks = np.cumsum(blank)
        for n in GRAMS:
            size = len(points) - n + 1
            if size <= 0:
                continue
            inner = blanks[n - 2:n - 2 + size] == blanks[:size]
            value = np.zeros(size, np.uint64)
            for k in range(n):
                value = value * _M + points[k:k + size]
            at = np.flatnonzero(inner)
            rows.append(_bucket(value[at], n))
            owner.append(word[at + 1])
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(rows)[order], np.bincount(owners, minlength=len(words))


def repeated(words: np.ndarray) -> np.ndarray:
    """Which words (as numbers) came already among the ``PASSAGE`` - 1 before."""
    order = np.argsort(words, kind="stable")
    again = np.zeros(len(words), bool)
    again[order[1:]] = (words[order[1:]] == words[order[:-1]]) & (np.diff(order) < PASSAGE)
    return again


def _bucket(value: np.ndarray, kind: int) -> np.ndarray:
    mixed = (value ^ (value >> np.uint64(29))) * _M + np.uint64(kind)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """What scoring needs: each embedding row's part of the logit, and how the worst passage becomes a score."""

    weight: np.ndarray
    slope: float
    shift: float

    def word_logits(self, words: list[str]) -> np.ndarray:
        out, i = [], 0
        while i < len(words):
            size, j = 0, i
            while j < len(words) and size < CHUNK:
                size += len(words[j]) + 1
                j += 1
            rows, counts = subwords(words[i:j])
            out.append(np.add.reduceat(self.weight[rows], np.cumsum(counts) - counts) / counts)
            i = j
        return np.concatenate(out) if out else np.empty(0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """One score per text; hashing is shared by neighbouring texts."""
        result, i = np.empty(len(texts)), 0
        while i < len(texts):
            size, j, words, counts = 0, i, [], []
            while j < len(texts) and size < CHUNK:
                own = words_of(texts[j])
                words += own
                counts.append(len(own))
                size += len(texts[j] or "")
                j += 1
            numbers: dict[str, int] = {}
            keys = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
            logits, at = self.word_logits(words), 0
            # Each text has words of its own here: a repetition doesn't reach into the next text.
            logits[repeated(keys + np.repeat(np.arange(len(counts)), counts) * (len(numbers) + 1))] = 0
            for k, n in enumerate(counts):
                result[i + k] = worst(logits[at:at + n]) if n else np.nan
                at += n
            i = j
        scores = 1 / (1 + np.exp(-np.clip(self.slope * result + self.shift, -60, 60)))
        return np.where(np.isnan(result), 0.0, scores)


def worst(logits: np.ndarray) -> float:
    """The largest mean over ``PASSAGE`` neighbouring words (over all when there are fewer; 0 without words)."""
    if len(logits) <= PASSAGE:
        return float(logits.mean()) if len(logits) else 0.0
    total = np.concatenate(([0.0], np.cumsum(logits)))
    return float((total[PASSAGE:] - total[:-PASSAGE]).max() / PASSAGE)


def train(texts: list[str | None], labels: np.ndarray, seed: int = 11) -> Model:
    """Fit embeddings and softmax by gradient steps with momentum on all texts at once, then a slope and shift on a held-out fifth.

    With one class only, or no texts, the score is constant.
    """
    labels = np.asarray(labels, float)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 4.0 if labels.any() else -4.0)
    split = [words_of(t) for t in texts]
    used = np.array([bool(s) for s in split])
    split, labels = [s for s in split if s], labels[used]
    number: dict[str, int] = {}
    docs = [np.fromiter((number.setdefault(w, len(number)) for w in s), np.int64, len(s)) for s in split]
    rows, counts = subwords(list(number))
    first = np.cumsum(counts) - counts
    order = np.argsort(rows, kind="stable")
    seen, seen_at = np.unique(rows[order], return_index=True)
    word_of_row = np.repeat(np.arange(len(number)), counts)[order]
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    soft, bias = rng.normal(0, 0.1, (2, DIMENSIONS)).astype(np.float32), np.zeros(2, np.float32)
    state = [[np.zeros_like(x), 0.0] for x in (emb[seen], soft, bias)]
    held = np.arange(len(docs)) % 5 == 4
    weight = np.where(labels == 1, 0.5 / max(1, labels[~held].sum()), 0.5 / max(1, (1 - labels[~held]).sum())) * ~held
    sizes = np.array([len(d) for d in docs])
    flat, starts = np.concatenate(docs), np.cumsum(sizes) - sizes
    new = ~np.concatenate([repeated(d) for d in docs])
    owner = np.repeat(np.arange(len(docs)), sizes)
    inverse = (1.0 / counts).astype(np.float32)[:, None]
    for step in range(1, WARM_STEPS + STEPS + 1):
        vectors = _gather(emb, rows, first, counts) * inverse
        if step <= WARM_STEPS:
            at, text_of, share = np.flatnonzero(new), owner[new], 1.0 / sizes[owner[new]]
        else:
            logits = (vectors @ (soft[1] - soft[0]))[flat] * new
            picks = [_worst_at(logits[a:a + n]) for a, n in zip(starts, sizes)]
            at = np.concatenate([np.arange(a + s, a + e) for a, (s, e) in zip(starts, picks)])
            at = at[new[at]]
            spans = np.array([e - s for s, e in picks])
            text_of, share = owner[at], 1.0 / spans[owner[at]]
        token = flat[at]
        share = share.astype(np.float32)
        bag = np.stack([np.bincount(text_of, share * vectors[token, d], minlength=len(docs)) for d in range(DIMENSIONS)], axis=1).astype(np.float32)
        z = bag @ soft.T + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - np.stack([1 - labels, labels], axis=1)) * weight[:, None]
        grad_bag = (error @ soft).astype(np.float32)
        per_word = np.stack([np.bincount(token, share * grad_bag[text_of, d], minlength=len(number)) for d in range(DIMENSIONS)], axis=1).astype(np.float32) * inverse
        grad_emb = _gather(per_word, word_of_row, seen_at, np.diff(np.append(seen_at, len(rows))))
        # A row's step is its pull against the pull that its texts would have in random directions: rows that many
        # texts push the same way move far, however small their shares; rows of a single text hardly.
        noise = np.bincount(token, (share * weight[text_of]) ** 2, minlength=len(number)).astype(np.float32)[:, None] * inverse ** 2
        spread = np.sqrt(_gather(noise, word_of_row, seen_at, np.diff(np.append(seen_at, len(rows))))) * float(np.abs(soft).mean())
        grad_emb = grad_emb / (spread + 1e-12)
        grads = (grad_emb, (error.T @ bag).astype(np.float32), error.sum(axis=0).astype(np.float32))
        for i, grad in enumerate(grads):
            m, v = state[i]
            m += 0.1 * (grad - m)
            state[i][1] = v = max(0.9 * v, float(np.abs(m).max()))
            change = RATE * m / (v + 1e-12)
            if i == 0:
                emb[seen] -= change
            elif i == 1:
                soft = soft - change
            else:
                bias = bias - change
    raw = Model((emb @ (soft[1] - soft[0])).astype(np.float32) * np.isin(np.arange(BUCKETS), seen), 1.0, 0.0)
    values = np.array([worst(raw.word_logits(split[i]) * ~repeated(docs[i])) for i in np.flatnonzero(held)])
    return Model(raw.weight, *_calibrated(values, labels[held]))


def _gather(table: np.ndarray, index: np.ndarray, first: np.ndarray, counts: np.ndarray, block: int = 40_000) -> np.ndarray:
    """Sums of rows of ``table`` over consecutive stretches of ``index``."""
    out = np.empty((len(first), table.shape[1]), np.float32)
    for a in range(0, len(first), block):
        b = min(len(first), a + block)
        start, stop = first[a], first[b - 1] + counts[b - 1]
        out[a:b] = np.add.reduceat(table[index[start:stop]], first[a:b] - start, axis=0)
    return out


def _worst_at(logits: np.ndarray) -> tuple[int, int]:
    if len(logits) <= PASSAGE:
        return 0, len(logits)
    total = np.concatenate(([0.0], np.cumsum(logits)))
    at = int(np.argmax(total[PASSAGE:] - total[:-PASSAGE]))
    return at, at + PASSAGE


def _calibrated(values: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift that put the score 0.7 where fewest held-out texts fall on the wrong side."""
    if len(set(labels.tolist())) < 2:
        return 1.0, 0.0
    order = np.argsort(values)
    v, y = values[order], labels[order]
    # Clean texts are the more frequent: a wrongly accused one counts twice.
    wrong = np.concatenate(([0.0], np.cumsum(y))) + 2 * ((1 - y).sum() - np.concatenate(([0.0], np.cumsum(1 - y))))
    best = np.flatnonzero(wrong == wrong.min())
    k = int(best[len(best) // 2])
    # Forms never seen score lower than those learned: nearer to the clean side.
    low, high = v[max(k - 1, 0)], v[min(k, len(v) - 1)]
    cut = low + (high - low) / 3
    spread = max(1e-6, float(np.median(values[labels == 1]) - np.median(values[labels == 0])))
    slope = 8 / spread
    return slope, float(np.log(0.7 / 0.3) - slope * cut)


def is_held_out(id: Column) -> Column:
    """Rows whose labels are never learned from: the remainder of the id's CRC by 3 is 1."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit(""))) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", texts: int = TRAINING_TEXTS) -> Model:
    """Train on at most ``texts`` labelled texts of each class that are not held out. Labels other than 0 and 1 are ignored; of several, the highest counts."""
    known = labels.select(col_of(labels, id).alias("id"), col_of(labels, label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    known = known.filter(~is_held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    picks = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(texts) for y in (0, 1)]
    sample = docs.select(col_of(docs, id).alias("id"), col_of(docs, text).alias("text")).join(F.broadcast(picks[0].union(picks[1])), "id")
    one_each = Window.partitionBy("id").orderBy(F.xxhash64("text"))
    rows = sample.withColumn("n", F.row_number().over(one_each)).filter("n = 1").orderBy(F.xxhash64("id"), "id").select("text", "y").toPandas()
    return train(list(rows["text"]), rows["y"].to_numpy())


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out`` and ``score`` of every row.

    Null and empty texts, and those without words, have the score 0. Repeated
    rows and equal or null ids are scored row by row; other columns are not
    read. An empty table gives an empty result.
    """
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(list(texts)))

    return docs.select(col_of(docs, id).alias("doc_id"), is_held_out(col_of(docs, id)).alias("held_out"),
                       F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)(col_of(docs, text)).alias("score"))
