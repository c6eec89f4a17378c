"""License notices in texts, exact phrases and short notices with edits.

A notice of ``k`` allowed edits is split into ``k + 1`` pieces. Wherever the
notice stands with at most ``k`` edits, one piece stands unchanged, about as
far in as in the notice. So exact searches for the pieces find every
candidate, and only the stretch around each is matched with bounded errors.

Texts are searched as runs of words with single spaces between, a block of
texts at once: upper case and separators are replaced byte by byte (all of
them are ASCII, so bytes of other characters stay as they are).
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from spanloom.llm.frames import col_of

#: Phrases whose words count where they stand one after the other.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices by label.
NOTICES = {
    "mit": ("released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    "apache": ("licensed under the apache license version 2 0", "you may not use this file except in compliance with the license"),
    "gpl": ("licensed under the gnu general public license", "redistribute it and or modify it under the terms of the gnu general public license"),
    "lgpl": ("licensed under the gnu lesser general public license",),
    "agpl": ("licensed under the gnu affero general public license",),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "licensed under the bsd license"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose",),
    "mpl": ("subject to the terms of the mozilla public license",),
    "cc-by": ("licensed under cc by 4 0", "licensed under a creative commons attribution 4 0 international license"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"),
    "public-domain": ("this is free and unencumbered software released into the public domain",),
    "reserved": ("all rights reserved worldwide", "no part of this publication may be reproduced"),
}
#: One edit is allowed for so many characters, and at least one.
CHARS_PER_EDIT = 10
#: Bytes of texts that are searched at once; a longer text is a block of its own.
BLOCK = 1 << 22

_WORD = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes(b if b in _WORD else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

SPANS = "array<struct<label:string,notice:string,edits:int,first_word:bigint,last_word:bigint,start:bigint,end:bigint>>"
SCHEMA = f"n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans {SPANS}"


@dataclass(frozen=True)
class Notice:
    """A notice of words with single spaces, found with at most ``edits`` changed, missing or added characters."""

    label: str
    text: str
    edits: int
    pieces: tuple[tuple[int, str], ...] = field(init=False)

    def __post_init__(self):
        cuts = [len(self.text) * i // (self.edits + 1) for i in range(self.edits + 2)]
        object.__setattr__(self, "pieces", tuple((a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])))


def notices(texts: dict[str, tuple[str, ...]] = NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> list[Notice]:
    return [Notice(label, text, max(1, len(text) // chars_per_edit)) for label, own in texts.items() for text in own]


def least_edits(notice: str, window: str, anchored: bool = False) -> list[int]:
    """Fewest edits between the notice and a stretch of the window, for every end of the stretch from 0 on.

    The stretch may begin anywhere, or only at the window's begin if ``anchored``.
    Columns of the table of edits are kept as bits of their differences.
    """
    own: dict[str, int] = {}
    for i, c in enumerate(notice):
        own[c] = own.get(c, 0) | 1 << i
    all_, last = (1 << len(notice)) - 1, 1 << len(notice) - 1
    plus, minus, edits, found = all_, 0, len(notice), [len(notice)]
    for c in window:
        equal = own.get(c, 0)
        diagonal = (((equal & plus) + plus) ^ plus) | equal | minus
        up, down = minus | ~(diagonal | plus) & all_, plus & diagonal
        edits += bool(up & last) - bool(down & last)
        found.append(edits)
        up, down = up << 1 | anchored, down << 1
        plus, minus = (down | ~((equal | minus) | up)) & all_, up & (equal | minus)
    return found


@lru_cache(65_536)
def verified(notice: str, edits: int, window: str) -> tuple[int, int, int] | None:
    """Start, end and edits of the best match of a notice in a window; None if every match needs more edits.

    Of equally good matches that which ends first counts, with the longest
    stretch. Counting edits alone finds its place, where the pattern, which
    is slow on text that does not match, has to match.
    """
    counts = least_edits(notice, window)
    least = min(counts)
    if least > edits:
        return None
    end = counts.index(least)
    back = least_edits(notice[::-1], window[:end][::-1], anchored=True)
    start = end - max(i for i, n in enumerate(back) if n == least)
    return (start, end, least) if _pattern(notice, least).fullmatch(window, start, end) else None


@lru_cache(1024)
def _pattern(notice: str, edits: int) -> regex.Pattern:
    return regex.compile(f"(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}")


def _occurrences(data: bytes, part: bytes) -> Iterator[int]:
    at = data.find(part)
    while at >= 0:
        yield at
        at = data.find(part, at + 1)


class _Block:
    """Some texts as words: every text is a newline, a space, and its words with a space after each."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        joined = (b"\n".join(texts) + b"\n").translate(_TABLE)
        # All line ends are spaces by now; those between texts are put back.
        raw = np.frombuffer(joined, np.uint8).copy()
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        raw[ends] = 10
        self.raw_begins = ends - np.array([len(t) for t in texts])
        space = raw <= 32
        first = ~space & np.concatenate(([True], space[:-1]))
        word_at = np.flatnonzero(first)
        kept = ~space
        # A word keeps the space or text end after it.
        kept[1:] |= ~space[:-1]
        shown = np.where(space, 32, raw)
        kept_at = np.flatnonzero(kept)
        of_text = np.searchsorted(ends, word_at)
        self.n_words = np.bincount(of_text, minlength=len(texts))
        self.word_raw = word_at
        self.first_of_text = np.cumsum(self.n_words) - self.n_words
        # Before each text a newline and a space are put in.
        at = np.searchsorted(kept_at, self.raw_begins)
        self.data = np.insert(shown[kept_at], np.repeat(at, 2), np.tile(np.array([10, 32], np.uint8), len(texts))).tobytes()
        placed = np.searchsorted(kept_at, word_at)
        self.word_at = placed + 2 * (of_text + 1)
        self.text_at = at + 2 * np.arange(len(texts))
        self.text_end = np.append(self.text_at[1:], len(self.data))

    def text_of(self, at: int) -> int:
        return int(np.searchsorted(self.text_at, at, side="right")) - 1

    def word_of(self, at: int) -> int:
        """The word that holds a place, or begins right behind it."""
        word = int(np.searchsorted(self.word_at, at, side="right")) - 1
        return word + 1 if self.data[at] == 32 else word


def _search(texts: list[bytes], phrases: dict[str, str], wanted: list[Notice]) -> Iterator[tuple]:
    block = _Block(texts)
    data = block.data
    base: dict[int, list[tuple[int, str]]] = {}
    for phrase, label in phrases.items():
        for at in _occurrences(data, f" {phrase} ".encode()):
            base.setdefault(block.text_of(at), []).append((block.word_of(at + 1), label))
    found: dict[int, set[tuple[int, int, int, Notice]]] = {}
    for notice in wanted:
        for offset, piece in notice.pieces:
            before, behind = offset + notice.edits, len(notice.text) - offset - len(piece) + notice.edits
            part = piece.encode()
            for at in _occurrences(data, part):
                text = block.text_of(at)
                # A character has at most four bytes; one that is cut at the far edge is left out.
                left = data[max(at - 4 * before, int(block.text_at[text]) + 1):at].decode("utf-8", "ignore")[-before:]
                right = data[at + len(part):min(at + len(part) + 4 * behind, int(block.text_end[text]))].decode("utf-8", "ignore")[:behind]
                if hit := verified(notice.text, notice.edits, left + piece + right):
                    window, low = left + piece + right, at - len(left.encode())
                    found.setdefault(text, set()).add((low + len(window[:hit[0]].encode()), low + len(window[:hit[1]].encode()), hit[2], notice))
    for text, raw in enumerate(texts):
        own = base.get(text, [])
        first, begin = int(block.first_of_text[text]), int(block.raw_begins[text])
        spans = []
        for a, b, edits, notice in chosen(found.get(text, ())):
            start, last = block.word_of(a), block.word_of(b - 1) if data[b - 1] != 32 else block.word_of(b - 2)
            places = int(block.word_raw[start]) - begin, int(block.word_raw[last]) - begin
            stop = places[1] + int(block.word_at[last + 1] if last + 1 < len(block.word_at) and block.text_of(int(block.word_at[last + 1])) == text else block.text_end[text]) - int(block.word_at[last]) - 1
            code = lambda at: len(raw[:at].decode())  # noqa: B023, E731
            spans.append({"label": notice.label, "notice": notice.text, "edits": edits, "first_word": start - first, "last_word": last - first, "start": code(places[0]), "end": code(stop)})
        places = [w - first for w, _ in own]
        labels = {label for _, label in own}
        best = max([1 - s["edits"] / (len(s["notice"]) + 1) for s in spans], default=0.0)
        yield (int(block.n_words[text]), len(own), min(places, default=None), max(places, default=None), ",".join(sorted(labels)),
               ",".join(sorted(labels | {s["label"] for s in spans})), 1.0 if own else best, spans)


def chosen(matches) -> list[tuple[int, int, int, Notice]]:
    """Of matches that overlap, those with the fewest edits a character (then the longest, the first) stay; in order."""
    kept: list[tuple[int, int, int, Notice]] = []
    for m in sorted(matches, key=lambda m: (m[2] / len(m[3].text), -len(m[3].text), m[0], m[3].label)):
        # Those kept are apart, so only the neighbours can overlap.
        at = bisect(kept, m[0], key=lambda k: k[0])
        if (at == 0 or kept[at - 1][1] <= m[0]) and (at == len(kept) or m[1] <= kept[at][0]):
            kept.insert(at, m)
    return kept


def scan(df: DataFrame, id: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, wanted: list[Notice] | None = None) -> DataFrame:
    """``id``, counts of words and phrases, labels, a score and the spans of notices for every row.

    ``spans`` has label, notice, edits, first and last word, and start and end
    in code points of the text as it is. ``score`` is 1 with a phrase, else
    that of the best notice found, 0 without any. Null texts are empty: no words, no places,
    empty labels. Repeated rows and null or equal ids are rows of their own.
    Texts of any length are searched whole. Other columns are not read.
    """
    wanted = notices() if wanted is None else wanted
    kind = df.select(col_of(df, id)).schema[0].dataType
    own = df.select(col_of(df, id).alias("id"), col_of(df, text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            ends = np.cumsum([len(t) for t in texts]) // BLOCK
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    rows = list(zip(*_search(texts[a:b], phrases, wanted)))
                    yield pa.record_batch([batch.column(0).slice(a, b - a), *(pa.array(v, t) for v, t in zip(rows, _TYPES))], names=[id, *_NAMES])

    return own.mapInArrow(run, f"`{id.replace('`', '``')}` {kind.simpleString()}, {SCHEMA}")


_SPAN = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("edits", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
_TYPES = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), _SPAN]
