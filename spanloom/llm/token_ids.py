"""Token ids of texts by a tokenizer file, with ids of known pieces kept at hand.

Byte-pair merges never cross the pieces a pre-tokenizer makes, so a text's ids
are its pieces' ids in order, and a piece seen before needs no second encoding.
Texts are cut at spaces and line ends only where that provably agrees with the
pre-tokenizer of the file; every other text goes through the tokenizer whole.
New pieces are cut further as the file's pre-tokenizer would, and the file's
model merges each part.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import regex
import tokenizers

#: Pieces, and parts of pieces, that are kept at most, about 200 bytes each; then pieces that came once are forgotten, and all parts.
KEPT_PIECES, KEPT_PARTS = 800_000, 200_000
#: Latin letters in their composed forms, digits, marks and single blanks: no normalisation but lower case applies.
_PLAIN = re.compile("[\n \x21-\x7e¡-¬®-ÿ]*")
#: Marks the first word of a text, which has no space before it; no plain text has this character.
_FIRST = "\r"
#: Pre-tokenizer patterns of the two kinds of files; fixed values of the formats.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_BYTES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _visible() -> dict[int, int]:
    """The character that stands for each byte in byte-level files: itself if printable, else the next from 256 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return {b: b if b in kept else next(other) for b in range(256)}


class _Numbers(dict):
    """Numbers pieces as they come; ``new`` has those that came since it was emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class Encoder:
    """Encodes texts with the tokenizer of a file, without special tokens added."""

    def __init__(self, path: str, kept_pieces: int = KEPT_PIECES, kept_parts: int = KEPT_PARTS):
        self.kept_pieces, self.kept_parts = kept_pieces, kept_parts
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t["content"] for t in spec["added_tokens"]]
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        #: Byte-level files keep the space before a word with it; files with word ends are in lower case and drop it.
        self.byte_level = len(steps) == 1 and steps[0]["type"] == "ByteLevel" and steps[0]["use_regex"] and spec["normalizer"] is None
        self.word_ends = spec["model"].get("end_of_word_suffix") == "</w>" and steps[0].get("pattern") == {"Regex": _WORDS.pattern}
        self.visible = _visible()
        self.parts: dict[str, list[int]] = {}
        self._clear()

    def _clear(self) -> None:
        self.known = _Numbers()
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.begin, self.size, self.uses = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def _forget(self) -> None:
        """Keep the pieces that came again since the last time, unless they are most of them; then the memory starts anew."""
        names, again = list(self.known), np.flatnonzero(self.uses[:len(self.known)] > 1)
        if 2 * len(again) > self.kept_pieces:
            self._clear()
            return
        begin, sizes = self.begin[again], self.size[again]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        self._clear()
        self.known.update(zip(map(names.__getitem__, again.tolist()), range(len(again))))
        self._add(ids, sizes, 0)

    def _add(self, ids: np.ndarray | list[int], sizes: np.ndarray, first: int) -> None:
        """Append the ids of the pieces numbered from ``first``."""
        while len(self.known) > len(self.begin):
            self.begin, self.size, self.uses = (np.concatenate((x, np.zeros_like(x))) for x in (self.begin, self.size, self.uses))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, self.flat))
        self.flat[self.used:self.used + len(ids)] = ids
        self.size[first:len(self.known)] = sizes
        self.begin[first:len(self.known)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)

    def _cut(self, piece: str) -> tuple[str, ...] | list[str]:
        """The parts of a piece, as the file's pre-tokenizer cuts it; letters with a mark behind them, most pieces, need no pattern."""
        lead = ""
        if not self.byte_level:
            piece = piece.lower()
        elif piece[0] == _FIRST:
            piece = piece[1:]
        elif piece[0] != "\n":
            lead = " "
        if piece.isalpha():
            return (lead + piece,)
        if piece[-1:] in (".", ",") and piece[:-1].isalpha():
            return lead + piece[:-1], piece[-1]
        return _BYTES.findall(lead + piece) if self.byte_level else _WORDS.findall(piece)

    def ids_of(self, piece: str) -> list[int]:
        ids: list[int] = []
        for part in self._cut(piece):
            own = self.parts.get(part)
            if own is None:
                if len(self.parts) >= self.kept_parts:
                    self.parts.clear()
                shown = part if part.isalnum() and part.isascii() else part.encode().decode("latin-1").translate(self.visible)
                own = self.parts[part] = [t.id for t in self.model.tokenize(shown)]
            ids += own
        return ids

    def _learn(self) -> None:
        """Encode the new pieces and keep their ids."""
        new = self.known.new
        if not new:
            return
        ids, sizes = [], np.empty(len(new), np.int64)
        for i, piece in enumerate(new):
            before = len(ids)
            ids += self.ids_of(piece)
            sizes[i] = len(ids) - before
        self._add(ids, sizes, len(self.known) - len(new))
        new.clear()

    def _pieces(self, text: str) -> list[str] | None:
        """Pieces whose ids in order are the text's; None if the text has to be encoded whole."""
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return None
        if self.word_ends:
            return text.split()
        if not self.byte_level or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n"):
            return None
        # A line end is a piece before its word; every other word but the first has a space before it.
        words = text.replace("\n", " \n").split(" ")
        words[0] = _FIRST + words[0]
        return words

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text as unsigned 32-bit numbers; none for null or empty."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after the other as unsigned 32-bit numbers, and how many each text has."""
        if len(self.known) > self.kept_pieces:
            self._forget()
        at: list[int] = []
        counts, whole = [], {}
        for i, text in enumerate(texts):
            pieces = self._pieces(text) if text else ()
            if pieces is None:
                whole[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                pieces = ()
            before = len(at)
            at.extend(map(self.known.__getitem__, pieces))
            counts.append(len(at) - before)
        self._learn()
        at, counts = np.array(at, np.int64), np.array(counts, np.int64)
        self.uses[:len(self.known)] += np.bincount(at, minlength=len(self.known))
        begin, sizes = self.begin[at], self.size[at]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        stops = np.concatenate(([0], ends))[np.cumsum(counts)]
        own = np.diff(stops, prepend=0)
        if whole:
            parts = np.split(ids, stops[:-1])
            for i, x in whole.items():
                parts[i], own[i] = x, len(x)
            ids = np.concatenate(parts)
        return ids, own


def groups(texts: Sequence[str | None], chars: int = 1 << 21) -> Iterator[slice]:
    """Runs of texts of about so many characters; a longer text is a run of its own."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        own = len(text or "")
        if i > start and total + own > chars:
            yield slice(start, i)
            start, total = i, 0
        total += own
    if start < len(texts):
        yield slice(start, len(texts))


def encoder(path: str, kept_pieces: int = KEPT_PIECES, kept_parts: int = KEPT_PARTS) -> Encoder:
    """The encoder of a file, one per process and size of its memory.

    Functions travel to workers by value and would bring empty module globals
    along; the tokenizer library's module is the same for all tasks of a worker.
    """
    kept = tokenizers.__dict__.setdefault("_encoders_by_path", {})
    key = path, kept_pieces, kept_parts
    if key not in kept:
        kept[key] = Encoder(*key)
    return kept[key]
