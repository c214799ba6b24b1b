"""Exact token ids of whole texts, with the pieces between safe boundaries encoded once and kept.

Both vocabularies used here split a text at its blanks before any merge, so a text's ids are its pieces' ids in a
row wherever a cut at a blank can't change how the blanks themselves are grouped. Texts in which it could (three
blanks in a row, two at the end, separators that only some libraries count as blanks, the vocabulary's special
strings) are handed to the library whole. Results equal encoding each text whole; tests compare the two.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np

#: Pieces kept of late, and as many of those before them; bounds a worker's memory.
MOST_KEPT = 500_000
#: Longer pieces are encoded but not kept.
LONGEST_KEPT = 64

_ODD_SEPARATORS = re.compile("[\x1c-\x1f]")
_BLANKS_THAT_GROUP = re.compile(r"\s\s\s|\s\s\Z")
_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
#: The end of a line and the beginning of the next: the line break is an id of its own, what follows has no blank before it.
_JOINED = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?)\n([A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?)")


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies (fixed by their format)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Pieces(dict):
    """Ids, as little-endian unsigned 32-bit bytes, by piece; a missing piece is encoded on first use."""

    def __init__(self, library, lead: str, words: bool, bare: Pieces | None = None, most: int = MOST_KEPT):
        super().__init__()
        self.library, self.lead, self.words, self.most = library, lead, words, most
        self.alphabet = _byte_alphabet()
        self.before: dict[str, bytes] = {}
        self.bare = self if bare is None else bare
        self.line = self.whole("\n")
        self.marks = {mark: self._plain(mark) for mark in ".,"}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        # Of ASCII only letters, full stops and commas come here, which stand for themselves, and the blank before them.
        mapped = text.replace(" ", self.alphabet[32]) if text.isascii() else "".join([self.alphabet[b] for b in text.encode()])
        return struct.pack(f"<{len(ids)}I", *ids) if (ids := [t.id for t in self.library.model.tokenize(mapped)]) else b""

    def __missing__(self, piece: str) -> bytes:
        encoded = self.before.get(piece)
        if encoded is None:
            if not self.words and (joined := _JOINED.fullmatch(piece)):
                return self[joined[1]] + self.line + self.bare[joined[2]]
            if simple := _SIMPLE.fullmatch(piece):
                encoded = self[simple[1]] + self.marks[simple[2]] if simple[2] else self._plain(piece.lower() if self.words else self.lead + piece)
            else:
                encoded = self.whole(self.lead + piece)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.before = dict(self)
                self.clear()
            self[piece] = encoded
        return encoded


class WordEncoder:
    """For vocabularies that drop blanks: pieces are what stands between blanks."""

    def __init__(self, path: str):
        self.pieces = Pieces(_library(path), "", True, most=MOST_KEPT * 16 // 10)
        self.special = [t.content for t in self.pieces.library.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> bytes:
        if _ODD_SEPARATORS.search(text) or any(s in text for s in self.special):
            return self.pieces.whole(text)
        return b"".join(map(self.pieces.__getitem__, text.split()))


class ByteEncoder:
    """For vocabularies that keep blanks: a piece takes along the space before it."""

    def __init__(self, path: str, most: int = MOST_KEPT):
        library = _library(path)
        self.first = Pieces(library, "", False, most=most)
        self.later = Pieces(library, " ", False, self.first, most)
        self.special = [t.content for t in self.first.library.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> bytes:
        if _ODD_SEPARATORS.search(text) or _BLANKS_THAT_GROUP.search(text) or any(s in text for s in self.special):
            return self.first.whole(text)
        head, *rest = text.split(" ")
        return (self.first[head] if head else b"") + b"".join(map(self.later.__getitem__, rest))


_ENCODERS: dict[tuple, object] = {}


def encoder(kind: type, path: str, *bounds: int):
    """The worker's own encoder of this kind, file and bounds."""
    key = (kind, path, *bounds)
    if key not in _ENCODERS:
        _ENCODERS[key] = kind(path, *bounds)
    return _ENCODERS[key]
