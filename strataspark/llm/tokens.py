"""Memoised encoding with the byte-level tokenizer, cut where its pre-tokens cannot join."""

from __future__ import annotations

import os

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread for each Python worker

MEMO_BYTES = 100_000_000  # of the entries of one generation, with some 150 bytes that each takes besides its text
BYTE_MEMO_BYTES = 180_000_000  # the same of the byte-level encoder, whose tasks hold little else
MEMO_ENTRY = 150
MEMO_LONGEST = 100  # characters of a piece that is remembered
# Fixed value: the pre-token pattern of the byte-level vocabulary.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from 256 on, in order."""
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class _Unsafe(Exception):
    """The piece touches white space on its left, so it cannot be encoded by itself."""


class Memo(dict):
    """What ``make`` gave for each piece, bounded in bytes.

    When it is full it becomes the old generation, from which pieces come back as they are asked for; so it
    follows the texts, where a table that keeps whoever came first would serve ever fewer of them.
    """

    def __init__(self, make, part: int = 1, whole: int | None = None):
        super().__init__()
        self.make = make
        self.old: dict = {}
        self.size = (whole or MEMO_BYTES) // part
        self.room = self.size

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = self.make(piece)
        if len(piece) <= MEMO_LONGEST:
            size = len(piece) + MEMO_ENTRY
            if self.room < size:
                self.old.clear()  # before the copy is made, so that no more than two generations are held
                self.old = dict(self)
                self.clear()
                self.room = self.size
            self.room -= size
            self[piece] = found
        return found


class ByteEncoder:
    """Ids of whole texts, as the tokenizers library gives them for a byte-level vocabulary.

    A text is cut before each space that stands between two other characters:
    no pre-token crosses such a place, so each piece is encoded by the library
    once and its ids are remembered. Texts with runs of white space are cut by
    the pre-token pattern instead.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pre = regex.compile(PRE_TOKENS)
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(byte_letters()))
        self.pieces = Memo(self._piece, whole=BYTE_MEMO_BYTES)
        self.words = Memo(self._library, 4)
        self.marks = {c: self._library(c) for c in ".,"}

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters_only(self, text: str) -> bytes:
        """A space and letters are one pre-token, so the library's model is asked without its pre-tokenizer."""
        found = self.model.tokenize(text.encode().decode("latin-1").translate(self.letters))
        return b"".join([t.id.to_bytes(4, "little") for t in found])

    def _piece(self, piece: str) -> bytes:
        """What follows one space."""
        if not piece or piece[0].isspace():
            raise _Unsafe
        if piece.isalpha():
            return self._letters_only(f" {piece}")
        if piece[-1] in ".," and piece[:-1].isalpha():  # letters and the mark after them are pre-tokens of their own
            return self.pieces[piece[:-1]] + self.marks[piece[-1]]
        return self._library(f" {piece}")

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            head = self.words[first] if first else b""
            return head + b"".join(map(self.pieces.__getitem__, rest))
        except _Unsafe:
            return b"".join(map(self.words.__getitem__, self.pre.findall(text)))

    def encode(self, text: str | None) -> bytes:
        """Ids as bytes, four each; null is the empty text."""
        text = text or ""
        if self.special_at is None or not self.special_at.search(text):
            return self._plain(text)
        return b"".join(
            int(self.special[part]).to_bytes(4, "little") if part in self.special else self._plain(part) for part in self.special_at.split(text)
        )


_encoders: dict[str, ByteEncoder] = {}


def byte_encoder(path: str | None) -> ByteEncoder:
    """The encoder of this Python process; tasks that share a worker share what it remembers."""
    path = path or default_path("byte_bpe_50k.json")
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]
