"""Token ids of a lower-case word BPE, in numpy batches.

The tokenizers library is exact but spends most of its time on normalising and
splitting. Texts made of plain Latin characters need neither: their normal form is
their lower case, so they are split here and each distinct piece goes to the library's
BPE model once per worker. Every other text goes to the library whole. Both ways give
the ids of ``Tokenizer.encode``.
"""

from __future__ import annotations

import os
import re

import numpy as np

# The vocabulary's own split pattern, written out for the characters of SAFE.
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ſ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_NUMBER}{_LETTER}]+")
# Characters that normalisation leaves alone and lower-casing maps one to one.
_SAFE = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ſ]*")


def _byte_alphabet() -> dict[int, int]:
    """Byte-level vocabularies spell bytes as printable characters: the others follow from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(hidden)}


_BYTES = _byte_alphabet()


class _Pieces(dict):
    """Piece -> number; a piece not met before is encoded once."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, piece: str) -> int:
        self[piece] = k = self.learn(piece)
        return k


class WordBpe:
    """Encodes batches of texts; one per Python worker."""

    def __init__(self, path: str, keep: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        self._tokenize = self.tokenizer.model.tokenize
        self.keep = keep
        self._clear()

    def _clear(self) -> None:
        self._known = _Pieces(self._learn)
        self._ids = np.zeros(1 << 16, np.uint32)
        self._start = np.zeros(1 << 14, np.int64)
        self._size = np.zeros(1 << 14, np.int32)
        self._used = 0

    def _learn(self, piece: str) -> int:
        spelt = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES)
        ids = [x.id for x in self._tokenize(spelt)]
        k = len(self._known)
        if k == len(self._start):
            self._start = np.concatenate([self._start, np.zeros_like(self._start)])
            self._size = np.concatenate([self._size, np.zeros_like(self._size)])
        while self._used + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._ids[self._used : self._used + len(ids)] = ids
        self._start[k], self._size[k] = self._used, len(ids)
        self._used += len(ids)
        return k

    def encode(self, text: str) -> np.ndarray:
        """The ids of ``text`` as unsigned 32-bit integers."""
        if not _SAFE.fullmatch(text) or "<|" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(self._known) > self.keep:
            self._clear()
        pieces = _PIECE.findall(text.lower())
        at = np.fromiter(map(self._known.__getitem__, pieces), np.int64, len(pieces))
        size = self._size[at]
        total = int(size.sum())
        ends = np.cumsum(size)
        # position of every id: the start of its piece plus its rank in the piece
        return self._ids[np.repeat(self._start[at] - (ends - size), size) + np.arange(total)]


_ENCODERS: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    """The encoder of this worker process for the vocabulary at ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordBpe(path)
    return _ENCODERS[path]

