"""SentencePiece ids of whole texts, and texts from ids.

A merge-type vocabulary joins the adjacent pair of best score, leftmost first, until no
pair is a piece. The result is the one sequence of pieces in which every two neighbours,
merged again from their characters, come out as these two. So a text is encoded from left
to right by backtracking:

* an Aho-Corasick automaton of the reversed pieces, run over the reversed text, gives the
  longest piece that starts at each character;
* a piece is taken if it is compatible with the one before it; otherwise the next shorter
  piece at that place is tried;
* where none is left, the place is set in a bitfield of failed positions, which no later
  attempt enters again, and the piece before it is given up.

Each position fails once at most, so a text without blanks of any length takes time in
proportion to it. No piece holds a blank after another character, so runs of blanks with
the characters after them are encoded apart, each distinct one once per worker.

Defined cases: a null text is empty; an empty text has no ids; characters outside the
vocabulary become the pieces of their UTF-8 bytes; bytes that form no character are decoded
as U+FFFD each; U+2581 is a blank, as the library reads it; null ids decode to the empty
text; repeated rows stay; an empty table gives an empty one; all other columns, whatever
their names, are carried through.
"""

from __future__ import annotations

import codecs
import re
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import free_name, in_slices

#: The library's mark of a blank.
BLANK = "▁"
_RUN = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")


class _Cache(dict):
    """Key -> value, made when it is first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        self[key] = value = self.make(key)
        return value


class Pieces:
    """The vocabulary of a merge-type model file; one per Python worker."""

    def __init__(self, path: str, keep: int = 6_000_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in ids]
        self.names = [model.id_to_piece(i) for i in ids]
        self.number = {name: i for i, name in enumerate(self.names) if not special[i]}
        if any(BLANK in name.lstrip(BLANK) for name in self.number):
            raise ValueError("pieces with a blank after another character are not supported")
        self._score = {name: model.get_score(i) for name, i in self.number.items()}
        self._bytes = {int(self.names[i][3:5], 16): i for i in ids if model.is_byte(i)}
        self._automaton = ahocorasick.Automaton()
        for name in self.number:
            self._automaton.add_word(name[::-1], len(name))
        self._automaton.make_automaton()
        # the longest piece that is a proper prefix of a piece
        self._shorter = {name: next((name[:k] for k in range(len(name) - 1, 0, -1) if name[:k] in self.number), "") for name in self.number}
        self._fits = _Cache(lambda pair: self.merged(pair[0] + pair[1]) == [x for x in pair if x])
        # text of every id: bytes as they are, control ids nothing, the unknown id its surface
        self._surface = [
            b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else bytes([int(self.names[i][3:5], 16)]) if model.is_byte(i)
            else self.names[i].replace(BLANK, " ").encode() for i in ids
        ]
        self._leads = {i for i in ids if not special[i] and self.names[i].startswith(BLANK)}
        self._control = {i for i in ids if model.is_control(i)}
        self.keep = keep
        self._clear()

    def _clear(self) -> None:
        self._runs = _Cache(self._learn)
        self._held = 0

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text, by merging the best pair, leftmost first, while there is one."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self._score.get(a + b) for a, b in zip(parts, parts[1:])]
            best = max((s for s in scores if s is not None), default=None)
            if best is None:
                break
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _longest(self, text: str) -> list[int]:
        """Length of the longest piece that starts at each character; 0 where none does."""
        longest = [0] * len(text)
        last = len(text) - 1
        for end, length in self._automaton.iter(text[::-1]):
            if length > longest[last - end]:
                longest[last - end] = length
        return longest

    def _backtracked(self, text: str, longest: list[int], start: int, stop: int) -> list[str]:
        """Pieces of ``text[start:stop]``, whose characters are all pieces."""
        failed = bytearray(((stop - start) >> 3) + 1)
        taken = [""]
        at, piece = start, text[start : start + min(longest[start], stop - start)]
        while True:
            end = at + len(piece) - start
            if not failed[end >> 3] >> (end & 7) & 1 and self._fits[taken[-1], piece]:
                taken.append(piece)
                at = start + end
                if at == stop:
                    return taken[1:]
                piece = text[at : at + longest[at]]
            elif shorter := self._shorter[piece]:
                piece = shorter
            else:
                failed[(at - start) >> 3] |= 1 << ((at - start) & 7)
                piece = taken.pop()
                at -= len(piece)

    def encode_run(self, text: str) -> list[int]:
        """Ids of one run of characters."""
        longest, ids, at = self._longest(text), [], 0
        while at < len(text):
            if longest[at]:
                stop = at + 1
                while stop < len(text) and longest[stop]:
                    stop += 1
                ids += [self.number[x] for x in self._backtracked(text, longest, at, stop)]
                at = stop
            else:
                ids += [self._bytes[b] for b in text[at].encode()]
                at += 1
        return ids

    def _learn(self, run: str) -> bytes:
        self._held += len(run)
        return np.array(self.encode_run(run), np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The library's ids of ``text``, without begin or end ids."""
        if self._held > self.keep:
            self._clear()
        if len(self._fits) > self.keep // 4:
            self._fits.clear()
        runs = _RUN.findall(BLANK + text.replace(" ", BLANK)) if text else []
        return np.frombuffer(b"".join(map(self._runs.__getitem__, runs)), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The library's text of ``ids``: the blank that encoding put first goes."""
        ids = ids.tolist()
        parts = [b"".join(map(self._surface.__getitem__, ids))]
        if not self._control.isdisjoint(ids):  # bytes on both sides of a control id form no character
            parts = [b"".join(map(self._surface.__getitem__, g)) for stop, g in groupby(ids, self._control.__contains__) if not stop]
        first = next((i for i in ids if i not in self._control), None)
        if first in self._leads:
            parts[0] = parts[0][1:]
        return "".join(x.decode("utf-8", "thalweg-each-byte") for x in parts)


codecs.register_error("thalweg-each-byte", lambda error: ("�", error.start + 1))

_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The vocabulary at ``path`` of this worker process."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode(docs: DataFrame, model: str, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with the ids of column ``text`` (array<int>), and the name of that column.

    ``model`` is the file of the vocabulary, which every worker reads.
    """

    def ids(texts: pa.Array) -> pa.Array:
        own = pieces(model)
        each = [own.encode(x.as_py() or "") for x in texts]
        ends = np.cumsum([0, *map(len, each)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(each) if each else [], pa.int32()))

    name = free_name(docs, "piece_ids")
    return docs.withColumn(name, F.arrow_udf(in_slices(ids), "array<int>")(F.col(text).cast("string"))), name


def decode(coded: DataFrame, model: str, ids: str) -> tuple[DataFrame, str]:
    """``coded`` with the text of its column ``ids``, and the name of the new column."""

    def texts(lists: pa.Array) -> pa.Array:
        own = pieces(model)
        return pa.array([own.decode(x.values.to_numpy()) if x.is_valid else "" for x in lists], pa.string())

    name = free_name(coded, "decoded")
    return coded.withColumn(name, F.arrow_udf(in_slices(texts), "string")(F.col(ids))), name
