"""Fast whole-text encoding with the ``tokenizers`` library, one instance per Python worker.

Both public vocabularies encode a text pre-token by pre-token, so a text's ids are the ids of its space-separated
units laid end to end.  Units repeat heavily; each worker remembers the ids of units and of pre-tokens in two bounded
dictionaries, and asks the library's model only for pre-tokens it has not seen.  Texts for which cutting at single
spaces and line feeds is not provably the same (runs of white space, white space other than those two, the string of an
added token anywhere) are encoded whole by the library, as are units with characters outside Basic/Extended Latin.

Ids are those of the library as it loads the vocabulary: the string of a special token in a text becomes that token.
With ``special_as_text`` it is ordinary text.

The memory of a worker is bounded by ``UNIT_CAP`` and ``PIECE_CAP`` entries; a full dictionary is emptied, which costs
time, never results.
"""

from __future__ import annotations

import gc
import zlib
from array import array
from functools import lru_cache

import numpy as np
import regex

#: Entries that a worker remembers at most.
UNIT_CAP = 500_000
PIECE_CAP = 400_000

#: Punctuation that often closes a word; such a tail is one pre-token of its own.
TAIL = ".,:;!?%*$#&|)\"-"

#: The published pre-token patterns of the two vocabularies, without the white-space branches that a
#: unit cannot reach.
BYTE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class _Memo(dict):
    """A dictionary that computes missing entries and forgets all when full."""

    def __init__(self, compute, cap: int):
        super().__init__()
        self.compute, self.cap = compute, cap

    def __missing__(self, key):
        if len(self) >= self.cap:
            self.clear()
        self[key] = value = self.compute(key)
        return value


class Encoder:
    """``encode(text)`` gives the ids as a numpy array of ``<u2`` or ``<u4``, by the vocabulary's size."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        added = [t for t in self.tok.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.added = [t.content.lower() for t in added]
        self.added_heads = sorted({h for t in added for h in (t.content[:1].lower(), t.content[:1].upper())})
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 0xFFFF else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.model = self.tok.model
        self.words = self.tok.normalizer is not None  # lower case, white space dropped
        self.alphabet = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet())})
        self.pieces_of = regex.compile(WORD_PIECES if self.words else BYTE_PIECES).findall
        self.pieces = _Memo(self.piece, PIECE_CAP)
        self.inner = _Memo(self._inner, UNIT_CAP)
        self.first = self.inner if self.words else _Memo(self._unit, UNIT_CAP // 4)
        self.feed = b"" if self.words else self._library("\n")

    def _library(self, text: str) -> bytes:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()

    def piece(self, piece: str) -> bytes:
        """The ids' bytes of one pre-token."""
        if piece.isascii() and piece.isprintable():  # only the leading space is written otherwise
            shown = piece.replace(" ", "\u0120")
        else:
            shown = piece.encode().decode("latin-1").translate(self.alphabet)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _unit(self, unit: str, lead: str = "") -> bytes:
        """A unit without white space, after ``lead``."""
        if not unit or not (unit.isascii() or max(unit) < "\u0250"):
            return self._library(lead + unit)
        if self.words:
            unit = unit.lower()
        if (word := unit.rstrip(TAIL)).isalpha():
            got = self.pieces[lead + word]
            return got + self.pieces[unit[len(word) :]] if len(word) < len(unit) else got
        return b"".join(map(self.pieces.__getitem__, self.pieces_of(lead + unit)))

    def _inner(self, unit: str) -> bytes:
        return self._unit(unit, "" if self.words else " ")

    def raw(self, text: str | None) -> bytes:
        """The ids' bytes."""
        if not text:
            return b""
        if any(head in text for head in self.added_heads):
            low = text.lower()
            if any(token in low for token in self.added):
                return self._library(text)
        words = text.split()
        gaps = text.count(" ") + text.count("\n")
        if len(words) != gaps + 1 or len("".join(words)) != len(text) - gaps:  # other than single spaces and line feeds
            return self._library(text)
        if self.words:
            return b"".join(map(self.inner.__getitem__, words))
        out = []
        for line in text.split("\n"):
            head, *tail = line.split(" ")
            out.append(self.first[head] + b"".join(map(self.inner.__getitem__, tail)))
        return self.feed.join(out)

    def forget(self, most: int = 120_000) -> None:
        """Empties the memory if it holds more entries than ``most``."""
        if len(self.inner) + len(self.pieces) > most:
            for memo in (self.inner, self.first, self.pieces):
                memo.clear()

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.raw(text), self.dtype)


@lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """This worker's encoder; kept between batches and tasks."""
    gc.set_threshold(100_000, 50, 1000)  # many short-lived tokens, no cycles
    return Encoder(path, special_as_text)


def crc_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
