"""Fast exact ids of the public byte-level BPE, with the tokenizers library.

A byte-level BPE with the usual splitting pattern never joins a character that
is not a space with a space after it, so a text can be cut before every run of
white space that follows one, and equal pieces have equal ids.  Pieces are
encoded by the library once and kept in a bounded table by worker.
"""

from __future__ import annotations

import os
import re
from struct import Struct

import numpy as np

_PIECE = re.compile(r"\s*\S+|\s+")
#: White space for Python's \s but not for the tokenizer.
_ODD = re.compile("[\x1c-\x1f]")
_SIGNS = ".,;:!?"
#: Pieces a worker keeps: at most so many, and of those it met first so many when there are more; the longest kept.
KEEP, KEEP_FIRST, LONGEST = 1_000_000, 600_000, 40
_PACK = [Struct(f"<{n}I").pack for n in range(LONGEST)]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level BPE writes each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _even(text: str) -> bool:
    """Whether one space or new line, and no other white space, is between any two words."""
    doubled = "  " in text or " \n" in text or "\n " in text or "\n\n" in text
    return not (doubled or text[0] in " \n" or text[-1] in " \n") and text.replace("\n", "").isprintable()


def _key(piece: str) -> str:
    if piece[0] == " " and piece[1:2] not in ("\n", "\t"):
        return piece[1:]
    return piece if piece[0] == "\n" else "\t" + piece


def _latin(word: str) -> bool:
    """Whether every version of Unicode has the letters of a word as letters."""
    return word.isascii() or max(word) < "\u0250"


class _Pieces(dict):
    """Ids of pieces met before, in the order in which they were met: frequent ones first.

    A key stands for itself after a space; a tab before it means no space, and
    a key with a new line in front is itself.
    """

    def __init__(self, word, ids_of, signs: dict[str, bytes]):
        self.word, self.ids_of, self.signs = word, ids_of, signs

    def __missing__(self, key: str) -> bytes:
        if key.isalpha():
            ids = self.word(key, True)
        elif key[-1:] in self.signs and key[:-1].isalpha() and _latin(key[:-1]):
            ids = self[key[:-1]] + self.signs[key[-1:]]
        else:
            first = key[:1]
            ids = self.ids_of(key[1:] if first == "\t" else key if first == "\n" else " " + key)
        if len(key) <= LONGEST:
            self[key] = ids
        return ids

    def shorten(self) -> None:
        """Only the pieces that were met first stay."""
        while len(self) > KEEP_FIRST:
            self.popitem()


class Encoder:
    """Texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.bpe, self.letters = self.model.model, _byte_letters()
        self.space = self.letters[32]
        self.signs = {s: self._in_full(s) for s in _SIGNS}
        self.line = self._in_full("\n")
        self.known = _Pieces(self._word, self._ids, self.signs)

    def _in_full(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, core: str, space: bool) -> bytes:
        """A run of letters by the model alone; in full where they are not Latin."""
        if not _latin(core):
            return self._in_full(" " + core if space else core)
        shown = core if core.isascii() else core.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.bpe.tokenize(self.space + shown if space else shown)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()

    def _ids(self, piece: str) -> bytes:
        """Letters by the model alone, anything else in full.

        The tokenizer's pattern always splits a new line, a run of letters after
        at most one space, and a sign from each other.
        """
        word, before, after = piece, b"", b""
        if word[:1] == "\n":
            word, before = word[1:], self.line
        if word[-1:] in self.signs:
            word, after = word[:-1], self.signs[word[-1]]
        space = word[:1] == " "
        core = word[1:] if space else word
        return before + self._word(core, space) + after if core.isalpha() and _latin(core) else self._in_full(piece)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as bytes; a null text is empty."""
        if not text:
            return b""
        known = self.known
        if len(known) > KEEP:
            known.shorten()
        if _even(text):
            return b"".join(map(known.__getitem__, ("\t" + text.replace("\n", " \n")).split(" ")))
        if _ODD.search(text):
            return self._in_full(text)
        return b"".join([known[_key(p)] for p in _PIECE.findall(text)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_texts(path: str, texts: list[str | None]) -> list[bytes]:
    """Ids of many texts."""
    return list(map(encoder(path).encode, texts))
