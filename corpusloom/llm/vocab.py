"""Encoding whole texts with public tokenizers, each distinct piece of text once.

Texts are cut only where the tokenizer can never join what stands on both
sides, so the ids are those the library gives the whole text.  The ids of a
piece are kept as little-endian bytes; a text's ids are a join of those.
"""

from __future__ import annotations

import ctypes
import itertools
import os
import re

import numpy as np

#: Pieces that a worker keeps from task to task.
KEPT = 50_000
WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"

#: Letters that no normalisation but lower-casing changes, then ASCII punctuation; perhaps a line break and the same again.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)([!-/:-@\\[-`{-~]*)(?:\\n([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\\[-`{-~]*))?")
_RARE_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BEFORE_WORD = re.compile(r"(?= \S)")


def _visible_bytes() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_VISIBLE = _visible_bytes()


#: The same for whole characters that stand in plain pieces.
_VISIBLE_PLAIN = {c: "".join(_VISIBLE[b] for b in chr(c).encode()) for c in [0x0A, 0x20, *range(0xC0, 0x100)]}


def _visible(text: str) -> str:
    """A plain piece in the byte-level alphabet."""
    return text.translate(_VISIBLE_PLAIN)


def vocabulary_path(name: str) -> str:
    """Where the installed package of public vocabularies keeps this file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Known(dict):
    """Ids of pieces of text; a missing one is learnt when it is first asked for."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, piece):
        found = self[piece] = self.learn(piece)
        return found

    def shrink(self, keep: int) -> None:
        """Keep what was learnt first: common pieces are met early."""
        first = list(itertools.islice(self.items(), keep))
        self.clear()
        self.update(first)


class Encoder:
    """Ids of texts under one tokenizers file.

    white_space "dropped": the tokenizer drops white space, so texts are cut at
    ASCII white space.  "joined": a word takes one space before it, so texts are
    cut before a space that a word follows.  Plain pieces (letters, then marks)
    go straight to the tokenizer's BPE model, pre-token by pre-token; all others
    take its whole course.  max_entries bounds what is remembered.

    The strings of special tokens in a text are those tokens, as the library has
    it when it adds none itself; what stands between them is encoded as texts of
    its own, which is how the library takes them out too.
    """

    def __init__(self, path: str, white_space: str, max_entries: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bpe = self.tokenizer.model.tokenize
        self.id_bytes = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.special = {t.content: k.to_bytes(4, "little") for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.dropped = white_space == "dropped"
        self.max_entries = max_entries
        self.marks = _Known(self._direct)
        self.known = _Known(self._learn_word if self.dropped else self._learn_spaced)
        self.whole = _Known(self._course)  # pieces that stand at the start of a text, or in one with runs of white space

    def _direct(self, token: str) -> bytes:
        """Ids of one pre-token."""
        ids = self.id_bytes
        return b"".join([ids[t.id] for t in self.bpe(_visible(token))])

    def _course(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_word(self, piece: bytes) -> bytes:
        text = piece.decode()
        m = _PLAIN.fullmatch(text)
        if not m or m[3] is not None:
            return self._course(text)
        letters, rest = m[1].lower(), m[2]
        if not letters:
            return self.marks[rest] if len(self.marks) < 20_000 else self._direct(rest)
        key = letters.encode()
        found = self._direct(letters) if key == piece else self.known[key]
        return found + self.marks[rest] if rest else found

    def _learn_spaced(self, piece: str) -> bytes:
        """Ids of a space and the piece."""
        if piece.isascii() and piece.isalpha():
            ids = self.id_bytes
            return b"".join([ids[t.id] for t in self.bpe("\u0120" + piece)])
        m = _PLAIN.fullmatch(piece)
        if not m or not m[1]:
            return self._course(" " + piece)
        letters, rest, letters2, rest2 = m.groups()
        found = self.known[letters] if rest or letters2 is not None else self._direct(" " + letters)
        if rest:
            found += self.marks[rest]
        if letters2 is not None:
            found += self.marks["\n"] + self._direct(letters2) + (self.marks[rest2] if rest2 else b"")
        return found

    def _encode_one(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return b"".join([self.special.get(x) or self._encode_plain(x) for x in self.at_special.split(text)])
        return self._encode_plain(text)

    def _encode_plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if self.dropped:
            return b"".join(map(self.known.__getitem__, text.encode().split()))
        if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or _RARE_SPACE.search(text):
            return b"".join(map(self.whole.__getitem__, _BEFORE_WORD.split(text)))
        first, *rest = text.split(" ")
        return self.whole[first] + b"".join(map(self.known.__getitem__, rest))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for held in (self.known, self.whole, self.marks):
            if len(held) > self.max_entries:
                held.shrink(KEPT)
        return [self._encode_one(x) for x in texts]

    def forget(self) -> None:
        """Give back most of what was learnt, so that idle workers hold little more than the vocabulary."""
        for held in (self.known, self.whole):
            held.shrink(KEPT)
        trim()


def trim() -> None:
    """Hand freed memory back to the system where the C library can."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, white_space: str, max_entries: int) -> Encoder:
    """One a worker process; a worker serves many tasks."""
    if (path, white_space) not in _encoders:
        _encoders[path, white_space] = Encoder(path, white_space, max_entries)
    return _encoders[path, white_space]
