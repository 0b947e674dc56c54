"""Tokens of texts in Python workers, the same as `text.tokens` gives in the JVM at a fraction of its time."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusloom.functions import patterns as P

_SYMBOLS = P.TOKEN.rsplit("[", 1)[1][:-1]
#: Capitals among the symbols and what they become; letters A-Z are lower-cased beforehand.
_LOWER = [(c.encode(), c.lower().encode()) for c in _SYMBOLS if c.lower() != c]


def _by_lead(symbols: list[bytes]) -> bytes:
    """A pattern of these symbols, grouped by all bytes but the last, so that few branches are tried at a byte that begins none."""
    heads: dict[bytes, list[bytes]] = {}
    for x in symbols:
        heads.setdefault(x[:-1], []).append(re.escape(x[-1:]))
    leads = b"".join(sorted({re.escape(x[:1]) for x in symbols}))
    return b"(?=[" + leads + b"])(?:" + b"|".join(re.escape(head) + b"[" + b"".join(last) + b"]" for head, last in heads.items()) + b")"


_TOKEN = re.compile(b"[a-z]++|[0-9]++(?:\\.[0-9]+)?|[" + b"".join(re.escape(c.encode()) for c in _SYMBOLS if c.isascii()) + b"]|" + _by_lead([c.encode() for c in _SYMBOLS if not c.isascii()]))


def tokens(text: bytes | None) -> list[bytes]:
    """Tokens of a text in UTF-8; a LaTeX command's letters are a word without more ado, as its backslash is in no token."""
    if not text:
        return []
    text = text.lower()
    for capital, small in () if text.isascii() else _LOWER:
        text = text.replace(capital, small)
    return _TOKEN.findall(text)


def token_lists(column: pa.Array) -> Iterator[list[bytes]]:
    """Tokens of each row of a column of texts or of lists of tokens."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        for row in column.cast(pa.list_(pa.binary())).to_pylist():
            yield row or []
    else:
        for at in range(0, len(column), 256):
            for text in column[at : at + 256].cast(pa.binary()).to_pylist():
                yield tokens(text)


def postings(column: pa.Array, most: int = 256) -> Iterator[tuple[int, np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
    """(first row, row, term, frequency, tokens of each row) of `most` rows of token_lists at a time; rows ascend."""
    for at in range(0, len(column), most):
        counts = [Counter(x) for x in token_lists(column[at : at + most])]
        n = np.array([len(c) for c in counts])
        dl = np.array([c.total() for c in counts])
        yield at, np.repeat(np.arange(len(n)), n), [t for c in counts for t in c], np.array([x for c in counts for x in c.values()], np.int64), dl


def _wider(pattern: str) -> str:
    """A pattern for RE2 that matches wherever Java matches this one: no looking around, and white space as Java has it.

    A boundary beside a letter, digit or `_` stays: what Java takes for no part of a word is none to RE2 either.
    """
    pattern = re.sub(r"\(\?<?[!=][^()]*\)", "", pattern)
    out, inside, at = [], False, 0
    while at < len(pattern):
        x = pattern[at : at + 2] if pattern[at] == "\\" else pattern[at]
        inside = True if x == "[" else False if x == "]" else inside
        out.append(x if x != r"\s" else r"\s\x0b" if inside else r"[\s\x0b]")
        at += len(x)
    return "".join(out)


#: Texts that none of these matches hold no instruction and no personal data; RE2 reads all alternatives in one pass.
SUSPECT = ["(?i)" + "|".join(f"(?:{_wider(p)})" for p, _, _ in P.INJECTION), "|".join("(?:" + _wider(p.replace(r"\b", "")) + ")" for _, p in P.PII)]


def suspect(column: pa.Array) -> pa.Array:
    """Whether a text may hold an instruction or personal data: never false where it does."""
    found = None
    for pattern in SUSPECT:
        one = pc.match_substring_regex(column, pattern)
        found = one if found is None else pc.or_(found, one)
    return found
