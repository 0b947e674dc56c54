"""Language identification by a bit-sliced Bloom filter of character n-grams.

A word's n-grams are taken with a space on each side.  A language's n-grams are
those that make up at least ``share`` of its n-grams of that length in all text that
teaches, so there are 1 / share of a length at most, whatever the corpus, and the
filter's size is bounded by the number of languages.

The filter is one array whose entries are bitmasks of languages: an n-gram sets its
languages' bits in ``hashes`` entries, and the AND of these entries returns all
languages that contain an n-gram, at the price of a false one now and then.  A
language whose bits fill the share f of the entries is returned falsely with
probability f ** hashes, so of c answers among n n-grams

    (c - n * f ** hashes) / (1 - f ** hashes)

are expected to be true.  The language with most of them is the prediction; its
part of all languages' is the score.

Case by case: text that is null or has no letter is ``und`` with score 0, as is all
text where nothing teaches; text whose n-grams no language has goes to the language
of most text that teaches, with score 1 / languages; ties go the same way, then by
name.  A null language or text or id doesn't teach; a null id is not held out.
Repeated rows count as often as they stand; an empty table gives no rows; other
columns are not read; a text is taken whole, however long.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.workspace import arrow_map, cut, slices


@dataclass(frozen=True)
class LanguageSpec:
    """lengths: of n-grams; share: of a language's n-grams of a length from which one is its own; hashes, entries_per_gram: of the filter; chunk: characters that a task takes at once; grams: different ones that a task holds."""

    lengths: tuple[int, ...] = (3, 4, 5)
    share: float = 3e-5
    hashes: int = 4
    entries_per_gram: int = 16
    chunk: int = 4 << 20
    grams: int = 1 << 20
    folds: int = 4
    held_out_fold: int = 2


_WORD = re.compile(r"[^\W\d_]+")
_U = np.uint64


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _letters(words: list[str]) -> list[str]:
    """The words without signs such as raised digits, which the pattern lets through."""
    return [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in words]


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (splitmix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def grams(words: list[str], lengths: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, number of the word, hash) of all n-grams of words of letters, a space on each side of a word."""
    codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    space = codes == 32
    owner = np.cumsum(space) - 1
    rolled, inner = _mix(codes + _U(1)), np.zeros(len(codes), bool)
    for n in range(2, max(lengths) + 1):
        size = max(0, len(codes) - n + 1)
        rolled = _mix(rolled[:size] * _U(0x9E3779B97F4A7C15) + codes[n - 1 :][:size])
        inner = inner[:size] | (space[n - 2 :][:size] if n > 2 else space[:size] & space[1:][:size])
        if n in lengths:
            at = np.flatnonzero(~inner)
            yield n, owner[at], rolled[at]


class LanguageFilter:
    """Languages and the masks of their n-grams; masks are rows of 64-bit words, or of one narrower number for few languages."""

    def __init__(self, languages: list[str], language: np.ndarray, hashes: np.ndarray, spec: LanguageSpec):
        """n-gram hashes[i] belongs to languages[language[i]]; languages of most text come first."""
        self.languages, self.spec = languages, spec
        kind = next((t for t in (np.uint8, np.uint16, np.uint32) if len(languages) <= np.dtype(t).itemsize * 8), np.uint64)
        self.width = np.dtype(kind).itemsize * 8
        size = 1 << max(6, int(len(np.unique(hashes)) * spec.entries_per_gram - 1).bit_length())
        self.masks = np.zeros((size, max(1, -(-len(languages) // self.width))), kind)
        for at in self._entries(hashes):
            np.bitwise_or.at(self.masks, (at, language // self.width), (_U(1) << (language % self.width).astype(np.uint64)).astype(kind))
        self.false = np.array([self._bit(self.masks, i).mean() for i in range(len(languages))]) ** spec.hashes

    def _entries(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        step = _mix(hashes) | _U(1)
        for k in range(self.spec.hashes):
            yield ((hashes + _U(k) * step) & _U(len(self.masks) - 1)).astype(np.int64)

    def _bit(self, masks: np.ndarray, i: int) -> np.ndarray:
        return (masks[:, i // self.width] >> masks.dtype.type(i % self.width)) & masks.dtype.type(1) != 0

    def containing(self, hashes: np.ndarray) -> np.ndarray:
        """Masks of all languages that contain each n-gram, a few false ones among them."""
        found = None
        for at in self._entries(hashes):
            found = self.masks[at] if found is None else found & self.masks[at]
        return found

    def popcounts(self, words: list[str]) -> np.ndarray:
        """A row a word: its n-grams, then each language's answers among them."""
        out = np.zeros((len(words), 1 + len(self.languages)))
        for _, owner, hashes in grams(words, self.spec.lengths):
            masks = self.containing(hashes)
            out[:, 0] += np.bincount(owner, minlength=len(words))[: len(words)]
            for i in range(len(self.languages)):
                out[:, 1 + i] += np.bincount(owner[self._bit(masks, i)], minlength=len(words))[: len(words)]
        return out

    def decide(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language, score) of each row of texts' sums of popcounts."""
        true = np.maximum(0.0, (counts[:, 1:] - counts[:, :1] * self.false) / np.maximum(1e-9, 1 - self.false))
        best, total = true.argmax(axis=1), true.sum(axis=1)
        top = true[np.arange(len(true)), best]
        return best, np.where(total > 0, top / np.where(total > 0, total, 1.0), 1.0 / len(self.languages))


def _counts(texts: DataFrame, spec: LanguageSpec) -> DataFrame:
    """(lang, length, gram, n) of texts(lang, text); under a null gram all of a length, and under length 0 the words."""

    def rows(held: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for lang, of in held.items():
            for length, (gram, n) in of.items():
                cols = {"lang": pa.array([lang] * (len(gram) + 1), pa.string()), "length": pa.array(np.full(len(gram) + 1, length, np.int32))}
                cols |= {"gram": pa.array([*gram.view(np.int64).tolist(), None], pa.int64()), "n": pa.array(np.append(n[: len(gram)], n.sum()).astype(np.int64))}
                yield pa.RecordBatch.from_pydict(cols)

    def add(held, lang: str, texts_: list[str]) -> int:
        words = Counter()
        for text in texts_:
            words.update(words_of(text))
        often = np.fromiter(words.values(), np.int64, len(words))
        of, size = held.setdefault(lang, {}), 0
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for length, owner, hashes in grams(_letters(list(words)), spec.lengths):
            gram, n = of.get(length, none)
            gram, where = np.unique(np.append(gram, hashes), return_inverse=True)
            of[length] = gram, np.bincount(where, np.append(n, often[owner]), len(gram)).astype(np.int64)
            size += len(gram)
        zero = of.get(0, none)
        of[0] = zero[0], np.append(zero[1], often.sum())
        return size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, size = {}, {}, 0
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                waiting.setdefault(lang, []).append(text)
                size += len(text)
            if size >= spec.chunk:
                if sum(add(held, *of) for of in waiting.items()) >= spec.grams:
                    yield from rows(held)
                    held = {}
                waiting, size = {}, 0
        for of in waiting.items():
            add(held, *of)
        yield from rows(held)

    seen = arrow_map(texts, run, "lang string, length int, gram long, n long")
    return seen.groupBy("lang", "length", "gram").agg(F.sum("n").alias("n"))


def learn(texts: DataFrame, spec: LanguageSpec = LanguageSpec()) -> LanguageFilter:
    """The filter of texts(lang, text); rows with a null don't teach.

    All text is counted in tasks and a shuffle; what reaches the driver is each
    language's n-grams, len(lengths) / share a language at most.
    """
    counted = cut(_counts(texts.select("lang", "text").filter("lang is not null and text is not null"), spec))
    all_ = counted.filter("gram is null").select("lang", "length", F.col("n").alias("total"))
    sizes = {r.lang: r.total for r in all_.filter("length = 0").collect()}  # one row a language
    languages = sorted((x for x in sizes if sizes[x]), key=lambda x: (-sizes[x], x))
    own = counted.filter("gram is not null").join(F.broadcast(all_), ["lang", "length"]).filter(F.col("n") >= spec.share * F.col("total"))
    found = own.select("lang", "gram").toArrow()
    number = {x: i for i, x in enumerate(languages)}
    language = np.array([number[x] for x in found.column("lang").to_pylist()], np.int64)
    return LanguageFilter(languages, language, found.column("gram").to_numpy().astype(np.int64).view(np.uint64), spec)


def held_out(doc_id: Column, spec: LanguageSpec = LanguageSpec()) -> Column:
    """Whether a document is in the fold that never teaches; null for a null id."""
    return F.crc32(doc_id.cast("string")) % spec.folds == spec.held_out_fold


def identify(docs: DataFrame, known: LanguageFilter) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of docs(doc_id, text), in the order and number of its rows."""
    sent = docs.sparkSession.sparkContext.broadcast(known)
    spec = known.spec

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageFilter = sent.value
        names = pa.array([*model.languages, "und"], pa.string())
        for batch in slices(batches):
            table: dict[str, int] = {}
            numbers, ends = [], [0]
            for text in batch.column(2).to_pylist():
                if text is not None:
                    numbers += [table.setdefault(w, len(table)) for w in words_of(text)]
                ends.append(len(numbers))
            words = _letters(list(table))
            said = np.array(numbers, np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            some = np.bincount(row, np.array([bool(w) for w in words], float)[said], batch.num_rows) > 0
            pick, score = np.full(batch.num_rows, len(model.languages)), np.zeros(batch.num_rows)
            if model.languages and words:
                own = model.popcounts(words)
                sums = np.stack([np.bincount(row, own[said, i], batch.num_rows) for i in range(own.shape[1])], axis=1)
                best, share = model.decide(sums)
                pick[some], score[some] = best[some], share[some]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names.take(pa.array(pick)), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    fold = F.coalesce(held_out(F.col("doc_id"), spec), F.lit(False)).alias("held_out")
    return arrow_map(docs.select("doc_id", fold, "text"), run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame, spec: LanguageSpec = LanguageSpec()) -> DataFrame:
    """Predictions for all of docs(doc_id, text, lang), learned from those outside the held-out fold."""
    return identify(docs, learn(docs.filter(~held_out(F.col("doc_id"), spec)), spec))
