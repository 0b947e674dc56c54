"""Phrase collocations by level-wise counting with hashed buckets (PCY / DHP) and Apriori pruning.

Pass n reads the texts once and does two things: it counts the n-word sequences
that can still be frequent, exactly, and it counts the sequences of n + 1 words in
hashed buckets.  A sequence of n + 1 words is counted in the next pass only if

* its bucket has reached ``min_count`` (a bucket's count is never below that of any
  sequence in it), and
* its first and its last n words were frequent (Apriori), as the bitmap of the
  exactly counted sequences says.

Both bitmaps have ``2 ** bits`` bits, whatever the corpus, and are broadcast; what
they let through wrongly is removed by the exact counts.  Bucket counters stop at
255, which loses nothing as long as ``min_count`` is below; they are 2 ** bits bytes
a task.  With far more different sequences than buckets most buckets become
frequent and the pruning is left to Apriori, so ``bits`` should follow the corpus.

Every part of a frequent sequence is frequent too, so the exact tables hold all
counts that scores need.  Words of more than a ten-thousandth of all words are at
most 10,000, and are joined by broadcast; a rarer word begins few candidates, so
the join by key has no hot word.

Case by case: a null text is empty, a null language is ``und``; repeated rows count
as often as they stand; an empty table or one without frequent phrases gives no
rows; other columns are not read; a text is taken whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.llm.workspace import arrow_map, cut, file_system, fresh_dir, slices


@dataclass(frozen=True)
class PhraseSpec:
    """min_count: of a candidate (255 at most); max_words: of a phrase; share: percent of a phrase's count at which a longer one replaces it; top: phrases of a language; bits: log2 of the buckets of a level; chunk: bytes of text that a task encodes at once."""

    min_count: int = 10
    max_words: int = 3
    share: int = 50
    top: int = 2_000
    bits: int = 26
    chunk: int = 4 << 20


_BLOCK = 1 << 16
_BREAK = b"\xff"  # in no UTF-8 text
_TABLE = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (splitmix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Encoded:
    """Texts of one language as numbers of their words; number 0 stands between pieces."""

    def __init__(self, lang: str, texts: list[bytes]):
        self.lang = lang
        tokens = (b" " + _BREAK + b" ").join(texts).lower().translate(_TABLE).replace(_BREAK, b" " + _BREAK + b" ").split()
        table: dict[bytes, int] = {_BREAK: 0}
        self.ids = np.fromiter((table.setdefault(w, len(table)) for w in tokens), np.int64, len(tokens))
        self.words = list(table)
        seed = xxhash.xxh64_intdigest(lang.encode())
        own = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.words), np.uint64, len(self.words))
        self._word = _mix(own)[self.ids]
        self._grams = [_mix(self._word ^ _U(seed))]
        self._whole = [self.ids != 0]

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each place on."""
        while len(self._grams) < n:
            k = len(self._grams)
            self._grams.append(_mix(self._grams[-1][: max(0, len(self.ids) - k)] * _U(0x9E3779B97F4A7C15) + self._word[k:]))
        return self._grams[n - 1]

    def whole(self, n: int) -> np.ndarray:
        """Whether the n words from each place on lie in one piece."""
        while len(self._whole) < n:
            k = len(self._whole)
            self._whole.append(self._whole[-1][: max(0, len(self.ids) - k)] & (self.ids[k:] != 0))
        return self._whole[n - 1]

    def counted(self, at: np.ndarray, n: int) -> tuple[list[bytes], np.ndarray]:
        """The different sequences of n words that begin at the places `at`, and how often each does."""
        key, size = self.ids[at], len(self.words)
        for k in range(1, n):
            if k > 1:  # numbers of sequences, so that the next word's fits beside them
                key = np.unique(key, return_inverse=True)[1]
            key = key * size + self.ids[at + k]
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        starts = at[first]
        if n == 1:
            return [self.words[i] for i in self.ids[starts].tolist()], count
        parts = [self.ids[starts + k].tolist() for k in range(n)]
        return [b" ".join([self.words[i] for i in of]) for of in zip(*parts, strict=True)], count


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & _U(8 * len(bits) - 1)
    return (bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 != 0


def _by_lang(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[Encoded]:
    """Batches(lang, text) as encoded texts of one language, about `chunk` bytes at once."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            size += len(text)
        if size >= chunk:
            yield from (Encoded(*of) for of in held.items())
            held, size = {}, 0
    yield from (Encoded(*of) for of in held.items())


_PASS = "kind string, lang string, phrase string, n long, block int, places binary, counts binary"


def _count_rows(lang: str, phrases: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
    n = len(phrases)
    none = pa.nulls(n, pa.binary())
    cols = [pa.array(["gram"] * n, pa.string()), pa.array([lang] * n, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts.astype(np.int64)), pa.nulls(n, pa.int32()), none, none]
    return pa.RecordBatch.from_arrays(cols, names=["kind", "lang", "phrase", "n", "block", "places", "counts"])


def _bucket_rows(counters: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counters in blocks: all of a full block, places and counts of a sparse one."""
    for block in range(max(1, len(counters) // _BLOCK)):
        part = counters[block * _BLOCK : (block + 1) * _BLOCK]
        at = np.flatnonzero(part)
        if not len(at):
            continue
        sparse = 3 * len(at) < len(part)
        places, counts = (at.astype("<u2").tobytes(), part[at].tobytes()) if sparse else (None, part.tobytes())
        cols = [pa.array(["bucket"]), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([block], pa.int32()), pa.array([places], pa.binary()), pa.array([counts], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["kind", "lang", "phrase", "n", "block", "places", "counts"])


def _tally(counters: np.ndarray, hashes: np.ndarray) -> None:
    """Count hashes in their buckets; counters stop at 255."""
    at, count = np.unique(hashes & _U(len(counters) - 1), return_counts=True)
    counters[at] = np.minimum(counters[at] + np.minimum(count, 255), 255)


def _bitmap(blocks: DataFrame, spec: PhraseSpec, least: int):
    """Broadcast bitmap of the buckets whose counts add up to `least`; blocks(block, places, counts).

    A task adds up the blocks it is dealt as they come in, so its memory is
    theirs, however many rows each has.  2 ** bits / 8 bytes reach the driver.
    """
    size = min(_BLOCK, 1 << spec.bits)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, places, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sums.setdefault(block, np.zeros(size, np.uint16))
                at = slice(None) if places is None else np.frombuffer(places, "<u2")
                own[at] = np.minimum(own[at] + np.frombuffer(counts, np.uint8), 255)
        for block, own in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "bits": pa.array([np.packbits(own >= least, bitorder="little").tobytes()], pa.binary())})

    spark = blocks.sparkSession
    summed = arrow_map(blocks.select("block", "places", "counts").repartition("block"), add_up, "block int, bits binary")
    whole = np.zeros((1 << spec.bits) // 8, np.uint8)
    for row in summed.collect():  # one row a block, 2 ** bits in all
        own = np.frombuffer(row.bits, np.uint8)
        whole[row.block * len(own) : (row.block + 1) * len(own)] = own
    return spark.sparkContext.broadcast(whole)


def _members(frequent: DataFrame, n: int, spec: PhraseSpec):
    """Broadcast bitmap of the hashes of frequent(lang, phrase) of n words each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << spec.bits, np.uint8)
        for part in _by_lang(batches, spec.chunk):
            _tally(counters, part.grams(n)[part.whole(n)])
        yield from _bucket_rows(counters)

    return _bitmap(arrow_map(frequent.select("lang", "phrase"), run, _PASS), spec, 1)


def _pass(texts: DataFrame, n: int, buckets, frequent, spec: PhraseSpec) -> DataFrame:
    """Rows of kind `gram` (sequences of n words that pass both bitmaps, and at n = 1 all words with their number under the empty phrase) and, if longer ones are due, of kind `bucket`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << spec.bits, np.uint8) if n < spec.max_words else None
        for part in _by_lang(batches, spec.chunk):
            passed = part.whole(n)
            if n > 1:
                shorter = _has(frequent.value, part.grams(n - 1))
                passed = passed & shorter[: len(passed)] & shorter[1 : len(passed) + 1]
                passed[passed] = _has(buckets.value, part.grams(n)[passed])
            at = np.flatnonzero(passed)
            if len(at):
                phrases, counts = part.counted(at, n)
                if n == 1:
                    phrases, counts = [*phrases, b""], np.append(counts, len(at))
                yield _count_rows(part.lang, phrases, counts)
            if counters is not None:
                longer = part.whole(n + 1)
                longer = longer & passed[: len(longer)] & passed[1 : len(longer) + 1]
                _tally(counters, part.grams(n + 1)[longer])
        if counters is not None:
            yield from _bucket_rows(counters)

    return arrow_map(texts, run, _PASS)


def frequent_phrases(docs: DataFrame, spec: PhraseSpec = PhraseSpec()) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of all sequences of at most max_words words with f >= min_count, and (lang, n) of all words, from docs(text, lang)."""
    if not 0 < spec.min_count <= 255:
        raise ValueError("min_count is between 1 and 255")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    folder = fresh_dir(spark, "phrases")
    levels, totals, buckets, frequent = [], None, None, None
    for n in range(1, spec.max_words + 1):
        path = f"{folder}/pass-{n}"
        _pass(texts, n, buckets, frequent, spec).write.parquet(path)
        seen = spark.read.schema(_PASS).parquet(path)
        counts = seen.filter("kind = 'gram'").groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= (spec.min_count if n > 1 else 0))
        if n == 1:
            counts = counts.filter((F.col("f") >= spec.min_count) | (F.col("phrase") == ""))
        held = cut(counts.select("lang", F.lit(n).alias("words"), "phrase", "f"))
        if n == 1:
            totals = held.filter("phrase = ''").select("lang", F.col("f").alias("n"))
            held = held.filter("phrase <> ''")
        levels.append(held)
        if n < spec.max_words:
            buckets = _bitmap(seen.filter("kind = 'bucket'"), spec, spec.min_count)
            frequent = _members(held, n, spec)
        fs, there = file_system(path)
        fs.delete_dir(there)  # what the pass gave is in its counts and bitmaps
    found = levels[0]
    for more in levels[1:]:
        found = found.unionByName(more)
    return found, totals


def association(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 a a / (l r)) of counts of at most 15 digits, in decimals that hold the products exactly."""
    a, l, r = (x.cast("decimal(15,0)") for x in (a, l, r))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (a * a), l * r).cast("long")


def _looked_up(rows: DataFrame, key: str, counts: DataFrame, total: Column, name: str) -> DataFrame:
    """rows with the count `name` of rows.lang and rows[key]; what is at least a ten-thousandth of all words is broadcast, the rest joined by key."""
    heavy = counts.filter(F.col("f") * 10_000 >= total)
    light = counts.filter(F.col("f") * 10_000 < total).select("lang", F.col("phrase").alias(key), F.col("f").alias("_light"))
    near = F.broadcast(heavy.select("lang", F.col("phrase").alias(key), F.col("f").alias("_heavy")))  # 10,000 rows a length at most
    met = rows.join(near, ["lang", key], "left")
    done = met.filter("_heavy is not null").withColumn("_light", F.lit(None).cast("long"))
    open_ = met.filter("_heavy is null").join(light, ["lang", key])
    return done.unionByName(open_).withColumn(name, F.coalesce("_heavy", "_light")).drop("_heavy", "_light")


def collocations(docs: DataFrame, spec: PhraseSpec = PhraseSpec()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language of docs(text, lang).

    a, l, r and n count the phrase, the parts of its worst cut and all words of
    the language; score is floor(1000000 a a / (l r)).
    """
    found, totals = frequent_phrases(docs, spec)
    total = F.lit(totals.agg(F.sum("n")).first()[0] or 0)
    candidates = found.filter("words > 1").withColumnRenamed("f", "a")
    words = F.split("phrase", " ", -1)
    pieces = lambda lo, hi: F.array_join(F.slice(words, lo, hi), " ")
    cuts = candidates.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", pieces(F.lit(1), F.col("k")).alias("first"), pieces(F.col("k") + 1, F.col("words") - F.col("k")).alias("last"))
    parts = found.filter(F.col("words") < spec.max_words)
    both = _looked_up(_looked_up(cuts, "first", parts, total, "l"), "last", parts, total, "r")
    scored = both.withColumn("score", association(F.col("a"), F.col("l"), F.col("r")))
    worst = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("words", "a", "l", "r", "score"), F.struct("score", "k")).alias("x")).select("lang", "phrase", "x.*")
    longer = candidates.filter("words > 2").select("lang", "a", "words", words.alias("w"))
    inner = longer.select("lang", "a", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m")).select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("s"))
    covers = inner.groupBy("lang", F.array_join(F.slice("w", F.col("s"), F.col("m")), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = worst.join(covers, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < spec.share * F.col("a")))
    best = [F.desc("score"), F.desc("a"), "phrase"]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(256)))  # a language's best are among the best of its parts
    few = salted.withColumn("at", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).filter(F.col("at") <= spec.top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= spec.top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")  # one row a language
