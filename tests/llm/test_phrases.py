"""Phrase mining against a plain count of everything."""

import re
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusloom.llm.phrases import PhraseSpec, association, collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, spec):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").encode().lower().decode()
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for m in range(1, spec.max_words + 1):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    found = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= spec.min_count}
    kept = {}
    for (lang, w), a in found.items():
        inside = [v for (other, g), v in found.items() if other == lang and len(g) > len(w) and any(g[i : i + len(w)] == w for i in range(len(g)))]
        if inside and 100 * max(inside) >= spec.share * a:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        kept.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, all_ in kept.items() for i, (s, a, p, l, r) in enumerate(sorted(all_)[: spec.top], 1))


def mined(spark, rows, spec, extra=False):
    frame = spark.createDataFrame([(t, g, 7, "x") for t, g in rows], "text string, lang string, rank int, phrase string") if extra else spark.createDataFrame(rows, "text string, lang string")
    got = collocations(frame.repartition(3), spec)
    assert got.columns == COLUMNS
    return sorted(tuple(r) for r in got.collect())


def test_documents_equal_the_plain_count(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang").collect()]
    for spec in (PhraseSpec(bits=16), PhraseSpec(bits=10, chunk=10_000), PhraseSpec(min_count=3, max_words=4, share=60, top=50, bits=18)):
        expected = plain(rows, spec)
        assert expected and mined(spark, rows, spec) == expected


def test_odd_rows(spark):
    spec = PhraseSpec(min_count=2, bits=12)
    rows = [(None, "en"), ("", None), ("a b  c\td. a b c d", None), ("a b c d", "und"), ("A B c d", "und"), ("x,y x y", "en"), ("x y;x y\rx y\x0bx y", "en"), ("é É é É é É", "fr"), ("z " * 50_000, "de"), (" ", "de")]
    rows += rows[2:4]
    expected = plain(rows, spec)
    assert {r[0] for r in expected} >= {"und", "en", "de"}
    assert mined(spark, rows, spec) == expected
    assert mined(spark, rows, spec, extra=True) == expected


def test_empty_and_poor_tables(spark):
    assert mined(spark, [], PhraseSpec(bits=12)) == []
    assert mined(spark, [("one two three", "en"), (None, None)], PhraseSpec(bits=12)) == []


def test_every_pass_counts_only_what_the_bitmaps_let_through(spark):
    """With many buckets, pass 2 counts hardly more pairs than are frequent."""
    from corpusloom.llm import phrases as P

    spec = PhraseSpec(bits=20)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    first = P._pass(docs, 1, None, None, spec).cache()
    words = first.filter("kind = 'gram' and phrase <> ''").groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter("f >= 10")
    buckets, frequent = P._bitmap(first.filter("kind = 'bucket'"), spec, 10), P._members(words, 1, spec)
    second = P._pass(docs, 2, buckets, frequent, spec).filter("kind = 'gram'").groupBy("lang", "phrase").agg(F.sum("n").alias("f")).cache()
    assert second.filter("f >= 10").count() <= second.count() <= 1.5 * second.filter("f >= 10").count() + 20
    first.unpersist(), second.unpersist()


def test_score_is_exact_beyond_64_bits(spark):
    a, l, r = 3_000_000_000_000, 3_000_000_000_001, 3_000_000_000_007
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(association(F.col("a"), F.col("l"), F.col("r")).alias("s")).first()
    assert row.s == 1_000_000 * a * a // (l * r)


def test_counts_over_255_are_rejected(spark):
    with pytest.raises(ValueError):
        mined(spark, [], PhraseSpec(min_count=256))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \t.,é\n", max_size=30), max_size=6))
def test_encoding_keeps_words_and_pieces(texts):
    from corpusloom.llm.phrases import Encoded

    part = Encoded("en", [t.encode() for t in texts])
    words = [[w for w in re.split(r"[ \t]+", p.encode().lower().decode()) if w] for t in texts for p in re.split(r"[.,;:!?\x0A-\x0D]", t)]
    for n in (1, 2, 3):
        expected = Counter(" ".join(w[i : i + n]).encode() for w in words for i in range(len(w) - n + 1))
        import numpy as np

        at = np.flatnonzero(part.whole(n))
        got = dict(zip(*part.counted(at, n), strict=True)) if len(at) else {}
        assert {k: int(v) for k, v in got.items()} == dict(expected)
        assert len(set(part.grams(n)[at].tolist())) == len(expected)
