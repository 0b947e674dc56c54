"""Language identification against sets of n-grams, and on the held-out fold."""

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusloom.llm.languages import LanguageFilter, LanguageSpec, grams, held_out, identify, identify_languages, learn, words_of

SPEC = LanguageSpec()


def plain_grams(text, lengths):
    out = []
    for w in words_of(text or ""):
        w = f" {''.join(c for c in w if c.isalpha())} "
        out += [w[k : k + n] for n in lengths for k in range(len(w) - n + 1) if w[k : k + n].strip()]
    return out


def plain_filter(rows, spec):
    """Each language's own n-grams as a set, languages of most text first."""
    counts, words = {}, Counter()
    for i, text, lang in rows:
        if i is None or text is None or lang is None or zlib.crc32(str(i).encode()) % spec.folds == spec.held_out_fold:
            continue
        words[lang] += len(words_of(text))
        counts.setdefault(lang, Counter()).update(plain_grams(text, spec.lengths))
    own = {}
    for lang, all_ in counts.items():
        total = Counter()
        for g, n in all_.items():
            total[len(g)] += n
        own[lang] = {g for g, n in all_.items() if n >= spec.share * total[len(g)]}
    return {x: own[x] for x in sorted((w for w in words if words[w]), key=lambda x: (-words[x], x))}


def plain_prediction(text, own, spec):
    if text is None or not any(c.isalpha() for c in text) or not own:
        return "und", 0.0
    said = plain_grams(text, spec.lengths)
    held = {x: sum(g in s for g in said) for x, s in own.items()}
    best = max(own, key=lambda x: held[x])
    return best, held[best] / sum(held.values()) if sum(held.values()) else 1 / len(own)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_documents_equal_exact_sets(spark):
    """With a filter of many entries, predictions are those of exact sets, in small chunks too."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()]
    spec = LanguageSpec(entries_per_gram=200, hashes=6, share=1e-4, chunk=20_000, grams=5_000)
    own = plain_filter(rows, spec)
    got = {r.doc_id: r for r in identify_languages(table(spark, rows), spec).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        lang, score = plain_prediction(text, own, spec)
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-3)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_filter_returns_all_languages_of_a_gram(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()]
    known, own = learn(table(spark, rows).filter(~held_out(F.col("doc_id"))), SPEC), plain_filter(rows, SPEC)
    assert known.languages == list(own)
    for i, lang in enumerate(own):
        words = sorted({g.strip() for g in own[lang] if g.startswith(" ") and g.endswith(" ") and len(g) == 5})
        for n, _, hashes in grams(words, (5,)):
            assert known._bit(known.containing(hashes), i).all()
    rng = np.random.default_rng(1)
    strange = rng.integers(0, 1 << 63, 200_000, dtype=np.uint64)
    wrong = [known._bit(known.containing(strange), i).mean() for i in range(len(own))]
    assert np.allclose(wrong, known.false, atol=5e-4)


def test_false_answers_are_taken_off():
    """A crowded filter: a language with few n-grams wins by its true answers, where raw counts would not."""
    rng = np.random.default_rng(2)
    many, few = rng.integers(0, 1 << 63, 60_000, dtype=np.uint64), rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    known = LanguageFilter(["many", "few"], np.repeat([0, 1], [60_000, 500]), np.append(many, few), LanguageSpec(hashes=1, entries_per_gram=1))
    text = np.append(few[:100], rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    masks = known.containing(text)
    raw = [int(known._bit(masks, i).sum()) for i in (0, 1)]
    best, _ = known.decide(np.array([[len(text), *raw]], float))
    assert raw[0] > raw[1] and known.languages[best[0]] == "few"


@pytest.mark.parametrize("n", [1, 8, 9, 33, 64, 65, 130])
def test_any_number_of_languages(n):
    hashes = np.arange(n * 20, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    language = np.repeat(np.arange(n), 20)
    known = LanguageFilter([f"l{i:03d}" for i in range(n)], language, hashes, LanguageSpec())
    masks = known.containing(hashes)
    assert all(known._bit(masks[language == i], i).all() for i in range(n))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").toPandas()
    assert len(got) > 200 and (got.lang == got.lang_pred).mean() >= 0.98
    assert got.score.between(0, 1).all()


def test_odd_rows(spark):
    rows = [(i, "the cat and the dog sat on the mat", "en") for i in range(40)] + [(i, "der hund und die katze auf dem bett", "de") for i in range(40, 60)]
    odd = [(100, None, "en"), (101, "", "en"), (102, "123 ² !? _", None), (103, "²a²", None), (None, "the dog", "xx"), (104, "ZZZZ QQQQ", None), (105, "the dog " * 40_000, None), (106, "Der Hund", None), (107, "x", None)]
    rows += odd + [odd[-2]]
    spec = LanguageSpec(entries_per_gram=64)
    own = plain_filter(rows, spec)
    assert list(own) == ["en", "de"]
    frame = table(spark, rows).withColumn("held_out", F.lit("x")).withColumn("score", F.lit(1)).withColumn("n", F.lit(2))
    got = identify_languages(frame, spec)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = got.collect()
    assert len(got) == len(rows)
    said = {i: t for i, t, _ in rows}
    for r in got:
        lang, score = plain_prediction(said[r.doc_id], own, spec)
        assert (r.lang_pred, r.doc_id is None and r.held_out) == (lang, False) and r.score == pytest.approx(score, abs=0.02)
    assert {r.doc_id: r.lang_pred for r in got}[104] == "en"


def test_nothing_to_learn_from(spark):
    assert identify_languages(table(spark, [])).count() == 0
    got = identify_languages(table(spark, [(1, "some text", None), (2, None, "en")])).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}


def test_labels_of_a_document_do_not_reach_its_prediction(spark):
    """Changing lang in the held-out fold changes nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    rows = lambda d: sorted(map(tuple, identify_languages(d).collect()))
    assert rows(docs) == rows(other)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abßüж", min_size=0, max_size=6), max_size=8), st.sampled_from([(2,), (3, 4, 5), (2, 5)]))
def test_grams_of_words(words, lengths):
    seen = Counter()
    for n, owner, hashes in grams(words, lengths):
        seen.update((n, int(o), int(h)) for o, h in zip(owner, hashes, strict=True))
    expected = [(n, i) for i, w in enumerate(words) for n in lengths for k in range(len(w) + 3 - n) if f" {w} "[k : k + n].strip()]
    assert Counter((n, o) for (n, o, _), c in seen.items() for _ in range(c)) == Counter(expected)


def test_identify_keeps_types(spark):
    known = learn(table(spark, [(1, "abc", "en")]).filter("true"), SPEC)
    got = identify(spark.createDataFrame([("k", "abc")], "doc_id string, text string"), known)
    assert dict(got.dtypes)["doc_id"] == "string" and got.first().lang_pred == "en"
