"""Every alternative of every license pattern is found: no keyword gate hides a match."""

import collections
import dataclasses
import functools
import itertools
import re
from re import _constants as C, _parser

import pytest

import brute
from corpusloom.llm import license_scan
from corpusloom.llm.license_rules import license_rules

#: Stands for what a wildcard matches: a word that no rule knows.
WILD = "\x00"


def join(parts):
    return ["".join(x) for x in itertools.product(*parts)]


def alternatives(tree):
    """All texts of a parsed pattern; a wildcard run is WILD where it can be empty or not."""
    parts = []
    for kind, value in tree:
        if kind is C.LITERAL:
            parts.append([chr(value)])
        elif kind is C.IN and value == [(C.CATEGORY, C.CATEGORY_DIGIT)]:
            parts.append(["7"])
        elif kind is C.IN and all(k is C.LITERAL for k, _ in value):
            parts.append([chr(v) for _, v in value])
        elif kind is C.SUBPATTERN:
            parts.append(alternatives(value[3]))
        elif kind is C.BRANCH:
            parts.append([x for branch in value[1] for x in alternatives(branch)])
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT) and value[2][0][0] is C.ANY:
            parts.append([WILD])
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = value
            parts.append([y for n in range(low, high + 1) for y in join([alternatives(inner)] * n)])
        else:
            raise ValueError(f"{kind} is not known here")
    return join(parts)


@functools.cache
def spelled(pattern):
    """Texts that the pattern matches as a whole: the fewest and some letters for each wildcard."""
    out = set()
    for text in alternatives(_parser.parse(pattern)):
        for wild in {"", " ", "x", " x ", "x "} if WILD in text else {""}:
            words = " ".join(text.replace(WILD, wild).split())
            if re.fullmatch(pattern, words):
                out.add(words)
    return sorted(out)


def test_each_alternative_holds_a_keyword_of_its_rule():
    lost = collections.defaultdict(list)
    for rule in license_rules():
        assert spelled(rule.pattern), rule
        for text in spelled(rule.pattern):
            if not any(f" {k} " in f" {text} " for k in (rule.keyword, *rule.more)):
                lost[rule.label, rule.pattern].append(text)
    assert not lost


def test_scan_finds_each_alternative(spark):
    """The scan against brute force with all gates open: each text starts with a word that opens them."""
    rules = license_rules()
    texts = sorted({f"zzz {text} end" for r in rules for text in spelled(r.pattern)})
    ungated = [dataclasses.replace(r, keyword="zzz") for r in rules]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    found = {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(frame).select("doc_id", "labels").collect()}
    wrong = {t: (found[k], want) for k, t in enumerate(texts) if found[k] != (want := brute.licenses(t, ungated, license_scan.BASE)[-1])}
    assert len(found) == len(texts) > 2000 and not wrong


@pytest.mark.parametrize(("text", "label"), [
    ("may not be copied", "no-redistribution"), ("may not be reproduced", "no-redistribution"), ("must not be redistributed", "no-redistribution"), ("may not be used to train models", "no-training"),
    ("noncommercial use only", "no-commercial"), ("beerware license", "beerware"), ("FreeBSD license", "bsd-2-clause"), ("0BSD license", "bsd-0-clause"),
])
def test_reported_losses(spark, text, label):
    assert label in license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["labels"]
