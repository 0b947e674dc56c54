"""License detection by ordered signature rules, with DataFrame functions only.

A text is lower-cased and reduced to its words.  A few anchor words let most
texts pass untouched; the others are tested for the rules' keywords, and a
rule's pattern is tried only where one of its keywords stands.  Matches are marked in
the text, so their word ranges are read off in one pass over the words however
many there are.  Detections of a text are then resolved in an ordered window: one that
lies inside another of the same or a higher priority falls away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.llm.license_rules import LicenseRule, license_rules
from corpusloom.llm.words import spaced_words

#: Fixed phrases and their labels; their places are counted whatever the rules find.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: How sure a detection of each priority is; a base phrase alone counts as 1.
CONFIDENCE = {1: 0.5, 2: 0.8, 3: 0.95}


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _starts(marked: str, mark: str) -> str:
    """Places of the words of `marked` that carry a mark at their start (\\u0002) or end (\\u0003)."""
    test = "startswith(w[i], '\\u0002')" if mark == "start" else "endswith(w[i], '\\u0003')"
    words = f"split(substring({marked}, 2, char_length({marked}) - 2), ' ')"
    return f"flatten(transform(array({words}), w -> filter(sequence(0, size(w) - 1), i -> {test})))"


def _base_places(phrase: str) -> str:
    """Starts of a phrase in `padded`; an empty array where it doesn't stand."""
    marked = f"regexp_replace(padded, '(?<= ){phrase}(?= )', '\\u0002$0')"
    return f"if(contains(padded, ' {phrase} '), {_starts(marked, 'start')}, cast(array() as array<int>))"


def _stands(keyword: str) -> str:
    return f"contains(padded, ' {keyword} ')"


def _groups(rules: list[LicenseRule]) -> str:
    """Literal array of (keywords, rules that any of them opens)."""
    by: dict[tuple[str, ...], list[str]] = {}
    for r in rules:
        by.setdefault(r.keywords, []).append(f"struct({_quote(r.label)} as label, {r.priority} as priority, {_quote('(?<= )(?:' + r.pattern + ')(?= )')} as pattern)")
    return "array(" + ", ".join(f"struct({' or '.join(_stands(k) for k in ks)} as open, array({', '.join(v)}) as rules)" for ks, v in sorted(by.items())) + ")"


def _anchors(rules: list[LicenseRule]) -> str:
    """True where a keyword stands: one alternation of all of them."""
    words = sorted({k for r in rules for k in r.keywords})
    return f"padded rlike ' (?:{'|'.join(words)}) '"


def _detections(rules: list[LicenseRule]) -> str:
    """array<struct<start, stop, priority, label>> of all rules of which a keyword stands in `padded`."""
    open_rules = f"flatten(transform(filter({_groups(rules)}, g -> g.open), g -> g.rules))"
    marked = "regexp_replace(padded, r.pattern, '\\u0002$0\\u0003')"
    tried = f"filter(transform({open_rules}, r -> struct(r.label as label, r.priority as priority, {marked} as marked)), r -> r.marked <> padded)"
    spans = f"transform(arrays_zip({_starts('r.marked', 'start')}, {_starts('r.marked', 'end')}), z -> struct(z['0'] as start, z['1'] + 1 as stop, r.priority as priority, r.label as label))"
    return f"flatten(transform({tried}, r -> {spans}))"


def scan_licenses(docs: DataFrame, rules: list[LicenseRule] | None = None) -> DataFrame:
    """One row a document: (doc_id, text_key, n_words, base_labels, n_base, first_word, last_word, detections, labels, score).

    n_base counts all places of the base phrases, first_word and last_word are
    their least and largest start (null without any); detections are the
    surviving struct<start, stop, priority, label> of the rules in order; labels
    are the distinct ones of both, sorted; score is the surest of them, 0 for none.
    Null and wordless texts have no words and no labels.  Repeated rows all
    return, null doc_ids are kept, other columns are ignored; no rows give none.
    """
    rules = license_rules() if rules is None else rules
    spaced = docs.select("doc_id", F.xxhash64("text").alias("text_key"), spaced_words(F.col("text")).alias("spaced"))
    padded = spaced.select("doc_id", "text_key", F.when(F.col("spaced") == "", F.lit(0)).otherwise(F.char_length("spaced") - F.char_length(F.replace("spaced", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"), F.concat(F.lit(" "), "spaced", F.lit(" ")).alias("padded"))
    none = "cast(array() as array<struct<start:int,stop:int,priority:int,label:string>>)"
    for phrase, label in BASE:
        padded = padded.withColumn(label, F.expr(_base_places(phrase)))
    found = padded.withColumn("dets", F.expr(f"if({_anchors(rules)}, {_detections(rules)}, {none})") if rules else F.expr(none))
    places = F.concat(*[F.col(f"`{label}`") for _, label in BASE])
    base_labels = F.array_sort(F.filter(F.array(*[F.when(F.size(F.col(f"`{label}`")) > 0, F.lit(label)) for _, label in BASE]), lambda x: x.isNotNull()))
    rows = found.select(
        "doc_id", "text_key", "n_words", base_labels.alias("base_labels"), F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), F.posexplode_outer("dets").alias("k", "det")
    ).select("*", "det.start", "det.stop", "det.priority", "det.label")
    order = Window.partitionBy("doc_id", "text_key").orderBy("start", F.desc("stop"), F.desc("priority"), "label").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.lit(False)
    for p in sorted(CONFIDENCE):
        reach = F.max(F.when(F.col("priority") >= p, F.col("stop"))).over(order)
        covered = F.when(F.col("priority") == p, F.coalesce(reach >= F.col("stop"), F.lit(False))).otherwise(covered)
    sure = F.lit(None).cast("double")
    for p, c in CONFIDENCE.items():
        sure = F.when(F.col("priority") == p, F.lit(c)).otherwise(sure)
    resolved = rows.withColumn("gone", covered).select("*", (~F.col("gone") & F.col("start").isNotNull()).alias("stays"), sure.alias("sure"))
    keys = ["doc_id", "text_key", "n_words", "n_base", "first_word", "last_word"]
    per_doc = resolved.groupBy(*keys).agg(
        F.first("base_labels").alias("base_labels"), F.sum((F.coalesce("k", F.lit(0)) == 0).cast("long")).alias("rows"), F.collect_set(F.when(F.col("stays"), F.col("det"))).alias("detections"), F.max(F.when(F.col("stays"), F.col("sure"))).alias("sure")
    )
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("detections", lambda d: d["label"]))))
    base_sure = F.when(F.col("n_base") > 0, F.lit(CONFIDENCE[1])).otherwise(F.lit(0.0))
    return per_doc.select("doc_id", "text_key", "n_words", "base_labels", "n_base", "first_word", "last_word", F.array_sort("detections").alias("detections"), labels.alias("labels"), F.greatest(F.coalesce("sure", F.lit(0.0)), base_sure).alias("score"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy")).drop("copy")
