"""Decisions on requests, passages and answers, as columns and joins."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import patterns as P, text as X
from corpusloom.functions.scan import suspect
from corpusloom.shipping import ship

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\u200b-\u200f\u2028-\u202e\ufeff]"


def normalize(rows: DataFrame, text: str, most: int = 2000) -> DataFrame:
    """NFKC (no built-in has it), then control characters out, blanks squeezed, cut, long encoded blobs replaced."""

    ship(rows.sparkSession)
    nfkc = F.pandas_udf(lambda texts: texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t)), "string")
    wide = F.octet_length(text) > F.char_length(text)  # what is plain ASCII stays as it is, and out of Python
    rows = rows.withColumn("_wide", F.when(wide, F.col(text))).withColumn(text, F.coalesce(F.when(wide, nfkc("_wide")), F.col(text), F.lit(""))).drop("_wide")
    x = F.regexp_replace(F.regexp_replace(text, CONTROL, ""), r"[ \t]+", " ")
    x = F.regexp_replace(F.substring(x, 1, most), r"[A-Za-z0-9+/]{200,}={0,2}", "[ENCODED_CONTENT]")
    return rows.withColumn(text, F.regexp_replace(x, r"^\s+|\s+$", ""))


def allowed_sources(rows: DataFrame, source: str, allowed: DataFrame) -> DataFrame:
    """Rows whose source is an allowed path, its name or stem, or ends with an allowed entry; an empty list allows all.

    Equal forms are met by equality; an ending of each length that the list has
    is cut from the source and met by equality too, so no nested loop arises.
    """
    lengths = [r[0] for r in allowed.select(F.char_length("allowed").alias("n")).distinct().limit(1001).collect()]
    if not lengths:
        return rows
    if len(lengths) > 1000:
        raise ValueError("allowed entries have more than 1000 lengths")
    name = F.regexp_extract("allowed", r"[^/]*$", 0)
    whole = allowed.select(F.explode(F.array("allowed", name, F.regexp_replace(name, r"\.[^.]*$", ""))).alias("form"), F.lit(False).alias("ending"))
    forms = whole.unionByName(allowed.select(F.col("allowed").alias("form"), F.lit(True).alias("ending"))).distinct()
    tails = [F.struct(F.right(F.col(source), F.lit(n)).alias("form"), F.lit(True).alias("ending")) for n in lengths]
    keys = rows.select(source).distinct().select(source, F.explode(F.array(F.struct(F.col(source).alias("form"), F.lit(False).alias("ending")), *tails)).alias("k"))
    met = keys.join(forms, (F.col("k.form") == forms["form"]) & (F.col("k.ending") == forms["ending"]), "left_semi").select(source).distinct()
    return rows.join(met, source, "left_semi")


def request_problems(session: Column, message: Column, image: Column, most: int) -> Column:
    """Names of the fields that are not well formed."""
    uuid = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    checks = [
        F.when(session.isNotNull() & ~session.rlike(uuid), "session"),
        F.when((F.char_length(message) < 1) | (F.char_length(message) > most), "message"),
        F.when(image.isNotNull() & ~image.rlike(r"^[A-Za-z0-9+/]+={0,2}$"), "image"),
    ]
    return F.array_compact(F.array(*checks))


def input_decision(text: Column) -> Column:
    """struct<action, cleaned, reason>: the first refusal wins; personal data is redacted on the way."""

    def decide(x: Column) -> Column:
        category, action, cleaned = x["rule"]["category"], x["rule"]["action"], x["cleaned"]
        empty, refused = F.char_length(text) < 2, action == "refuse"
        act = F.when(empty | refused, "refuse").when((cleaned != text) | (action == "sanitize"), "sanitize").otherwise("allow")
        why = F.when(empty, "empty").when(refused | ((action == "sanitize") & (cleaned == text)), F.concat(F.lit("injection:"), category)).when(cleaned != text, "pii").otherwise("")
        return F.struct(act.alias("action"), F.when(empty | refused, "").otherwise(cleaned).alias("cleaned"), why.alias("reason"))

    return X.bound(F.struct(X.injection_rule(text).alias("rule"), X.redact(text).alias("cleaned")), decide)


def input_decisions(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with `input_decision` of a text as column `name`; rules are tried only where one pass over the text has found that some may match."""
    ship(rows.sparkSession)
    may = F.arrow_udf(suspect, "boolean")
    own = "_may"
    while own in rows.columns:
        own = "_" + own
    x = F.col(text)
    empty = F.char_length(x) < 2
    plain = F.struct(F.when(empty, "refuse").otherwise("allow").alias("action"), F.when(empty, "").otherwise(x).alias("cleaned"), F.when(empty, "empty").otherwise("").alias("reason"))
    return rows.withColumn(own, may(x)).withColumn(name, F.when(F.col(own), input_decision(x)).otherwise(plain)).drop(own)


@dataclass(frozen=True)
class RequestPolicy:
    """lockout: strikes that shut a session out; most_chars of a request; attack and scope: similarity limits; required: whether a request is refused where a similarity is missing."""

    lockout: int = 10
    most_chars: int = 2000
    attack: float = 0.80
    scope: float = 0.35
    required: bool = False


def request_decision(rows: DataFrame, text: str, strikes: str, attack: str, scope: str, policy: RequestPolicy = RequestPolicy()) -> DataFrame:
    """rows with action, cleaned, reason and degraded (checks that could not run), where the first refusal wins.

    In order: lockout, normalised text too short, characters, injection patterns,
    similarity to known attacks, personal data (redacted), similarity to the
    domain.  A null similarity means that the check could not run: it refuses
    where the policy requires it, and else passes with the check named in degraded.
    """
    own = "_clean"
    while own in rows.columns:
        own = "_" + own
    found = normalize(rows.withColumn(own, F.col(text)), own, policy.most_chars)
    clean = F.col(own)
    category, what = X.injection(clean)
    no_attack, no_scope = F.col(attack).isNull(), F.col(scope).isNull()
    rules = [
        (F.col(strikes) >= policy.lockout, F.lit("abuse_lockout")),
        (F.char_length(clean) < 2, F.lit("empty_input")),
        (~X.charset_ok(clean), F.lit("invalid_charset")),
        (what == "refuse", F.concat(F.lit("injection:"), category)),
        (no_attack & F.lit(policy.required), F.lit("injection_degraded_fail_closed")),
        (F.col(attack) >= policy.attack, F.lit("injection:embedding_sim")),
        (no_scope & F.lit(policy.required), F.lit("scope_degraded_fail_closed")),
        (F.col(scope) < policy.scope, F.lit("off_topic")),
    ]
    reason = F.coalesce(*[F.when(test, why) for test, why in rules], F.lit(""))
    degraded = F.array_compact(F.array(F.when(no_attack, "injection"), F.when(no_scope, "scope")))
    judged = found.withColumn("reason", reason).withColumn("degraded", degraded)
    return judged.withColumn("action", F.when(F.col("reason") == "", "allow").otherwise("refuse")).withColumn("cleaned", F.when(F.col("reason") == "", X.redact(clean)).otherwise("")).drop(own)


def output_decision(answer: Column, context: Column, valid: Column) -> Column:
    """struct<action, unsupported, fabricated>: leaks refuse; numbers without support and unknown citations sanitize."""
    unsupported = F.array_except(X.normalized_numbers(answer), X.normalized_numbers(context))
    cited = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(P.INLINE_CITATION), 1), lambda x: F.concat(F.lit("S"), x)))
    fabricated = F.array_sort(F.array_except(cited, valid))
    action = F.when(X.leaks(answer), "refuse").when((F.size(unsupported) > 0) | (F.size(fabricated) > 0), "sanitize").otherwise("allow")
    return F.struct(action.alias("action"), unsupported.alias("unsupported"), fabricated.alias("fabricated"))


@dataclass(frozen=True)
class ResponsePolicy:
    """grounding: what ungrounded content does (flag, strip or refuse); most_ungrounded: share of factual sentences beyond which an answer is refused; factual_chars: of a sentence that states something; toxic: words that refuse an answer."""

    grounding: str = "strip"
    most_ungrounded: float = 0.5
    factual_chars: int = 25
    toxic: tuple[str, ...] = ()


def response_decision(rows: DataFrame, answer: str, context: str, valid: str, ungrounded: str, policy: ResponsePolicy = ResponsePolicy()) -> DataFrame:
    """rows with action, response, citations and reasons: the whole decision on an answer.

    valid holds the ids that may be cited, ungrounded the sentences that no
    passage supports (null: not checked).  In order: leaks are scrubbed, unknown
    citations removed, numbers met with the context (an empty one checks none),
    ungrounded content flagged, stripped or refused, personal data redacted, toxic
    words refused.  A refused response is empty.
    """
    text = F.coalesce(F.col(answer), F.lit(""))
    known = F.coalesce(F.col(valid), F.array().cast("array<string>"))
    bad = F.coalesce(F.col(ungrounded), F.array().cast("array<string>"))
    has_context = F.coalesce(F.col(context), F.lit("")) != ""

    def cited(x: Column) -> Column:
        inline = F.transform(F.regexp_extract_all(x, F.lit(P.INLINE_CITATION), 1), lambda i: F.concat(F.lit("S"), i))
        footer = F.filter(F.transform(F.split(F.regexp_extract(x, r"(?i)SOURCES:\s*\[([^\]]*)\]", 1), ","), F.trim), lambda i: i.rlike(r"^S[0-9]+$"))
        return F.array_sort(F.array_distinct(F.concat(inline, footer)))

    def without_unknown(x: Column) -> Column:
        return F.aggregate(F.array_except(cited(x), known), x, lambda t, i: F.replace(t, F.concat(F.lit("["), i, F.lit("]")), F.lit("")))

    leak = X.leaks(text)
    scrubbed = X.bound(F.when(leak, X.scrub_leaks(text)).otherwise(text), without_unknown)
    numbers = F.when(has_context, F.size(F.array_except(X.normalized_numbers(F.col("_a")), X.normalized_numbers(F.coalesce(F.col(context), F.lit("")))))).otherwise(0)
    factual = F.greatest(F.lit(1), F.size(F.filter(X.sentences(F.regexp_replace("_a", P.SOURCES_FOOTER, "")), lambda s: F.char_length(F.trim(s)) > policy.factual_chars)))
    found = rows.withColumn("_a", scrubbed).withColumns({"_numbers": numbers, "_bad": bad}).withColumn("_over", F.size("_bad") / factual > policy.most_ungrounded)
    some_bad = F.size("_bad") > 0
    acts = F.lit(policy.grounding != "flag") & (some_bad | (F.col("_numbers") > 0))
    outright = acts & (F.lit(policy.grounding == "refuse") | ((F.col("_numbers") > 0) & ~some_bad) | F.col("_over"))
    stripped = F.when(acts & some_bad, X.bound(strip_sentences(F.col("_a"), F.col("_bad")), without_unknown)).otherwise(F.col("_a"))
    found = found.withColumn("_s", stripped).withColumn("_refused", outright | (acts & some_bad & (F.col("_s") == "")))
    words = F.regexp_extract_all(F.lower("_s"), F.lit("[a-z]+"), 0)
    toxic = F.arrays_overlap(words, F.array(*map(F.lit, policy.toxic))) if policy.toxic else F.lit(False)
    found = found.withColumn("_toxic", ~F.col("_refused") & F.coalesce(toxic, F.lit(False)))
    refused = F.col("_refused") | F.col("_toxic")
    reasons = F.array_compact(F.array(
        F.when(leak, "leakage_scrubbed"), F.when(F.col("_numbers") > 0, F.concat(F.lit("ungrounded_numbers:"), F.col("_numbers").cast("string"))), F.when(some_bad, F.concat(F.lit("ungrounded_sentences:"), F.size("_bad").cast("string"))),
        F.when(F.col("_refused"), "grounding_refused"), F.when(~F.col("_refused") & (F.col("_s") != F.col("_a")), "grounding_stripped"), F.when(F.col("_toxic"), "toxicity"),
    ))
    response = F.when(refused, "").otherwise(X.redact(F.col("_s")))
    action = F.when(refused, "refuse").when(response != text, "sanitize").otherwise("allow")
    citations = F.when(refused, F.array().cast("array<string>")).otherwise(F.array_intersect(cited(F.col("_s")), known))
    return found.withColumns({"action": action, "response": response, "citations": citations, "reasons": reasons}).drop("_a", "_numbers", "_bad", "_over", "_s", "_refused", "_toxic")


def strip_sentences(answer: Column, bad: Column) -> Column:
    """The answer without these sentences, its SOURCES line kept; empty if nothing is left."""
    footer = F.trim(F.regexp_extract(answer, P.SOURCES_FOOTER, 0))
    footer = F.regexp_replace(footer, r"^\s+|\s+$", "")
    kept = F.filter(X.sentences(F.regexp_replace(answer, P.SOURCES_FOOTER, "")), lambda s: ~F.array_contains(bad, s))
    body = F.array_join(F.transform(kept, lambda s: F.trim(s)), " ")
    return F.when(body == "", "").when(footer == "", body).otherwise(F.concat(body, F.lit("\n"), footer))


def grounding_gate(hits: DataFrame, least: float, passages: int) -> DataFrame:
    """Per query: passages at or above the floor, best relevance, and whether both suffice; relevance 0 falls back to score."""
    r = F.when(F.col("relevance") != 0, F.col("relevance")).otherwise(F.col("score"))
    return hits.groupBy("query_id").agg(F.count_if(r >= least).alias("above"), F.max(r).alias("top")).withColumn("grounded", (F.col("above") >= passages) & (F.col("top") >= least))
