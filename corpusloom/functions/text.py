"""Text features, cleaning and checks as Column functions; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from corpusloom.functions import patterns as P


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def tokens(text: Column) -> Column:
    """Words, numbers and mathematical symbols of a text in order, words lower-cased; LaTeX commands count as words."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\([A-Za-z]+)", " $1 ")
    return F.transform(F.regexp_extract_all(plain, F.lit(P.TOKEN_SCAN), 0), F.lower)


def match_form(text: Column) -> Column:
    """Lower-cased without white space, for comparing formulas."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""))


def formula_fragments(text: Column) -> Column:
    """Distinct fragments with mathematical notation in order, without dollar signs, of two characters or more."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(P.FORMULA_FRAGMENT), 0)
    trimmed = F.transform(raw, lambda x: F.trim(F.trim(x, F.lit("$ "))))
    long = F.filter(trimmed, lambda x: F.char_length(match_form(x)) >= 2)
    forms = F.transform(long, match_form)
    return F.filter(long, lambda x, i: F.array_position(forms, match_form(x)) == i + 1)


def has_formula(text: Column) -> Column:
    return matches(text, P.DISPLAY_MATH) | matches(text, P.INLINE_MATH) | matches(text, P.LATEX_COMMAND)


def has_table(text: Column) -> Column:
    rows = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(P.TABLE_ROW))
    return F.size(rows) >= 2


def numeric_density(text: Column) -> Column:
    """Share of white-space tokens with a digit, to four places; 0 without tokens."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_count(text, F.lit(r"\S+"))
    # from the start of a token over what is no digit, without going back
    numeric = F.regexp_count(text, F.lit(r"(?<!\S)[^\s0-9]*+[0-9]"))
    return F.when(words > 0, F.round(numeric / words, 4)).otherwise(F.lit(0.0))


def bound(value: Column, use) -> Column:
    """use(value), where the value is computed once however often it is named."""
    return F.transform(F.array(value), use)[0]


def quality_reason(text: Column, least_chars: int = 40, most_bad: float = 0.10, least_alnum: float = 0.50, least_unique: int = 8, most_repeat: float = 0.40) -> Column:
    """The first quality rule that a text fails, or ok; display math counts as valid characters."""

    def parts(bare: Column) -> Column:
        has_math = bare.contains("$$")
        return F.struct(
            F.char_length(bare).alias("n"),
            F.regexp_count(bare, F.lit(P.BAD_CHARACTER)).alias("bad"),
            F.when(has_math, F.regexp_replace(bare, P.DISPLAY_MATH, " ")).otherwise(bare).alias("prose"),
            F.when(has_math, F.char_length(bare) - F.char_length(F.regexp_replace(bare, P.DISPLAY_MATH, ""))).otherwise(0).alias("math"),
            F.regexp_extract_all(F.lower(bare), F.lit(P.WORD), 0).alias("words"),
        )

    def counts(x: Column) -> Column:
        solid = F.char_length(F.regexp_replace(x["prose"], r"\s+", ""))
        alnum = F.char_length(x["prose"]) - F.char_length(F.regexp_replace(x["prose"], r"[\p{L}\p{N}]+", ""))
        return F.struct(x["n"].alias("n"), x["bad"].alias("bad"), (solid + x["math"]).alias("solid"), (alnum + x["math"]).alias("alnum"), F.size(x["words"]).alias("words"), F.size(F.array_distinct(x["words"])).alias("unique"))

    def verdict(x: Column) -> Column:
        return (
            F.when(x["n"] < least_chars, "short")
            .when(x["bad"] / x["n"] > most_bad, "encoding")
            .when((x["solid"] > 0) & (x["alnum"] / x["solid"] < least_alnum), "alphanumeric")
            .when(x["unique"] < least_unique, "unique")
            .when(1 - x["unique"] / x["words"] > most_repeat, "repetition")
            .otherwise("ok")
        )

    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return bound(bound(bound(bare, parts), counts), verdict)


def clean_markdown(text: Column) -> Column:
    """OCR noise out of a text, formulas untouched: soft hyphens, words broken at line ends, stray glyphs, runs of blanks and of blank lines."""
    def prose(x: Column) -> Column:
        x = F.regexp_replace(x, "\u00ad", "")
        x = F.regexp_replace(x, r"([\p{L}\p{N}_]+)-\s*\n\s*([\p{L}\p{N}_]+)", "$1$2")
        x = F.regexp_replace(x, "[\u25a0\u25a1\u25aa\u25cf\u2022\ufffd]", " ")
        x = F.regexp_replace(x, r"[ \t]{2,}", " ")
        return F.regexp_replace(x, r"\n{3,}", "\n\n")

    text = F.coalesce(text, F.lit(""))
    math = r"(?s:\$\$.+?\$\$)|\$[^$\n]+\$"
    between = F.split(F.regexp_replace(text, math, "\u0001"), "\u0001", -1)
    spans = F.regexp_extract_all(text, F.lit(math), 0)
    joined = F.array_join(F.transform(F.arrays_zip(F.transform(between, prose).alias("a"), spans.alias("b")), lambda z: F.concat(F.coalesce(z["a"], F.lit("")), F.coalesce(z["b"], F.lit("")))), "")
    return F.regexp_replace(joined, r"^\s+|\s+$", "")


def strip_html(html: Column) -> Column:
    """Text of a page: junk elements with their content and comments out, other tags replaced by blanks, entities of five kinds read."""
    x = F.coalesce(html, F.lit(""))
    for tag in P.JUNK_TAGS:
        x = F.regexp_replace(x, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?is)^.*?<body\b[^>]*>", "")
    x = F.regexp_replace(x, r"(?s)<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def charset_ok(text: Column) -> Column:
    """No control, format, private or unassigned character but line breaks and tabs."""
    return ~F.regexp_replace(F.coalesce(text, F.lit("")), r"[\n\r\t]", "").rlike(r"\p{C}")


def redact(text: Column) -> Column:
    """Personal data replaced by its kind, kind after kind."""
    return reduce(lambda x, rule: F.regexp_replace(x, rule[1], f"<{rule[0]}>"), P.PII, text)


def pii_count(text: Column, kind: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(dict(P.PII)[kind]))


def contains_pii(text: Column) -> Column:
    return reduce(lambda x, y: x | y, [matches(text, P.PHONE_FOUND if kind == "PHONE" else pattern) for kind, pattern in P.PII])


def injection(text: Column) -> tuple[Column, Column]:
    """(category, action) of the first rule that matches; ("", allow) for none."""
    category, action = F.lit(""), F.lit("allow")
    for pattern, kind, what in reversed(P.INJECTION):
        hit = matches(text, "(?i)" + pattern)
        category, action = F.when(hit, kind).otherwise(category), F.when(hit, what).otherwise(action)
    return category, action


def injection_rule(text: Column) -> Column:
    """struct<category, action> of the first rule that matches, in one pass over the rules; ("", allow) for none."""
    rule = F.struct(F.lit("").alias("category"), F.lit("allow").alias("action"))
    for pattern, kind, what in reversed(P.INJECTION):
        rule = F.when(matches(text, "(?i)" + pattern), F.struct(F.lit(kind).alias("category"), F.lit(what).alias("action"))).otherwise(rule)
    return rule


def neutralize(text: Column) -> Column:
    return reduce(lambda x, rule: F.regexp_replace(x, "(?i)" + rule[0], P.NEUTRALIZED), P.INJECTION, text)


def leaks(text: Column) -> Column:
    return reduce(lambda x, y: x | y, [matches(text, p) for p in P.LEAKAGE])


def scrub_leaks(text: Column) -> Column:
    return F.trim(reduce(lambda x, p: F.regexp_replace(x, p, "[REDACTED]"), P.LEAKAGE, text))


def sanitize_entity(name: Column) -> Column:
    """An entity name safe to search for: 100 characters, plain letters and marks, no query keywords, single blanks."""
    x = F.regexp_replace(F.substring(name, 1, 100), r"[^A-Za-z0-9 .\-_/]", "")
    for word in (";", "--", "DROP", "DELETE", "MERGE", "CREATE", "RETURN", "MATCH"):
        x = F.replace(x, F.lit(word), F.lit(""))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def clean_title(text: Column) -> Column:
    """First line without quotes and closing marks, at most 8 words and 60 characters; "New chat" if nothing is left."""
    first = F.regexp_extract(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), r"^[^\n]*", 0)
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.trim(first, F.lit("\"'"))), r"\s+", " "), r"[.!?,:;]+$", "")
    short = F.trim(F.substring(F.array_join(F.slice(F.split(bare, " ", -1), 1, 8), " "), 1, 60))
    return F.when(short == "", "New chat").otherwise(short)


def sentences(text: Column) -> Column:
    """Sentences split after . ! or ? and white space; empty ones go."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+", -1), lambda x: F.trim(x) != "")


def normalized_numbers(text: Column) -> Column:
    """Distinct numbers without thousands separators and trailing zeros, sorted."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(P.GROUNDING_NUMBER), 0)
    plain = F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")))
    return F.array_sort(F.array_distinct(F.transform(plain, lambda x: F.when(x.contains("."), F.regexp_replace(F.regexp_replace(x, "0+$", ""), r"\.$", "")).otherwise(x))))
