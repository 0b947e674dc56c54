"""Fidelity, citation and refusal measures, confidence intervals and the gate."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import patterns as P, text as X
from corpusloom.shipping import ship

# Fixed value: numbers with their units.
QUANTITY = r"\b([0-9][0-9,]*(?:\.[0-9]+)?)\b\s*([A-Za-zµ°%][A-Za-zµ°%/0-9^-]*)?"

# The gate (name, metric, direction, threshold).
GATES = [
    ("Faithfulness", "faithfulness", "min", 0.90),
    ("Hallucination on absent", "hallucination_rate", "max", 0.02),
    ("Numeric fidelity (CE1)", "ce1_grounded_rate", "min", 0.95),
    ("Unit-swap rate (CE1)", "ce1_unit_swap_rate", "max", 0.01),
    ("Formula fidelity (CE2)", "ce2_formula_pass_rate", "min", 0.90),
    ("Fabricated citations (CE3)", "ce3_fabricated_cite_rate", "max", 0.0),
    ("Uncited claims (CE3)", "ce3_uncited_claim_rate", "max", 0.10),
    ("Context recall", "context_recall", "min", 0.85),
    ("Context precision", "context_precision", "min", 0.70),
    ("Answer correctness", "factual_correctness", "min", 0.75),
    ("Answer relevancy", "answer_relevancy", "min", 0.80),
    ("False refusal", "false_refusal_rate", "max", 0.08),
    ("Security suite", "security_pass_rate", "min", 1.0),
    ("Judge trust (kappa)", "judge_kappa", "min", 0.6),
]
STRATUM_FLOOR = 0.85


def quantity_pairs(text: Column) -> Column:
    """array<struct<v, u>>: numbers in plain form with the unit that follows, lower-cased, or empty."""
    text = F.coalesce(text, F.lit(""))
    values = F.transform(F.regexp_extract_all(text, F.lit(QUANTITY), 1), _plain)
    units = F.transform(F.regexp_extract_all(text, F.lit(QUANTITY), 2), lambda u: F.regexp_replace(F.lower(F.coalesce(u, F.lit(""))), r"[^a-z0-9/^]", ""))
    return F.zip_with(values, units, lambda v, u: F.struct(v.alias("v"), u.alias("u")))


def _plain(x: Column) -> Column:
    x = F.replace(x, F.lit(","), F.lit(""))
    return F.when(x.contains("."), F.regexp_replace(F.regexp_replace(x, "0+$", ""), r"\.$", "")).otherwise(x)


def numeric_fidelity(answer: Column, context: Column) -> Column:
    """struct<total, grounded, unit_swaps> of the answer's quantities; a known number with a unit it never has in the context is a swap."""
    said, known = quantity_pairs(answer), quantity_pairs(context)

    def state(q: Column) -> Column:
        same = F.filter(known, lambda k: k["v"] == q["v"])
        units = F.filter(same, lambda k: k["u"] != "")
        fits = (q["u"] == "") | (F.size(units) == 0) | F.exists(units, lambda k: k["u"] == q["u"])
        return F.when(F.size(same) == 0, "unknown").when(fits, "grounded").otherwise("swap")

    states = F.transform(said, state)
    count = lambda s: F.size(F.filter(states, lambda x: x == s))
    return F.struct(F.size(said).alias("total"), count("grounded").alias("grounded"), count("swap").alias("unit_swaps"))


def formula_form(text: Column) -> Column:
    """Body of the first math span, or the text, without white space and dollar signs."""
    text = F.coalesce(text, F.lit(""))
    display = F.regexp_extract(text, r"(?s)\$\$(.+?)\$\$", 1)
    inline = F.regexp_extract(text, r"(?s)\$(.+?)\$", 1)
    body = F.when(display != "", display).when(inline != "", inline).otherwise(text)
    return F.trim(F.regexp_replace(body, r"\s+", ""), F.lit("$"))


def formula_fidelity(answer: Column, expected: Column) -> Column:
    """Whether the answer has the expected formula, white space aside; true where none is expected."""
    wanted = formula_form(expected)
    spans = F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"(?s)\$\$.+?\$\$|\$.+?\$"), 0), formula_form)
    whole = F.regexp_replace(F.coalesce(answer, F.lit("")), r"\s+", "")
    return (wanted == "") | whole.contains(wanted) | F.exists(spans, lambda s: s.contains(wanted))


def cited(text: Column) -> Column:
    """Distinct ids cited in line or in the SOURCES line, sorted."""
    text = F.coalesce(text, F.lit(""))
    inline = F.transform(F.regexp_extract_all(text, F.lit(P.INLINE_CITATION), 1), lambda x: F.concat(F.lit("S"), x))
    footer = F.transform(F.split(F.regexp_extract(text, r"(?i)SOURCES:\s*\[([^\]]*)\]", 1), ",", -1), lambda x: F.trim(x))
    return F.array_sort(F.array_union(inline, F.filter(footer, lambda x: x.rlike("^S[0-9]+$"))))


def citation_integrity(answer: Column, valid: Column) -> Column:
    """struct<cited, fabricated, factual, uncited> of an answer."""
    found = cited(answer)
    body = F.regexp_replace(F.coalesce(answer, F.lit("")), P.SOURCES_FOOTER, "")
    factual = F.filter(X.sentences(body), lambda s: F.char_length(F.trim(s)) > 25)
    bare = F.filter(factual, lambda s: ~s.rlike(r"\[S[0-9]+\]"))
    return F.struct(F.size(found).alias("cited"), F.array_sort(F.array_except(found, valid)).alias("fabricated"), F.size(factual).alias("factual"), F.size(bare).alias("uncited"))


def confusion(rows: DataFrame) -> DataFrame:
    """One row of counts and rates from rows(answerable, refused); a rate over nothing is 0."""
    a, r = F.col("answerable"), F.col("refused")
    counts = rows.agg(F.count_if(a & ~r).alias("true_answer"), F.count_if(a & r).alias("false_refusal"), F.count_if(~a & r).alias("true_refusal"), F.count_if(~a & ~r).alias("hallucinated"))

    def rate(part: str, *others: str) -> Column:
        whole = sum((F.col(o) for o in others), F.col(part))
        return F.when(whole == 0, 0.0).otherwise(F.round(F.col(part) / whole, 6))

    return counts.withColumns({
        "false_refusal_rate": rate("false_refusal", "true_answer"),
        "hallucination_rate": rate("hallucinated", "true_refusal"),
        "refusal_precision": rate("true_refusal", "false_refusal"),
        "refusal_recall": rate("true_refusal", "hallucinated"),
    })


def retrieval_hit_rate(rows: DataFrame, expected: str, context: str) -> DataFrame:
    """rows with hit_rate: the share of the expected strings that stand in the context, case aside; 1 without any, empty ones don't count."""
    low = F.lower(F.coalesce(F.col(context), F.lit("")))
    wanted = F.filter(F.coalesce(F.col(expected), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    found = F.size(F.filter(wanted, lambda x: low.contains(F.lower(x))))
    return rows.withColumn("hit_rate", F.when(F.size(wanted) == 0, 1.0).otherwise(F.round(found / F.size(wanted), 6)))


def run_manifest(corpus: DataFrame, knobs: dict) -> dict:
    """What a run depends on: its settings, and a fingerprint of corpus(doc_id, text) that does not depend on row order."""
    row = corpus.agg(F.count("*").alias("n"), F.sum(F.xxhash64("doc_id", "text").cast("decimal(38,0)")).alias("s")).first()
    return {"knobs": dict(sorted(knobs.items())), "documents": row["n"], "corpus": hashlib.sha256(f"{row['n']}:{row['s']}".encode()).hexdigest()}


def write_outputs(samples: DataFrame, results: DataFrame, violations: list[str], manifest: dict, root: str) -> None:
    """Samples as JSON lines, the gate as Markdown, the manifest as JSON, each a folder under root that Spark writes."""
    spark = samples.sparkSession
    samples.write.mode("overwrite").json(f"{root}/samples")
    for name, text in (("gate", render_markdown(results, violations)), ("manifest", json.dumps(manifest, indent=1, sort_keys=True))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/{name}")


def judge_score(answer: Column) -> Column:
    """First number in a judge's answer, clamped to [0, 1]; null without one."""
    number = F.regexp_extract(F.coalesce(answer, F.lit("")), r"[0-9]+(?:\.[0-9]+)?", 0)
    return F.when(number != "", F.greatest(F.lit(0.0), F.least(F.lit(1.0), number.cast("double"))))


def render_markdown(results: DataFrame, violations: list[str]) -> str:
    """The gate as a Markdown table and its verdict: GO only if every gate passed and no stratum is below its floor."""
    rows = sorted(results.collect(), key=lambda r: [g[0] for g in GATES].index(r["name"]))  # 14 rows
    go = all(r["status"] == "PASS" for r in rows) and not violations
    lines = [f"# Gate: {'GO' if go else 'NO-GO'}", "", "| gate | value | threshold | status |", "|-|-|-|-|"]
    lines += [f"| {r['name']} | {'-' if r['value'] is None else format(r['value'], '.3f')} | {r['threshold']:g} | {r['status']} |" for r in rows]
    return "\n".join(lines + (["", "Below the floor: " + ", ".join(sorted(violations))] if violations else [])) + "\n"


def scorecard(metrics: DataFrame) -> DataFrame:
    """(name, metric, value, threshold, status) of every gate from metrics(metric, value); a missing value is skipped."""
    gates = metrics.sparkSession.createDataFrame(GATES, "name string, metric string, direction string, threshold double")
    joined = F.broadcast(gates).join(metrics, "metric", "left")  # 14 rows
    good = F.when(F.col("direction") == "min", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return joined.select("name", "metric", "value", "threshold", F.when(F.col("value").isNull(), "SKIP").when(good, "PASS").otherwise("FAIL").alias("status"))


def bootstrap(rows: DataFrame, key: str, value: str, resamples: int = 2000, seed: int = 1234) -> DataFrame:
    """(key, mean, lo, hi, n): percentile intervals of the mean over rows grouped by distinct value.

    Only (value, count) pairs of a key are brought together, and a resample draws
    how often each value falls, so memory is bounded by the distinct values.
    """
    ship(rows.sparkSession)
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(value)
        n, p = int(frame["c"].sum()), frame["c"].to_numpy() / frame["c"].sum()
        draws = np.random.default_rng(seed).multinomial(n, p, size=resamples) @ frame[value].to_numpy(float) / n
        lo, hi = np.percentile(draws, [2.5, 97.5])
        return pd.DataFrame({key: [frame[key].iloc[0]], "mean": [float(frame[value].to_numpy(float) @ p)], "lo": [lo], "hi": [hi], "n": [n]})

    return counts.groupBy(key).applyInPandas(one, f"{key} {dict(rows.dtypes)[key]}, mean double, lo double, hi double, n long")
