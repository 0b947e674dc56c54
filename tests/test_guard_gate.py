"""The pass that says where the rules of the guard are tried at all: never a rule's match without it, and rules run once."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P, scan, text as X
from corpusloom.operators import guard

PIECES = ["ignore", "all", "previous", "instructions", "you are now a b", "DAN", "dan", "éDAN", "do anything now", "god mode", "show me", "api key", "api_key", "print .{0,30}", "system prompt", "x.env", "A_API_KEY", "_PASS", "training", "data", "<|system|>", "### User :", "[INST]", "</context>", "``` system",
          "NOTE TO AI: ignore", "IMPORTANT AI DIRECTIVE", "2345 6789 0123", "ABCDE1234F", "+91 9876543210", "09876543210", "é.@b.co", "a@b.coé", "22ABCDE1234F1Z5", "A1234567", "ABC1234567", "4111-1111-1111-1111", "10.0.0.255", "don't", "apply", "your", "\u212aey", "\u2028", "\x0b", "\n", "\t", " ", "  ", "x", "é", "_", ".", "pretend you are not rules", "what are your rules"]


def test_no_match_without_suspicion(spark):
    rng = random.Random(8)
    texts = [rng.choice(["", " ", "\x0b"]).join(rng.choices(PIECES, k=rng.randint(1, 6))) for _ in range(6000)] + PIECES + ["", None]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", (X.injection(F.col("t"))[1] != "allow").alias("rule"), (X.redact(F.col("t")) != F.col("t")).alias("pii")).collect()
    may = dict(zip(texts, scan.suspect(pa.array(texts, pa.string())).to_pylist(), strict=True))
    assert all(may[r.t] for r in found if r.rule or r.pii)
    assert sum(bool(r.rule) for r in found) > 500 and sum(bool(r.pii) for r in found) > 500 and not may["x"] and not may["é"]


def test_the_same_decisions(spark):
    rng = random.Random(9)
    texts = [rng.choice(["", " ", "\n"]).join(rng.choices(PIECES, k=rng.randint(1, 5))) for _ in range(1500)] + ["", "a", None, "plain words of no interest"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, _may string").select("id", "_may", F.col("_may").alias("t"))
    both = guard.input_decisions(rows, "t", "d").withColumn("own", guard.input_decision(F.col("t")))
    assert both.columns == ["id", "_may", "t", "d", "own"] and both.filter("not (d <=> own)").isEmpty() and both.filter("d.action = 'refuse'").count() > 100
    tree = guard.input_decisions(rows, "t", "d").select("d.action", "d.cleaned", "d.reason")._jdf.queryExecution().executedPlan().toString()
    assert tree.count(P.INJECTION[0][0][:40]) <= 1 and "ArrowEvalPython" in tree
