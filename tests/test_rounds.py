"""Answers in rounds against a plain loop."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.operators.rounds import NO_ANSWER, retrieve_until
from corpusloom.plans import retrieval_queries as Q

FACTS = {"alpha": ["alpha leads to beta"], "beta": ["beta leads to gamma", "beta is blue"], "gamma": ["gamma is the end"], "loop": ["loop needs loop"]}


def plain(question, retrieve, ask, rounds, cap=8_000, given=None):
    context, seen = "\n".join(retrieve(question)) if given is None else given, set()
    for k in range(rounds):
        answer = ask(question, context, k) or ""
        m = re.search(r"NEED_MORE:\s*(.+)", answer, re.I)
        terms = [t.strip() for t in re.split("[,;]", m[1]) if t.strip()] if m else []
        new = [t for t in terms if t.lower() not in seen]
        if not new or k == rounds - 1:
            return re.sub(r"NEED_MORE:\s*(.+)", "", answer, flags=re.I).strip() or NO_ANSWER, k + 1, context
        seen |= {t.lower() for t in new}
        extra = "\n".join(retrieve(" ".join(new)))
        if extra and extra not in context:
            context = f"{context}\n{extra}".strip()[:cap]


def lookup(text):
    return [p for w in sorted(set(text.lower().split())) for p in FACTS.get(w, [])]


def reader(question, context, k):
    if question == "null":
        return None
    if "loop" in question:
        return "need_more: LOOP"
    if "mixed" in question:
        return "so far\nNEED_MORE: ; ,\nno more" if k else "first NEED_MORE: Alpha ,beta;\nrest"
    last = context.split("\n")[-1]
    return f"The end: {context.count(chr(10))}" if "end" in last else f"NEED_MORE: {last.split()[-1]}, x" if last else "Nothing"


def test_rounds_equal_a_plain_loop(spark):
    facts = spark.createDataFrame([(w, p, i) for w, ps in FACTS.items() for i, p in enumerate(ps)], "word string, passage string, at int")
    asked = {}

    def retrieve(frame):
        words = frame.select("query_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+", -1))).alias("word"))
        return words.join(facts, "word").select("query_id", F.struct("word", "at").alias("rank"), "passage")

    def ask(frame):
        rows = frame.collect()
        asked.setdefault(rows[0]["round"] if rows else -1, set()).update(r.query_id for r in rows)
        return spark.createDataFrame([(r.query_id, reader(r.question, r.context, r["round"])) for r in rows], "query_id long, answer string")

    questions = [(1, "alpha"), (2, "beta"), (3, "gamma"), (4, "loop"), (5, "mixed"), (6, "unknown"), (7, "null"), (8, ""), (None, "alpha"), (9, None)]
    frame = spark.createDataFrame(questions, "query_id long, question string")
    for rounds, cap in ((3, 8_000), (2, 30), (1, 8_000)):
        asked.clear()
        got = {r.query_id: (r.answer, r.rounds, r.context) for r in retrieve_until(frame, retrieve, ask, rounds, cap).collect()}
        expected = {q: plain(t or "", lookup, reader, rounds, cap) for q, t in questions if q is not None}
        assert got == expected
        assert all(asked.get(k, set()) == {q for q, (_, n, _) in expected.items() if n > k} for k in range(rounds))  # settled rows are not asked again


def test_given_context_is_not_retrieved(spark):
    seen = []

    def retrieve(frame):
        seen.extend(r.query_id for r in frame.collect())
        return frame.select("query_id", F.lit(1).alias("rank"), F.lit("found").alias("passage"))

    frame = spark.createDataFrame([(1, "a", "given"), (2, "b", None)], "query_id long, question string, context string")
    got = retrieve_until(frame, retrieve, lambda f: f.select("query_id", F.col("context").alias("answer"))).collect()
    assert {r.query_id: r.answer for r in got} == {1: "given", 2: "found"} and seen == [2]


def test_query_equals_a_plain_loop(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    from corpusloom.functions import text as X

    tokens = lambda rows: [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(X.tokens(F.col("x")).alias("t")).collect()]
    held = dict(zip(docs, map(Counter, tokens([docs[i].text for i in docs])), strict=True))
    size = {i: sum(c.values()) for i, c in held.items()}
    df = Counter(t for c in held.values() for t in c)
    idf = {t: math.log(len(held) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    mean, avg = sum(idf.values()) / len(idf), sum(size.values()) / len(size)

    def retrieve(text):
        asked, score = Counter(tokens([text])[0]), Counter()
        for i, c in held.items():
            s = sum(q * (0.25 * mean if idf[t] < 0 else idf[t]) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * size[i] / avg)) for t, q in asked.items() if t in c)
            if round(s, 6) > 0:
                score[i] = round(s, 6)
        best = sorted(score, key=lambda i: (-score[i], i))[:2]
        return [f"[{docs[i].source}] " + docs[i].text.split("\n")[0] for i in best]

    def ask(q):
        def read(question, context, k):
            sources = sorted(set(re.findall(r"(?m)^\[(\w+)\]", context)))
            words = sorted(set(re.findall("[a-z]+", context.split("\n")[-1].lower())), key=lambda w: (-len(w), w))
            return "From " + ", ".join(sources) if len(sources) >= 2 + q % 3 else "NEED_MORE: " + ", ".join(words[:2])

        return read

    got = {r.query_id: (r.answer, r.rounds, r.context) for r in Q.iterative_retrieve(spark, sf).collect()}
    items = [r for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.item_id < 12]
    for r in items:
        assert got[r.item_id] == plain(r.text, retrieve, ask(r.item_id), 3), r.item_id
    assert {n for _, n, _ in got.values()} >= {1, 2}
