"""Answers in rounds: what is missing is looked up and asked again, until satisfied or out of rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.session import cut

# How an answer asks for more, and what stands for none.
NEED_MORE = r"(?i)NEED_MORE:\s*(.+)"
NO_ANSWER = "I do not have enough information in my knowledge base to answer that."


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _joined(passages: DataFrame) -> DataFrame:
    """(query_id, found): passages(query_id, rank, passage) of a query in order, one a line; a retriever returns few of them."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "passage")))
    return passages.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["passage"]), "\n").alias("found"))


def retrieve_until(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], ask: Callable[[DataFrame], DataFrame], rounds: int = 3, cap: int = 8_000) -> DataFrame:
    """(query_id, answer, rounds, context) of questions(query_id, question), each id once.

    retrieve takes (query_id, text) and returns (query_id, rank, passage); ask takes
    (query_id, question, context, round) and returns (query_id, answer).  An answer
    `NEED_MORE: a, b` keeps its question open: terms that it has not asked for before
    are retrieved, put after the context (which stays within `cap` characters), and
    the question is asked again.  Only open questions take part in a round, and each
    round is cut, so what is settled is never computed again.  Questions that bring
    a non-null `context` of their own are not retrieved at first.
    """
    own = F.col("context") if "context" in questions.columns else F.lit(None).cast("string")
    start = cut(questions.filter("query_id is not null").select("query_id", F.coalesce("question", F.lit("")).alias("question"), own.alias("given")))
    first = _joined(retrieve(start.filter("given is null").select("query_id", F.col("question").alias("text"))))
    none = F.array().cast("array<string>")
    open_ = cut(start.join(first, "query_id", "left").select("query_id", "question", F.coalesce("given", "found", F.lit("")).alias("context"), none.alias("seen")))
    settled = []
    for k in range(max(1, rounds)):
        answers = ask(open_.select("query_id", "question", "context", F.lit(k).alias("round"))).select("query_id", "answer")
        asked = open_.join(answers, "query_id", "left").withColumn("answer", F.coalesce("answer", F.lit("")))
        said = F.filter(F.transform(F.split(F.regexp_extract("answer", NEED_MORE, 1), "[,;]", -1), _strip), lambda t: t != "")
        asked = asked.withColumn("terms", F.filter(said, lambda t: ~F.array_contains("seen", F.lower(t))) if k < rounds - 1 else none)
        asked = cut(asked)
        plain = _strip(F.regexp_replace("answer", NEED_MORE, ""))
        done = asked.filter(F.size("terms") == 0)
        settled.append(done.select("query_id", F.when(plain == "", NO_ANSWER).otherwise(plain).alias("answer"), F.lit(k + 1).alias("rounds"), "context"))
        more = asked.filter(F.size("terms") > 0)
        if more.isEmpty():
            break
        extra = _joined(retrieve(more.select("query_id", F.array_join("terms", " ").alias("text"))))
        met = more.join(extra, "query_id", "left")
        grown = F.substring(_strip(F.concat("context", F.lit("\n"), "found")), 1, cap)
        new = F.coalesce("found", F.lit("")) != ""
        context = F.when(new & ~F.contains("context", "found"), grown).otherwise(F.col("context"))
        open_ = cut(met.select("query_id", "question", context.alias("context"), F.array_union("seen", F.transform("terms", F.lower)).alias("seen")))
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    return found
