"""Turns of conversations: windows, prefixes, ownership, follow-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions import patterns as P


def last_turns(rows: DataFrame, n: int) -> DataFrame:
    """The last n rows of each conversation."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return rows.withColumn("from_end", F.row_number().over(order)).filter(F.col("from_end") <= n)


def prefix_lines(rows: DataFrame, n: int) -> DataFrame:
    """Each turn with the rendered lines of the n turns before it."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    name = F.when(F.col("role") == "user", "User").when(F.col("role") == "assistant", "Assistant").otherwise("System")
    return rows.withColumn("line", F.concat(name, F.lit(": "), "text")).withColumn("history", F.array_join(F.collect_list("line").over(before), "\n"))


def is_followup(question: Column, history: Column) -> Column:
    """Whether a question leans on earlier turns: a pronoun, an opener, or few words and no name; never without history."""
    low = F.lower(F.trim(question))
    words = F.regexp_extract_all(low, F.lit("[a-z']+"), 0)
    opener = F.lit(False)
    for o in P.OPENERS:
        opener = opener | low.contains(o)
    named = question.rlike(r"(?:^|[^A-Za-z0-9_])[A-Z][A-Za-z0-9-]+")
    leans = F.arrays_overlap(words, F.array(*map(F.lit, P.PRONOUNS))) | opener | ((F.size(words) <= 6) & ~named)
    return (F.size(words) > 0) & (F.trim(history) != "") & leans


def conversation_state(messages: DataFrame) -> DataFrame:
    """(conv_id, messages, updated, last_role, last_text) of messages(conv_id, turn, role, text); aggregates alone, so a batch can be merged by applying it to state and batch."""
    last = F.max_by(F.struct("role", "text"), "turn")
    return messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("updated"), last.alias("last")).select("conv_id", "messages", "updated", F.col("last.role").alias("last_role"), F.col("last.text").alias("last_text"))


def cached_answers(asked: DataFrame, version: int, capacity: int) -> DataFrame:
    """(question, version, uses, used) that a cache of `capacity` holds: grounded answers of this version, those used last; found by a partial top-k."""
    keys = asked.filter(F.col("grounded") & (F.col("version") == version)).groupBy("question", "version").agg(F.max("used").alias("used"), F.count("*").alias("uses"))
    return keys.orderBy(F.desc("used"), "question").limit(capacity)
