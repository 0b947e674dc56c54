"""Replays against a plain loop."""

from corpusloom.operators.replay import replay, with_setup
from corpusloom.plans import conversation_queries as Q


def found(frame, **how):
    def step(state, row):  # not of this module, which workers don't have
        if row["text"] == "fail":
            raise ValueError("no answer")
        state = [*state, row["text"]]
        return state, {"seen": len(state), "first": state[0]}

    return sorted(map(tuple, replay(frame, list, step, "seen long, first string", **how).collect()), key=repr)


def test_turns_in_order_errors_and_odd_rows(spark):
    rows = [(c, t, f"{c}-{t}") for c in range(30) for t in range(c % 5 + 1)] + [(100, 1, "fail"), (100, 0, "ok"), (100, 2, "left out"), (None, 0, "x"), (101, None, "first"), (101, 0, None), (102, 0, "b"), (102, 0, "a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, text string").repartition(5)
    expected = [(c, t, None, t + 1, f"{c}-0") for c in range(30) for t in range(c % 5 + 1)]
    expected += [(100, 0, None, 1, "ok"), (100, 1, "no answer", None, None), (101, None, None, 1, "first"), (101, 0, None, 2, "first"), (102, 0, None, 1, "a"), (102, 0, None, 2, "a")]
    assert found(frame) == sorted(expected, key=repr)
    assert found(frame.limit(0)) == []


def test_setup_turns_only_bring_the_state_forward(spark):
    items = [(1, ["a", "b"], "c"), (2, [], "d"), (3, None, "e"), (4, ["fail", "x"], "f")]
    turns = with_setup(spark.createDataFrame(items, "id long, setup array<string>, question string"))
    assert found(turns, setup="setup") == sorted([(1, 2, None, 3, "a"), (2, 0, None, 1, "d"), (3, 0, None, 1, "e"), (4, 0, "no answer", None, None)], key=repr)


def test_a_very_long_conversation(spark):
    from pyspark.sql import functions as F

    rows = spark.range(50_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("x").alias("text"))
    count = lambda state, row: (state + 1, {"n": state + 1})
    assert replay(rows, int, count, "n long").selectExpr("max(n)", "count(*)", "bool_and(n = turn + 1)").first()[:] == (50_000, 50_000, True)


def test_query_equals_a_plain_loop(spark):
    sf = "/root/testdata/sf0.001"
    flags = {(r.conv_id, r.turn): bool(r.followup) for r in Q.followup_detect(spark, sf).collect()}
    expected, last, said = {}, {}, {}
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        c, text, said[r.conv_id] = r.conv_id, r.text or "", said.get(r.conv_id, 0) + 1
        expected[c, r.turn] = (f"{last.get(c, '')} {text}".strip(" ") if flags[c, r.turn] else text, said[c])
        last[c] = last.get(c, "") if flags[c, r.turn] else text
    assert {(r.conv_id, r.turn): (r.search, r.said) for r in Q.turn_replay(spark, sf).collect()} == expected
