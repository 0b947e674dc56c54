"""A turn's parent holds the whole text of each sibling."""

import hashlib

from corpusloom.operators.retrieval import parents
from corpusloom.plans.catalogue import ENTRIES


def test_parents_are_whole(spark):
    rows = [(1, 2, "b" * 500), (1, 10, "é" * 30 + "end"), (1, 1, "first twenty letters and then more"), (2, 1, None), (3, 1, ""), (3, 2, None)]
    found = {r["conv_id"]: tuple(r)[1:] for r in parents(spark.createDataFrame(rows, "conv_id long, turn int, text string").repartition(3)).collect()}
    text = {1: f"1:{rows[2][2]}\n2:{rows[0][2]}\n10:{rows[1][2]}", 2: "", 3: "1:"}
    assert found == {c: (hashlib.sha256(t.encode()).hexdigest(), len(t), n) for (c, t), n in zip(text.items(), [3, 1, 2], strict=True)}


def test_query_reaches_every_character(spark):
    sf = "/root/testdata/sf0.01"
    turns = spark.read.parquet(f"{sf}/conversations.parquet").toPandas()
    found = ENTRIES["parent_expand_whole"].build(spark, sf).toPandas()
    want = {c: sum(len(f"{t}:{x}") for t, x in zip(g["turn"], g["text"], strict=True)) + len(g) - 1 for c, g in turns.groupby("conv_id")}
    assert len(found) == len(turns) and all(want[c] == n for c, n in zip(found["conv_id"], found["parent_chars"], strict=True))
