"""The whole graph chain on small graphs."""

from corpusloom.operators.graph import answer_context

EDGES = "src string, name string, dst string"
CHUNKS = "node string, chunk long, line string, weight double"


def test_a_star_keeps_each_part_small(spark):
    edges = spark.createDataFrame([(f"Leaf{i:03d}", "PART_OF", "Hub") for i in range(200)] + [("Far", "NEAR", "Leaf007")], EDGES)
    chunks = spark.createDataFrame([("Hub", i, f"line {i}", float(i % 50)) for i in range(300)] + [("Far", 1000, "far", 99.0)], CHUNKS)
    asked = spark.createDataFrame([(1, "What is near Hub, as Far is?"), (2, "nothing"), (3, None)], "question long, t string")
    rows = {r.question: r for r in answer_context(asked, edges, chunks).collect()}
    assert rows[2][1:] == ("", "", "", "") and rows[3][1:] == ("", "", "", "")
    one = rows[1]
    assert one.seeds == "Far\nHub" and one.communities == "Hub"
    facts = one.facts.split("\n")
    assert len(facts) == 8 and facts[0] == "Far NEAR Leaf007" and all("PART_OF" in f for f in facts[2:])
    assert one.evidence == "far\nline 49\nline 99"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "question long, t string")
    edges, chunks = spark.createDataFrame([], EDGES), spark.createDataFrame([], CHUNKS)
    assert answer_context(none, edges, chunks).count() == 0
    got = answer_context(spark.createDataFrame([(1, "Hub")], "question long, t string"), edges, chunks).collect()
    assert [tuple(r) for r in got] == [(1, "", "", "", "")]
