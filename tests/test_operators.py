"""Single operators on small inputs of our own."""

import datetime as dt

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import ontology as O, text as X
from corpusloom.operators import chunking, embedding, evaluation, graph, guard, incremental, retrieval, similarity
from corpusloom.streaming import streams


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column.alias("x")).first()["x"]


def test_tokens_keep_symbols(spark):
    assert one(spark, X.tokens(F.col("t")), t=r"The \sigma^0 is 5.6, ok?") == ["the", "sigma", "^", "0", "is", "5.6", "ok"]


def test_quality_reasons(spark):
    cases = {"": "short", "word " * 40: "unique", "─" * 80: "alphanumeric", "�" * 80: "encoding", "Plain prose with many different words that say something about rain and rivers.": "ok"}
    for text, reason in cases.items():
        assert one(spark, X.quality_reason(F.col("t")), t=text) == reason


def test_math_is_exempt(spark):
    text = "$$" + "=+-*/^" * 30 + "$$ where each symbol means one thing or another quantity here"
    assert one(spark, X.quality_reason(F.col("t")), t=text) == "ok"


def test_clean_markdown_leaves_math(spark):
    assert one(spark, X.clean_markdown(F.col("t")), t="a  b $x  y$ hyphen-\nated\n\n\n\nend") == "a b $x  y$ hyphenated\n\nend"


def test_redaction_keeps_its_order(spark):
    assert one(spark, X.redact(F.col("t")), t="card 4111 1111 1111 1111") == "card <AADHAAR> 1111"
    assert one(spark, X.redact(F.col("t")), t="+91-9876543210 and a@b.org") == "<PHONE> and <EMAIL>"


@pytest.mark.parametrize(("surface", "key"), [("INSAT-3D", "insat3d"), ("the INSAT 3D satellite", "insat3d"), ("insat3d", "insat3d"), ("", "")])
def test_canonical_key(spark, surface, key):
    assert one(spark, O.canonical_key(F.col("t")), t=surface) == key


def test_quantities():
    found = {(q[0], q[3]): (q[4], q[5]) for q in O.quantities("The resolution is 1 km. Revisit after 2 days.\nNo property 7")}
    assert found == {("spatial_resolution", "1 km"): (1000.0, "m"), ("temporal_resolution", "2 days"): (172800.0, "s")}
    assert O.quantities("page 4") == [] and O.quantities(None) == []


def test_salvage_takes_complete_triples():
    assert O.salvage_triples('x {"triples":[{"subject":"A","object":"B"},{"subject":"C"') == ['{"object": "B", "subject": "A"}']
    assert O.salvage_triples("") == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=300), st.integers(20, 80))
def test_splitter_bounds_pieces_and_loses_no_word(text, size):
    pieces = chunking.split_text(text, size, 5)
    assert all(len(p) <= size for p in pieces)
    assert not (set("".join(text.split())) - set("".join(pieces)))


def test_fixed_windows(spark):
    found = chunking.fixed_windows(spark.createDataFrame([(1, "x" * 1500), (2, "")], "doc_id long, text string"), "text", 800, 100).orderBy("doc_id", "idx").collect()
    assert [(r["doc_id"], r["idx"], len(r["chunk"])) for r in found] == [(1, 0, 800), (1, 1, 800), (1, 2, 100), (2, 0, 0)]


def test_fusion_does_not_depend_on_order(spark):
    hits = [(1, "v", 10, 1, 0.6), (1, "k", 10, 2, 0.9), (1, "v", 11, 2, 0.3)]
    schema = "query_id int, channel string, doc_id int, rank int, relevance double"
    a = retrieval.reciprocal_rank_fusion(spark.createDataFrame(hits, schema), 5).collect()
    b = retrieval.reciprocal_rank_fusion(spark.createDataFrame(hits[::-1], schema), 5).collect()
    assert sorted(a) == sorted(b) and a[0]["doc_id"] == 10 and a[0]["relevance"] == 0.9


def test_exact_hits_come_first_once(spark):
    exact = spark.createDataFrame([(1, 7, 1)], "query_id int, doc_id int, rank int")
    ranked = spark.createDataFrame([(1, 5, 1), (1, 7, 2)], "query_id int, doc_id int, rank int")
    assert [(r["doc_id"], r["exact"]) for r in retrieval.exact_first(exact, ranked).orderBy("rank").collect()] == [(7, True), (5, False)]


def test_nearest_in_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 3), float(i % 5), 1.0]) for i in range(40)], "vec_id long, v array<float>")
    queries = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    whole = sorted(similarity.nearest(queries, vectors, 3).collect())
    assert len(similarity.query_blocks(queries, "query_id", 1)) == 2
    monkeypatch.setattr(similarity.query_blocks, "__defaults__", (1,))
    assert sorted(similarity.nearest(queries, vectors, 3).collect()) == whole


def test_upsert_is_idempotent(spark):
    rows = spark.createDataFrame([("k", "A", "T", 1), ("k", "B", "U", 2)], "key string, name string, type string, seq int")
    once, twice = graph.upsert_entities(rows).collect(), graph.upsert_entities(rows.unionByName(rows)).collect()
    assert once == twice and once[0]["name"] == "A" and once[0]["aliases"] == ["A", "B"]


def test_paths_repeat_no_edge(spark):
    edges = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "a")], "src string, name string, dst string")
    found = graph.paths(spark.createDataFrame([("a",)], "seed string"), edges, 4, 50).collect()
    assert {r["length"] for r in found} == {1, 2, 3} and all(len(set(r["path"].split(" | "))) == r["length"] for r in found)


def test_allowlist_forms(spark):
    rows = spark.createDataFrame([("a/b.pdf",), ("x.txt",), ("other",)], "source string")
    keep = lambda xs: {r[0] for r in guard.allowed_sources(rows, "source", spark.createDataFrame([(x,) for x in xs], "allowed string")).collect()}
    assert keep(["b.pdf"]) == {"a/b.pdf"} and keep(["q/x.txt"]) == {"x.txt"} and keep(["other.md"]) == {"other"}
    assert keep([]) == {"a/b.pdf", "x.txt", "other"}


def test_normalize(spark):
    rows = spark.createDataFrame([("Ｆｕｌｌ​  w", 1)], "text string, id int")
    assert guard.normalize(rows, "text").first()["text"] == "Full w"


def test_new_rows_add_once(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, n int")
    known = spark.createDataFrame([("b",)], "k string")
    assert [tuple(r) for r in incremental.new_rows(rows, known, "k", F.col("n")).collect()] == [("a", 1)]


def test_bootstrap(spark):
    rows = spark.createDataFrame([("x", 0.5)] * 8 + [("y", 0.0), ("y", 1.0)] * 20, "k string, v double")
    found = {r["k"]: r for r in evaluation.bootstrap(rows, "k", "v").collect()}
    assert (found["x"]["lo"], found["x"]["hi"], found["x"]["n"]) == (0.5, 0.5, 8)
    assert 0.3 < found["y"]["lo"] < 0.5 < found["y"]["hi"] < 0.7


def test_stream_windows_match_batch(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, h, 10), h % 3, "view", float(h)) for h in range(12)]
    batch = spark.createDataFrame(rows, "ts timestamp, user_id int, event_type string, value double")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    running = streams.tumbling(stream, "3 hours", "1 hour").writeStream.format("memory").queryName("tumbled").outputMode("complete").start()
    running.processAllAvailable()
    running.stop()
    assert sorted(spark.table("tumbled").collect()) == sorted(streams.tumbling(batch, "3 hours").collect())


def test_replayed_batches_add_nothing(spark, tmp_path):
    src, known = str(tmp_path / "src"), str(tmp_path / "known")
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int").write.parquet(src)
    for run in range(2):
        stream = spark.readStream.schema("k string, n int").parquet(src)
        streams.anti_join_batches(stream, known, "k", str(tmp_path / f"check{run}")).awaitTermination()
    assert spark.read.parquet(known).count() == 2


def test_embedding_falls_back(spark):
    def model(texts):
        if "bad" in texts:
            raise ValueError
        return embedding.hashing_model(8)(texts)

    rows = spark.createDataFrame([(1, "a b"), (2, "bad"), (3, "a b"), (4, None)], "id int, t string").coalesce(1)
    found = {r["id"]: r["embedding"] for r in embedding.embed(rows, "id", "t", model).collect()}
    assert found[1] == found[3] and found[2] is None and found[4] == [0.0] * 8
    vectors = embedding.embed(rows, "id", "t", model)
    embedding.check_dimension(vectors, "embedding", 8)
    with pytest.raises(ValueError):
        embedding.check_dimension(vectors, "embedding", 9)


def test_gate_report(spark):
    green = spark.createDataFrame([(g[1], g[3]) for g in evaluation.GATES], "metric string, value double")
    assert evaluation.render_markdown(evaluation.scorecard(green), []).startswith("# Gate: GO")
    assert "NO-GO" in evaluation.render_markdown(evaluation.scorecard(green), ["single"])
    assert "NO-GO" in evaluation.render_markdown(evaluation.scorecard(green.filter("metric <> 'judge_kappa'")), [])


def test_judge_score(spark):
    cases = {"Score: 0.85 of 1": 0.85, "7": 1.0, "none": None, "": None}
    for text, value in cases.items():
        assert one(spark, evaluation.judge_score(F.col("t")), t=text) == value


def test_leader_clusters_are_greedy(spark):
    import random

    rnd = random.Random(4)
    pairs = sorted({(a, b) for a, b in ((rnd.randrange(40), rnd.randrange(40)) for _ in range(60)) if a < b})
    leaders, want = [], {}
    for i in range(40):
        want[i] = next((x for x in leaders if (x, i) in pairs), i)
        if want[i] == i:
            leaders.append(i)
    found = graph.leader_clusters(spark.range(40), spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["id"]: r["leader"] for r in found} == want
