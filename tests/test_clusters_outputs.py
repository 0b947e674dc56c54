"""Greedy entity clusters against the plain loop, evaluation outputs, line numbers of golden files."""

import json

import numpy as np
import pytest

from corpusloom.operators import evaluation as E, graph as G
from corpusloom.sources import files


@pytest.mark.parametrize(("least", "block"), [(0.92, 2000), (0.92, 3), (0.6, 5)])
def test_clusters_against_the_plain_loop(spark, least, block):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(6, 8))
    rows = [(k, int(rnd.integers(2)), (centres[rnd.integers(6)] + rnd.normal(scale=0.25, size=8)).tolist()) for k in range(60)]
    rows += [(60, 0, None), (61, None, centres[0].tolist()), (62, 1, [0.0] * 8)]
    leaders, want = [], {}
    for i, kind, v in rows:
        x = np.array(v) if v is not None and kind is not None else None
        found = None
        for j, other, w in leaders:
            if x is not None and other == kind and round(float(x @ w / ((x @ x) ** 0.5 * (w @ w) ** 0.5 or 1)), 6) >= least:
                found = j
                break
        want[i] = i if found is None else found
        if found is None and x is not None:
            leaders.append((i, kind, x))
    frame = spark.createDataFrame(rows, "id long, type int, v array<double>").repartition(4)
    assert {r["id"]: r["leader"] for r in G.entity_clusters(frame, least, block).collect()} == want
    assert len(set(want.values())) < 60
    assert G.entity_clusters(frame.limit(0), least, block).count() == 0


def test_outputs_and_manifest(spark, tmp_path):
    samples = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    results = E.scorecard(spark.createDataFrame([("faithfulness", 0.95)], "metric string, value double"))
    manifest = E.run_manifest(samples, {"k": 5, "floor": 0.2})
    assert manifest == E.run_manifest(samples.orderBy("doc_id", ascending=False).repartition(3), {"floor": 0.2, "k": 5})
    assert manifest["corpus"] != E.run_manifest(samples.limit(1), {})["corpus"]
    E.write_outputs(samples, results, ["en"], manifest, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/samples")).count() == 2
    assert json.loads("\n".join(r["value"] for r in spark.read.text(str(tmp_path / "out/manifest")).collect())) == manifest
    assert any("NO-GO" in r["value"] for r in spark.read.text(str(tmp_path / "out/gate")).collect())


def test_hit_rate(spark):
    rows = spark.createDataFrame([(1, ["Alpha", "beta", ""], "ALPHA only"), (2, [], "x"), (3, None, None), (4, ["a"], None)], "id int, e array<string>, c string")
    assert {r["id"]: r["hit_rate"] for r in E.retrieval_hit_rate(rows, "e", "c").collect()} == {1: 0.5, 2: 1.0, 3: 1.0, 4: 0.0}


def test_bad_golden_line_is_named(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('// note\n\n{"id": "1"}\nnot json\n')
    with pytest.raises(Exception, match=r"g\.jsonl:4: not json"):
        files.golden_items(spark, str(tmp_path / "g.jsonl")).collect()
