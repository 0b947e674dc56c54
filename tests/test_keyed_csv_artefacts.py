"""Tables of unique keys, CSV files as documents, artefacts named by their inputs."""

import os
import pathlib
import tempfile

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.graph import merged_entities
from corpusloom.sources.artefacts import artefact, seeds, table_print
from corpusloom.sources.csv_files import csv_documents
from corpusloom.sources.keyed import KeyedTable

SCHEMA = "key string, name string, type string, seq long, aliases array<string>"


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def files(base):
    return {str(p.relative_to(base)): p.stat().st_mtime_ns for p in pathlib.Path(base, "data").rglob("*") if p.is_file()}


def entities(spark, ids, seq=0):
    return spark.createDataFrame([(f"k{i}", f"n{i}-{seq}", "T", seq, [f"n{i}-{seq}"]) for i in ids], SCHEMA)


def state(table):
    return sorted(map(repr, table.rows().collect()))


def test_merges_touch_changed_buckets_alone(spark):
    base = folder()
    table = KeyedTable(spark, "file://" + base, SCHEMA, ["key"], 8)
    assert table.merge(entities(spark, range(100)), merged_entities) == list(range(8))
    first, before = state(table), files(base)
    assert table.merge(entities(spark, range(100)), merged_entities) == [] and (state(table), files(base)) == (first, before)  # the same again
    changed = table.merge(entities(spark, [3, 1000], 5), merged_entities)
    after, places = files(base), table.manifest()
    assert 1 <= len(changed) <= 2 and {k: after[k] for k in before} == before
    assert {b for b, v in places.items() if v == 2} == set(changed) and {b for b, v in places.items() if v == 1} == set(range(8)) - set(changed)
    assert table.rows().count() == 101 and table.merge(entities(spark, [3, 1000], 5), merged_entities) == []
    row = table.lookup(spark.createDataFrame([("k3",)], "key string")).first()
    assert (row.name, row.seq, row.aliases) == ("n3-0", 0, ["n3-0", "n3-5"])
    table.check()


def test_a_lookup_reads_only_its_buckets(spark):
    base = folder()
    table = KeyedTable(spark, "file://" + base, SCHEMA, ["key"], 8)
    table.merge(entities(spark, range(50)), merged_entities)
    wanted = spark.createDataFrame([("k7",)], "key string")
    own = wanted.select(table._bucket()).first().bucket
    for p in pathlib.Path(base).glob("data/version=1/bucket=*"):
        if p.name != f"bucket={own}":
            for f in p.iterdir():
                f.write_bytes(b"broken")
    assert table.lookup(wanted).first().name == "n7-0"


def test_a_key_cannot_stand_twice(spark):
    base = folder()
    table = KeyedTable(spark, "file://" + base, SCHEMA, ["key"], 4)
    table.merge(entities(spark, range(5)), merged_entities)
    before = files(base), state(table)
    with pytest.raises(ValueError, match="more than once"):
        table.merge(entities(spark, [1], 9), lambda rows: rows)
    assert (files(base), state(table)) == before
    assert table.merge(spark.createDataFrame([(None, "x", "T", 1, ["x"])], SCHEMA), merged_entities) == [] and table.merge(entities(spark, []), merged_entities) == []
    gone = table.merge(entities(spark, [2], 3), lambda rows: rows.filter("key <> 'k2'"))  # a merge can also take rows out
    assert gone and {r.key for r in table.rows().collect()} == {"k0", "k1", "k3", "k4"}


def test_csv_rows_and_what_is_wrong(spark):
    base = pathlib.Path(folder())
    (base / "sub").mkdir()
    put = {
        "good.csv": b"\xef\xbb\xbfname,note\r\nA,\"says \"\"hi\"\", twice\"\r\n\r\nB,\"two\nlines\"\r\nC,\r\n",
        "sub/ragged.CSV": b"a,b\n1\n1,2,3\n4,5\n",
        "broken.csv": b"a,b\n1,2\n3,\"never closed\n4,5\n",
        "latin.csv": "a\nü\n".encode("latin-1"),
        "empty.csv": b"",
        "large.csv": b"a\n" + b"x\n" * 500,
        "note.txt": b"a,b\n1,2\n",
    }
    for name, content in put.items():
        (base / name).write_bytes(content)
    os.chmod(base / "large.csv", 0o000)  # never opened, or root reads it all the same
    got = sorted((pathlib.Path(r.path).name, r.row, r.text, r.error) for r in csv_documents(spark, f"file://{base}", most_bytes=900).collect())
    by = {n: [x[1:] for x in got if x[0] == n] for n in {x[0] for x in got}}
    assert by["good.csv"] == [(1, 'name: A\nnote: says "hi", twice', None), (2, "name: B\nnote: two\nlines", None), (3, "name: C", None)]
    assert by["ragged.CSV"] == [(1, "a: 1", "1 cells, not 2"), (2, "a: 1\nb: 2\ncolumn 3: 3", "3 cells, not 2"), (3, "a: 4\nb: 5", None)]
    assert by["broken.csv"][0][:2] == (0, None) and "end of data" in by["broken.csv"][0][2] and by["broken.csv"][1:] == [(1, "a: 1\nb: 2", None)]
    assert by["latin.csv"] == [(0, None, "not UTF-8 at byte 2")] and by["empty.csv"] == [(0, None, "empty")]
    assert by["large.csv"] == [(0, None, "1002 bytes, over 900")] and "note.txt" not in by


def test_artefacts_are_computed_once(spark):
    base, calls = "file://" + folder(), []

    def compute():
        calls.append(1)
        return spark.range(3)

    for inputs in (["a", ["x", "y"]], ["a", ["x", "y"]], ["a", ["x", "z"]], ["a", ["x", "y"]]):
        assert artefact(spark, base, "t", inputs, compute).count() == 3
    assert len(calls) == 2


def test_seed_files(spark):
    base = folder()
    path = pathlib.Path(base, "seeds.txt")
    assert seeds(spark, None, ["d"]) == ["d"] and seeds(spark, f"file://{path}", ["d"]) == ["d"]
    path.write_text("# note\n\n  rain over land \nwind\n")
    first = seeds(spark, f"file://{path}", ["d"])
    assert first == ["rain over land", "wind"]
    calls = []
    make = lambda: (calls.append(1), spark.range(1))[1]
    for text in ("# note\nrain over land\nwind\n", "rain over land\nwind\n", "rain\n"):
        path.write_text(text)
        artefact(spark, "file://" + base, "centroid", seeds(spark, f"file://{path}", ["d"]), make).count()
    assert len(calls) == 2  # a changed comment is no change, a changed phrase is
    path.write_text("# nothing\n")
    assert seeds(spark, f"file://{path}", ["d"]) == ["d"]


def test_table_prints_follow_rows_not_their_order(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "i long, t string")
    assert table_print(rows) == table_print(rows.orderBy(F.desc("i"))) != table_print(rows.distinct())
    assert table_print(rows.limit(0)).startswith("0-")
