"""Deletes of what the index does not hold."""

import pytest

from corpusloom.llm.line_dedup import LineIndex, LineSpec

LONG = "a line that is long enough to have a key"
TYPE = "doc_id long, text string"


def held(index):
    return sorted((bytes(r.key), r.doc_id, r.n) for r in index.references().collect()), sorted((bytes(r.key), r.n_docs, r.max_doc) for r in index.repeated().collect())


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, LONG) for i in range(4)] + [(9, LONG + "\n" + LONG.upper())], TYPE)


def test_a_delete_before_any_insert_changes_nothing(spark, docs):
    index = LineIndex(spark).delete(docs)
    assert held(index) == ([], []) and index.repeated().count() == 0
    assert held(index.insert(docs)) == held(LineIndex(spark).insert(docs))


def test_a_delete_of_what_was_never_inserted_changes_nothing(spark, docs):
    index = LineIndex(spark).insert(docs)
    before = held(index)
    other = spark.createDataFrame([(1, "another line that is long enough"), (77, LONG), (None, LONG)], TYPE)
    assert held(index.delete(other)) == before and held(index.compact()) == before
    assert index.apply(docs).filter("n_dropped > 0").count() == 4


def test_a_second_delete_of_the_same_rows_changes_nothing(spark, docs):
    index = LineIndex(spark, spec=LineSpec(compact_after=2)).insert(docs)
    gone = docs.filter("doc_id < 3")
    once = held(index.delete(gone))
    assert held(index.delete(gone)) == once and held(index.delete(gone)) == once
    assert once[1] == [] and held(index.insert(gone)) == held(LineIndex(spark).insert(docs))
