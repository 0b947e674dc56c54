"""Verbatim fragments of many queries met by texts in one pass.

The distinct fragments, in the form without white space and case, go into automata
that find all of them while a text is read once.  An automaton holds what fits in
about ``block`` characters, so any number of fragments takes as many passes as it
needs, and memory stays bounded.  Only the first ``anchor`` characters of a long
fragment are in the automaton; the rest is compared where they are met.  A task
keeps a fragment's first k texts by id, so one that stands in every text sends no
more than that.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.functions import text as X
from corpusloom.session import cut
from corpusloom.shipping import ship


def fragment_hits(queries: DataFrame, docs: DataFrame, k: int, block: int = 4_000_000, anchor: int = 64) -> DataFrame:
    """(query_id, doc_id, rank): the first k docs(doc_id, text) by id that hold one of a query's queries(query_id, fragment), white space and case aside.

    Fragments of fewer than two characters, and null ids, fragments or texts, meet
    nothing; repeated rows count once.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    asked = queries.filter("query_id is not null").select("query_id", X.match_form(F.col("fragment")).alias("form")).filter(F.char_length("form") >= 2).distinct()
    asked = cut(asked)
    forms = asked.select("form").distinct()
    size = forms.agg(F.coalesce(F.sum(F.char_length("form")), F.lit(0))).first()[0]
    blocks = -(-size // block)
    texts = docs.filter("doc_id is not null and text is not null").select("doc_id", X.match_form(F.col("text")).alias("form"))
    found = spark.createDataFrame([], f"doc_id {kind}, form string")
    ship(spark)
    for b in range(blocks):
        own = forms.filter(F.pmod(F.xxhash64("form"), F.lit(blocks)) == b).toArrow().column("form").to_pylist()  # about `block` characters
        found = found.unionByName(_met(texts, own, k, anchor, f"doc_id {kind}, form string"))
    order = Window.partitionBy("query_id").orderBy("doc_id")
    met = asked.join(found, "form").select("query_id", "doc_id").distinct()
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _met(texts: DataFrame, forms: list[str], k: int, anchor: int, schema: str) -> DataFrame:
    """(doc_id, form) of the forms that texts(doc_id, form) hold, each task's first k texts of each."""
    sent = texts.sparkSession.sparkContext.broadcast(sorted(forms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        all_, whole, ids = sent.value, ahocorasick.Automaton(), None
        heads: dict[str, list[int]] = {}
        for i, form in enumerate(all_):
            heads.setdefault(form[:anchor], []).append(i)
        for head, members in heads.items():
            whole.add_word(head, (len(head), members))
        if all_:
            whole.make_automaton()
        first: dict[int, list] = {}
        for batch in batches:
            ids = batch.column(0).type
            for doc, form in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = set()
                for end, (length, members) in whole.iter(form) if all_ else ():
                    held.update(i for i in members if i not in held and (len(all_[i]) <= length or form.startswith(all_[i], end - length + 1)))
                for i in held:
                    own = first.setdefault(i, [])
                    own.append(doc)
                    if len(own) >= 4 * k + 16:
                        first[i] = nsmallest(k, set(own))
        pairs = [(doc, all_[i]) for i, own in first.items() for doc in nsmallest(k, set(own))]
        for at in range(0, len(pairs), 10_000):
            part = pairs[at : at + 10_000]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in part], ids), "form": [f for _, f in part]})

    return texts.mapInArrow(run, schema)
