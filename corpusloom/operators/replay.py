"""Conversations replayed turn by turn with a state that is carried from one to the next."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from corpusloom.shipping import ship


def replay(turns: DataFrame, start: Callable[[], Any], step: Callable[[Any, dict], tuple[Any, dict]], schema: str, setup: str | None = None) -> DataFrame:
    """(conv_id, turn, error, and the columns of `schema`) for the turns of turns(conv_id, turn, ...), taken in order.

    A conversation's state begins as start() and goes through step(state, row),
    which returns the next state and the turn's columns.  Where `setup` names a
    boolean column, turns that have it only bring the state forward.  If a step
    raises, the error is that turn's row, and the conversation's later turns are
    left out; others go on.  Turns of equal number are taken in the order of their
    other columns; rows without a conv_id are left out.

    A conversation lies in one task, which reads it row by row and holds its state
    alone, so its length needs no memory; but one conversation is one task's work.
    """
    ship(turns.sparkSession)
    others = sorted(c for c in turns.columns if c not in ("conv_id", "turn"))
    plain = [c for c in others if not dict(turns.dtypes)[c].startswith("map")]
    ordered = turns.select("conv_id", "turn", *others).filter("conv_id is not null").repartition("conv_id").sortWithinPartitions("conv_id", "turn", *plain)
    fields: StructType = _parse_datatype_string(schema)
    kinds = dict(turns.dtypes)
    whole = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, error string, {schema}"
    arrow = to_arrow_schema(_parse_datatype_string(whole))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, broken = None, None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["conv_id"] != conv:
                    conv, state, broken = row["conv_id"], start(), False
                if broken:
                    continue
                try:
                    state, made = step(state, row)
                    error = None
                except Exception as e:
                    made, error, broken = {}, str(e) or type(e).__name__, True
                if error is not None or setup is None or not row[setup]:
                    out.append({"conv_id": conv, "turn": row["turn"], "error": error, **{n: made.get(n) for n in names}})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return ordered.mapInArrow(run, whole)


def with_setup(items: DataFrame) -> DataFrame:
    """items(id, setup array<string>, question) as turns(conv_id, turn, text, setup): an item's setup in order, then its question."""
    before = items.select("id", F.posexplode("setup").alias("turn", "text")).select(F.col("id").alias("conv_id"), "turn", "text", F.lit(True).alias("setup"))
    own = items.select(F.col("id").alias("conv_id"), F.greatest(F.coalesce(F.size("setup"), F.lit(0)), F.lit(0)).alias("turn"), F.col("question").alias("text"), F.lit(False).alias("setup"))
    return before.unionByName(own)
