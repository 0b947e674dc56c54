"""Keyed state with timers: sessions renewed by each write, and lockouts after strikes in a rolling window.

A stream's rows arrive in any order.  A key's rows are therefore held until the
watermark has passed their time, and then taken in the order of time; later rows
would be dropped by Spark as late, so what a key has seen up to the watermark is
final, and the result equals that of a replay of the whole table.  State is a key's
rows that the watermark has not passed, and what the operator itself keeps: a
session's last turns, or the times of a window with a count each.

Functions take a batch table as well as a stream: a table is replayed by windows,
with ``until`` in the part of the watermark.  Rows with a null key or time, and
strikes without an id, take no part.  Keyed state needs the RocksDB state store, which ``run_stream`` sets.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusloom.session import fresh_dir
from corpusloom.shipping import ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Hands a key's rows, as tuples that begin with time (microseconds) and number, to `advance` in their order once they are final."""

    held_schema: str
    fields: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.held_schema)

    def advance(self, key: tuple, rows: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        """rows are final and in order; now is the watermark in microseconds."""
        raise NotImplementedError

    def wake(self, at: int) -> None:
        """A timer for when the watermark has reached `at` (microseconds)."""
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            new = [tuple(None if x is pd.NA or x != x else x for x in r) for r in frame[self.fields].itertuples(index=False)]
            if new:
                self.held.appendList(new)
                least = min(r[0] for r in new)
                first = least if first is None else min(first, least)
        if first is not None:
            self.wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        ready, rest = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        if ready:
            if rest:
                self.held.put(rest)
                self.wake(min(r[0] for r in rest))
            else:
                self.held.clear()
        yield from self.advance(key, sorted(ready, key=lambda r: tuple((x is not None, x) for x in r)), now)

    def close(self) -> None:
        pass


class Lockout(InOrder):
    """Rows (t, id, strike): how many strikes of the key lie in the window that ends with each row, itself included."""

    held_schema = "t long, id long, strike boolean"
    fields = ["t", "id", "strike"]

    def __init__(self, key_name: str, window: int, threshold: int):
        self.key_name, self.window, self.threshold = key_name, window, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.times = handle.getListState("times", "t long, n long")

    def advance(self, key, rows, now):
        if not rows:
            return
        times = deque(tuple(r) for r in self.times.get()) if self.times.exists() else deque()
        total, out = sum(n for _, n in times), []
        for t, same in groupby(rows, key=lambda r: r[0]):
            same = list(same)
            strikes = sum(bool(r[2]) for r in same)
            while times and times[0][0] < t - self.window:
                total -= times.popleft()[1]
            if strikes:
                times.append((t, strikes))
                total += strikes
            out += [(key[0], r[1], total, total >= self.threshold) for r in same]
        if times:
            self.times.put(list(times))
        else:
            self.times.clear()
        yield pd.DataFrame(out, columns=[self.key_name, "id", "n", "locked"])


class Renewed(InOrder):
    """Rows (t, seq, op, role, text): a key's session ends `ttl` after its last write, or when it is cleared."""

    held_schema = "t long, seq long, op string, role string, text string"
    fields = ["t", "seq", "op", "role", "text"]
    columns = ["start", "ended", "reason", "writes", "summary", "turns"]

    def __init__(self, key_name: str, ttl: int, keep: int):
        self.key_name, self.ttl, self.keep = key_name, ttl, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.session = handle.getValueState("session", "start long, last long, writes long, summary string")
        self.turns = handle.getListState("turns", "role string, text string")

    def advance(self, key, rows, now):
        open_ = tuple(self.session.get()) if self.session.exists() else None
        turns = [tuple(r) for r in self.turns.get()] if self.turns.exists() else []
        out = []

        def close(ended: int, reason: str) -> None:
            start, _, writes, summary = open_
            out.append((key[0], start, ended, reason, writes, summary, [{"role": a, "text": b} for a, b in turns]))

        for t, _, op, role, text in rows:
            if open_ and t >= open_[1] + self.ttl:
                close(open_[1] + self.ttl, "expired")
                open_, turns = None, []
            if op == "clear":
                if open_:
                    close(t, "cleared")
                open_, turns = None, []
                continue
            start, _, writes, summary = open_ or (t, t, 0, None)
            if op == "summary":
                open_ = (start, t, writes, text)
            else:
                open_, turns = (start, t, writes + 1, summary), (turns + [(role, text)])[-self.keep :]
        if open_ and now >= open_[1] + self.ttl:
            close(open_[1] + self.ttl, "expired")
            open_, turns = None, []
        if open_:
            self.session.update(open_)
            self.wake(open_[1] + self.ttl)
        else:
            self.session.clear()
        if turns:
            self.turns.put(turns)
        else:
            self.turns.clear()
        if out:
            yield pd.DataFrame(out, columns=[self.key_name, *self.columns])


def _sound(rows: DataFrame, key: str) -> DataFrame:
    return rows.filter(F.col(key).isNotNull() & F.col("ts").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp"))


def _keyed(rows: DataFrame, key: str, fields: list[Column], processor: StatefulProcessor, schema: str, late: str) -> DataFrame:
    ship(rows.sparkSession)
    marked = rows.withWatermark("ts", late)
    grouped = marked.select(F.col(key), "ts", *fields).groupBy(key)
    return grouped.transformWithStateInPandas(processor, f"{key} {dict(rows.dtypes)[key]}, {schema}", "Append", "EventTime")


def lockouts(rows: DataFrame, key: str, window: int, threshold: int, late: str | None = None, until: Column | None = None) -> DataFrame:
    """(key, id, n, locked) of rows(key, ts, id, strike): strikes of the key in the `window` seconds up to each row, and whether they reach the threshold.

    A stream needs `late`, its allowed lateness; of a table, rows up to `until` take part.
    """
    rows = _sound(rows, key).filter("id is not null").withColumn("strike", F.coalesce("strike", F.lit(False)))
    micros = F.unix_micros("ts")
    if rows.isStreaming:
        fields = [micros.alias("t"), F.col("id").cast("long").alias("id"), F.col("strike")]
        return _keyed(rows, key, fields, Lockout(key, window * 1_000_000, threshold), "id long, n long, locked boolean", late or "0 seconds")
    if until is not None:
        rows = rows.filter(F.col("ts") <= until)
    back = Window.partitionBy(key).orderBy(micros).rangeBetween(-window * 1_000_000, 0)
    return rows.withColumn("n", F.sum(F.col("strike").cast("long")).over(back)).select(key, F.col("id").cast("long").alias("id"), "n", (F.col("n") >= threshold).alias("locked"))


def renewed_sessions(rows: DataFrame, key: str, ttl: int, keep: int, late: str | None = None, until: Column | None = None) -> DataFrame:
    """(key, start, ended, reason, writes, summary, turns) of the ended sessions of rows(key, ts, seq, op, role, text).

    A write (`append` or `summary`) opens a session or renews it for `ttl` seconds;
    `clear` ends it at once.  writes counts appends, turns are the last `keep` of
    them.  Times of a session are microseconds.  Of a table, rows up to `until`
    (its last time, if none is given) take part, and sessions that have ended by
    then come out, as a stream's do by its watermark.
    """
    rows, micros = _sound(rows, key), F.unix_micros("ts")
    fields = [micros.alias("t"), F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), F.col("op"), F.col("role"), F.col("text")]
    width = ttl * 1_000_000
    if rows.isStreaming:
        schema = "start long, ended long, reason string, writes long, summary string, turns array<struct<role string, text string>>"
        return _keyed(rows, key, fields, Renewed(key, width, keep), schema, late or "0 seconds")
    if until is None:
        last = rows.agg(F.max("ts").alias("until"))
        rows = rows.join(F.broadcast(last), F.col("ts") <= F.col("until"))  # one row
    else:
        rows = rows.filter(F.col("ts") <= until).withColumn("until", until)
    rows = rows.select(key, *fields, F.unix_micros("until").alias("until"))
    order = Window.partitionBy(key).orderBy("t", "seq", "op", "role", "text")
    before, cleared = F.lag("t").over(order), F.lag("op").over(order) == "clear"
    numbered = rows.withColumn("fresh", F.when(before.isNull() | cleared | (F.col("t") - before >= width), 1).otherwise(0)).withColumn("session", F.sum("fresh").over(order))
    whole = [key, "session"]
    back = Window.partitionBy(*whole).orderBy(F.desc(F.col("op") == "append"), F.desc("t"), F.desc("seq"), F.desc("role"), F.desc("text"))
    placed = numbered.withColumn("at", F.row_number().over(back))
    append, at = F.col("op") == "append", F.struct("t", "seq", "role", "text")
    kept = F.array_sort(F.collect_list(F.when(append & (F.col("at") <= keep), F.struct(-F.col("at"), "role", "text"))))  # `keep` a session
    met = placed.groupBy(*whole).agg(
        F.min("t").alias("start"), F.max("t").alias("last"), F.max(F.col("op") == "clear").alias("cleared"), F.max("until").alias("until"),
        F.sum(append.cast("long")).alias("writes"), F.count(F.when(F.col("op") != "clear", 1)).alias("some"),
        F.max_by("text", F.when(F.col("op") == "summary", at)).alias("summary"), F.transform(kept, lambda x: F.struct(x["role"], x["text"])).alias("turns"),
    )
    ended = F.when(F.col("cleared"), F.col("last")).otherwise(F.col("last") + width)
    found = met.filter("some > 0").withColumn("ended", ended).filter(F.col("ended") <= F.col("until"))
    return found.select(key, "start", "ended", F.when(F.col("cleared"), "cleared").otherwise("expired").alias("reason"), "writes", "summary", "turns")


def run_stream(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all that is there now and return what it wrote; with the same path and checkpoint it goes on where it ended."""
    spark: SparkSession = stream.sparkSession
    path = path or fresh_dir(spark, "stream")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        running = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint or f"{path}-checkpoint").trigger(availableNow=True).start(path)
        running.awaitTermination()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    return spark.read.schema(stream.schema).parquet(path)
