"""Keyed state: stream and replay give equal rows; expiry, late rows, disorder and restart."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from corpusloom.streaming.stateful import lockouts, renewed_sessions, run_stream

START = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
STRIKES = "user string, ts timestamp, id long, strike boolean"
WRITES = "user string, ts timestamp, seq long, op string, role string, text string"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


class Folder:
    """A folder that a stream reads file by file."""

    def __init__(self, spark, schema):
        self.spark, self.schema = spark, schema
        self.base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        self.out, self.checkpoint = f"{self.base}/out", f"{self.base}/checkpoint"

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.base}/in")

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(f"{self.base}/in")

    def run(self, of):
        return sorted(map(repr, run_stream(of(self.stream()), self.out, self.checkpoint).collect()))


def replay(spark, schema, rows, of):
    return sorted(map(repr, of(spark.createDataFrame(rows, schema)).collect()))


def plain_lockouts(rows, window, threshold):
    """A list of times a key, as one process would keep it."""
    out = []
    for key in {r[0] for r in rows if r[0]}:
        own = sorted((r for r in rows if r[0] == key and r[1] is not None and r[2] is not None), key=lambda r: r[1])
        for _, t, i, _ in own:
            n = sum(bool(s) for _, u, _, s in own if u <= t and (t - u).total_seconds() <= window)
            out.append((key, i, n, n >= threshold))
    return sorted(out)


def strikes():
    rows = [(f"u{k % 3}", at(37 * k % 900), k, k % 4 != 1) for k in range(60)]
    rows += [("u0", at(100), 100, True), ("u0", at(100), 101, True), ("u0", at(400), 102, True), (None, at(5), 103, True), ("u1", None, 104, True), ("u1", at(50), 105, None), ("u2", at(1), None, True)]
    return rows


def test_lockouts_equal_a_plain_list(spark):
    rows = strikes()
    got = lockouts(spark.createDataFrame(rows, STRIKES), "user", 300, 3).collect()
    assert sorted(map(tuple, got)) == plain_lockouts(rows, 300, 3)
    assert {r.locked for r in got} == {True, False}


def test_lockout_stream_equals_replay(spark):
    rows = strikes()
    folder = Folder(spark, STRIKES)
    folder.put(rows)
    folder.put([("zz", at(2000), 999, False)])
    assert folder.run(lambda s: lockouts(s, "user", 300, 3)) == replay(spark, STRIKES, [*rows, ("zz", at(2000), 999, False)], lambda d: lockouts(d, "user", 300, 3))


def test_lockout_goes_on_after_a_restart_and_takes_disordered_rows(spark):
    """Three runs with one checkpoint; rows come in disorder within the allowed lateness, and one comes too late."""
    rows = sorted((r for r in strikes() if r[0] and r[1] and r[2] is not None), key=lambda r: (r[1], r[2]))
    first, second, third = rows[:20], rows[20:40], rows[40:]
    first, second = first[:-2] + [second[0]], [first[-2], first[-1], *second[1:]]  # a later row comes first
    folder = Folder(spark, STRIKES)
    of = lambda s: lockouts(s, "user", 300, 3, late="120 seconds")
    folder.put(first)
    folder.run(of)
    folder.put(second)
    some = folder.run(of)
    folder.put([*third, ("u0", at(0), 500, True)])  # the last row is long past the watermark
    folder.put([("zz", at(5000), 999, False)])
    folder.run(of)
    folder.put([("zz", at(9000), 1000, False)])
    got = folder.run(of)
    closing = [("zz", at(5000), 999, False)]
    expected = replay(spark, STRIKES, rows + closing, lambda d: lockouts(d, "user", 300, 3))
    assert [r for r in got if "id=1000" not in r] == expected and set(some) < set(expected)


def writes():
    rows = []
    for k in range(12):
        rows.append(("a", at(50 * k), k, "append", "user" if k % 2 else "assistant", f"text {k}"))  # renewed by each write
    rows += [("a", at(550 + 100), 20, "append", "user", "exactly at the end, so a new session"), ("a", at(700), 21, "summary", None, "so far"), ("a", at(705), 22, "append", "user", None)]
    rows += [("b", at(0), 1, "clear", None, None), ("b", at(10), 2, "append", "user", "x"), ("b", at(20), 3, "clear", None, None), ("b", at(20), 4, "append", "user", "y"), ("b", at(500), 5, "clear", None, None)]
    rows += [("c", at(0), 1, "summary", None, "only this"), ("d", at(5), 1, "append", "user", "tie"), ("d", at(5), 1, "append", "user", "tie"), ("d", at(5), 0, "append", "user", "before")]
    rows += [(None, at(5), 1, "append", "user", "x"), ("e", None, 1, "append", "user", "x"), ("e", at(6), None, "append", None, "no number")]
    return rows


def plain_sessions(rows, ttl, keep, until):
    out = []
    for key in {r[0] for r in rows if r[0]}:
        now = None
        own = sorted((r for r in rows if r[0] == key and r[1] is not None), key=lambda r: (r[1], r[2] or 0, r[3], (r[4] is not None, r[4]), (r[5] is not None, r[5])))
        for _, t, _, op, role, text in own:
            t = (t - START).total_seconds()
            if t > until:
                continue
            if now and t >= now["last"] + ttl:
                out.append((key, now["start"], now["last"] + ttl, "expired", now["writes"], now["summary"], now["turns"]))
                now = None
            if op == "clear":
                if now:
                    out.append((key, now["start"], t, "cleared", now["writes"], now["summary"], now["turns"]))
                now = None
                continue
            now = now or {"start": t, "writes": 0, "summary": None, "turns": []}
            now["last"] = t
            if op == "summary":
                now["summary"] = text
            else:
                now["writes"] += 1
                now["turns"] = (now["turns"] + [(role, text)])[-keep:]
        if now and now["last"] + ttl <= until:
            out.append((key, now["start"], now["last"] + ttl, "expired", now["writes"], now["summary"], now["turns"]))
    return sorted(out, key=repr)


def seen(rows):
    base = int(START.timestamp() * 1e6)
    return sorted(((r.user, (r.start - base) / 1e6, (r.ended - base) / 1e6, r.reason, r.writes, r.summary, [tuple(x) for x in r.turns]) for r in rows), key=repr)


def test_sessions_equal_a_plain_loop(spark):
    rows = writes()
    for until in (100_000, 705, 650):
        got = renewed_sessions(spark.createDataFrame(rows, WRITES), "user", 100, 3, until=F.lit(at(until))).collect()
        assert seen(got) == plain_sessions(rows, 100, 3, until)
    assert seen(renewed_sessions(spark.createDataFrame(rows, WRITES), "user", 100, 3).collect()) == plain_sessions(rows, 100, 3, 705)


def test_session_stream_equals_replay(spark):
    rows = [*writes(), ("z", at(3000), 1, "append", "user", "last")]
    folder = Folder(spark, WRITES)
    folder.put(rows)
    got = folder.run(lambda s: renewed_sessions(s, "user", 100, 3))
    assert got and got == replay(spark, WRITES, rows, lambda d: renewed_sessions(d, "user", 100, 3))


def test_sessions_live_through_a_restart_and_expire_without_new_rows_of_theirs(spark):
    rows = sorted((r for r in writes() if r[0] and r[1]), key=lambda r: r[1])
    folder = Folder(spark, WRITES)
    of = lambda s: renewed_sessions(s, "user", 100, 3, late="60 seconds")
    folder.put(rows[:9])
    early = folder.run(of)
    folder.put(rows[9:])
    folder.run(of)
    folder.put([("y", at(4000), 1, "append", "user", "moves the watermark")])
    folder.put([("y", at(0), 2, "append", "user", "or late: dropped, if the row before has moved it")])
    folder.run(of)
    folder.put([("y", at(9000), 3, "append", "user", "end")])
    got = [r for r in folder.run(of) if "user='y'" not in r]
    expected = [r for r in replay(spark, WRITES, [*rows, ("y", at(9000), 3, "append", "user", "end")], lambda d: renewed_sessions(d, "user", 100, 3)) if "user='y'" not in r]
    assert got == expected and set(early) <= set(expected)


@pytest.mark.parametrize("schema, of", [(STRIKES, lambda d: lockouts(d, "user", 300, 3)), (WRITES, lambda d: renewed_sessions(d, "user", 100, 3))])
def test_empty(spark, schema, of):
    assert replay(spark, schema, [], of) == []
