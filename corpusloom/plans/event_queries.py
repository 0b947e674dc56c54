"""Rolling windows, sessions, audit rows, metrics and latencies over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusloom.plans.registry import Catalogue, table
from corpusloom.streaming import stateful, streams

QUERIES = Catalogue()


@QUERIES.add("""
select event_id, user_id, n >= 2 as locked, n from (select event_id, user_id, count(*) over (partition by user_id order by epoch_us(ts) // 1000000 range between 86400 preceding and current row) as n from events where event_type = 'error')
""")
def abuse_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a user in the last day, the current one included; two or more lock out."""
    back = Window.partitionBy("user_id").orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-86400, 0)
    errors = table(spark, sf_dir, "events").filter("event_type = 'error'").withColumn("n", F.count("*").over(back))
    return errors.select("event_id", "user_id", (F.col("n") >= 2).alias("locked"), "n")


@QUERIES.add("""
select user_id, date_trunc('second', min(ts)) as start, count(*) as n from (
  select *, sum(fresh) over (partition by user_id order by ts, event_id) as session from (select *, case when date_diff('microsecond', lag(ts) over (partition by user_id order by ts, event_id), ts) < 7200000000 then 0 else 1 end as fresh from events)) group by user_id, session
""")
def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(table(spark, sf_dir, "events"), "2 hours").withColumn("start", F.date_trunc("second", "start"))


@QUERIES.add("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.tumbling(table(spark, sf_dir, "events"), "1 hour").withColumn("total", F.round("total", 4))


@QUERIES.add("""
select start, user_id, count(*) as n from (select user_id, ts, unnest([time_bucket(interval '1 hour', ts), time_bucket(interval '1 hour', ts) - interval '1 hour', time_bucket(interval '1 hour', ts) - interval '2 hour']) as start from events) group by all
""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sliding(table(spark, sf_dir, "events"), "3 hours", "1 hour")


@QUERIES.add("select event_id as request, substr(sha256(cast(user_id as varchar)), 1, 16) as session_hash, case event_type when 'error' then 'refuse' else 'allow' end as action, round(value * 10, 1) as latency_ms from events")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows carry a hash of the session and never a text."""
    action = F.when(F.col("event_type") == "error", "refuse").otherwise("allow")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("request"), F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 16).alias("session_hash"), action.alias("action"), F.round(F.col("value") * 10, 1).alias("latency_ms"))


@QUERIES.add("select 'events_total{type=\"' || event_type || '\"}' as series, cast(count(*) as varchar) as exposed, round(sum(value), 4) as total, round(sum(value) / count(*), 6) as mean from events group by event_type")
def metrics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = F.concat(F.lit('events_total{type="'), "event_type", F.lit('"}'))
    return table(spark, sf_dir, "events").groupBy(series.alias("series")).agg(F.count("*").cast("string").alias("exposed"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"))


@QUERIES.add("select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, max(value) as top, count(*) as n from events group by event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = [F.round(F.percentile("value", q), 6).alias(n) for q, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*exact, F.max("value").alias("top"), F.count("*").alias("n"))


@QUERIES.add("select event_id, cast(json_extract(props, '$.k') as integer) as k, coalesce(json_extract_string(props, '$.user.name'), json_extract_string(props, '$.k'), 'none') as claim from events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.coalesce(F.get_json_object("props", "$.user.name"), F.get_json_object("props", "$.k"), F.lit("none")).alias("claim"))


@QUERIES.add("""
select client, start, n, greatest(n - 3, 0) as refused from (select substr(sha256(cast(user_id as varchar)), 1, 16) as client, time_bucket(interval '1 hour', ts) as start, count(*) as n from events group by all)
""")
def client_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a client in fixed windows, and how many of them the limit of three refuses."""
    return streams.rate_limited(table(spark, sf_dir, "events"), "user_id", "1 hour", 3)


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table read as a stream: its files as they are, all that is there now."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern may match one file or a folder of files


def _strikes(events: DataFrame) -> DataFrame:
    return events.select("user_id", "ts", F.col("event_id").alias("id"), (F.col("event_type") == "error").alias("strike"))


@QUERIES.add("""
with final as (select * from events where epoch_us(ts) <= (select max(epoch_us(ts)) // 1000 * 1000 from events))
select user_id, event_id as id, coalesce(sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by epoch_us(ts) range between 86400000000 preceding and current row), 0)::bigint as n,
  n >= 2 as locked from final
""")
def lockout_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream with keyed state: the user's errors of the last day at each event, and whether two or more lock the user out; what the watermark has passed."""
    return stateful.run_stream(stateful.lockouts(_strikes(_stream(spark, sf_dir, "events")), "user_id", 86_400, 2))


WRITES_SQL = """
writes as (select user_id, epoch_us(ts) as t, event_id as seq, case event_type when 'logout' then 'clear' when 'error' then 'summary' else 'append' end as op, event_type as role, props as text from events where user_id is not null and ts is not null),
bound as (select {until} as until from writes),
fresh as (select *, case when lag(t) over w is null or lag(op) over w = 'clear' or t - lag(t) over w >= 7200000000 then 1 else 0 end as fresh from writes, bound where t <= until window w as (partition by user_id order by t, seq)),
numbered as (select *, sum(fresh) over (partition by user_id order by t, seq) as session from fresh),
met as (select user_id, session, min(t) as start, max(t) as last, bool_or(op = 'clear') as cleared, count(*) filter (where op = 'append') as writes, count(*) filter (where op <> 'clear') as n_some, max(until) as until,
  arg_max(text, (t, seq)) filter (where op = 'summary') as summary, list(role || ' ' || text order by t, seq) filter (where op = 'append') as turns from numbered group by user_id, session)
select user_id, start, ended, case when cleared then 'cleared' else 'expired' end as reason, writes, summary, array_to_string(coalesce(turns, [])[greatest(1, len(coalesce(turns, [])) - 3):], '; ') as turns
from (select *, case when cleared then last else last + 7200000000 end as ended from met) where n_some > 0 and ended <= until
"""


def _writes(events: DataFrame) -> DataFrame:
    op = F.when(F.col("event_type") == "logout", "clear").when(F.col("event_type") == "error", "summary").otherwise("append")
    return events.select("user_id", "ts", F.col("event_id").alias("seq"), op.alias("op"), F.col("event_type").alias("role"), F.col("props").alias("text"))


def _shown(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("turns", F.array_join(F.transform("turns", lambda x: F.concat_ws(" ", x["role"], x["text"])), "; "))


@QUERIES.add("with " + WRITES_SQL.format(until="max(t) // 1000 * 1000"))
def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of writes to sessions of two hours, which each write renews; sessions that the watermark has ended, with their last four turns."""
    return _shown(stateful.run_stream(stateful.renewed_sessions(_writes(_stream(spark, sf_dir, "events")), "user_id", 7_200, 4)))


@QUERIES.add("with " + WRITES_SQL.format(until="max(t)"))
def session_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sessions by replaying the whole table."""
    return _shown(stateful.renewed_sessions(_writes(table(spark, sf_dir, "events")), "user_id", 7_200, 4))
