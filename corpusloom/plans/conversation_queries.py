"""Conversation tables; a conversation belongs to user conv_id modulo 10 and its turns are a minute apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusloom.functions import patterns as P, text as X
from corpusloom.operators import conversation as C
from corpusloom.operators.replay import replay
from corpusloom.plans.registry import Catalogue, table
from corpusloom.plans.text_queries import made, sql_made, sql_values, values

QUERIES = Catalogue()


@QUERIES.add("select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 4")
def last_n_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.last_turns(table(spark, sf_dir, "conversations"), 4).select("conv_id", "turn", "role")


LINES_SQL = "(select *, case role when 'user' then 'User' when 'assistant' then 'Assistant' else 'System' end || ': ' || text as line from conversations)"


@QUERIES.add(f"select conv_id, turn, sha256(coalesce(array_to_string(list(line) over (partition by conv_id order by turn rows between 10 preceding and 1 preceding), chr(10)), '')) as history from {LINES_SQL}")
def history_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.prefix_lines(table(spark, sf_dir, "conversations"), 10).select("conv_id", "turn", F.sha2(F.col("history").cast("binary"), 256).alias("history"))


@QUERIES.add(f"""
select conv_id, count(*) filter (where k > 6) as folded, count(*) filter (where k <= 6) as kept, sha256(coalesce(string_agg(line, chr(10) order by turn) filter (where k > 6), '')) as summary
from (select *, row_number() over (partition by conv_id order by turn desc) as k from {LINES_SQL}) group by conv_id
""")
def overflow_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.prefix_lines(table(spark, sf_dir, "conversations"), 1).withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    old = F.array_sort(F.collect_list(F.when(F.col("k") > 6, F.struct("turn", "line"))))
    summary = F.array_join(F.transform(old, lambda x: x["line"]), "\n")
    return rows.groupBy("conv_id").agg(F.count_if(F.col("k") > 6).alias("folded"), F.count_if(F.col("k") <= 6).alias("kept"), F.sha2(summary.cast("binary"), 256).alias("summary"))


def _owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") % 10).alias("owner")).distinct()


@QUERIES.add("select c.conv_id, turn, role from conversations c join (select distinct conv_id, conv_id % 10 as owner from conversations) o on o.conv_id = c.conv_id and o.owner = 3")
def owner_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").join(_owners(spark, sf_dir).filter("owner = 3"), "conv_id").select("conv_id", "turn", "role")


ASKED = [(3, 3), (4, 3), (13, 3), (100000, 3)]


@QUERIES.add(f"select conv_id, owner, exists (select 1 from conversations c where c.conv_id = a.conv_id and c.conv_id % 10 = a.owner) as allowed from {sql_values(ASKED, 'conv_id, owner').replace('fixture', 'a')}")
def owner_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _owners(spark, sf_dir).withColumn("allowed", F.lit(True))
    return values(spark, ASKED, "conv_id long, owner long").join(known, ["conv_id", "owner"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


@QUERIES.add("select conv_id, max(turn) as last_turn, count(*) as messages from conversations group by conv_id order by last_turn desc, conv_id limit 50")
def recent_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("messages")).orderBy(F.desc("last_turn"), "conv_id").limit(50)


@QUERIES.add("select conv_id, count(*) as messages from conversations where conv_id not in (select conv_id from conversations where role = 'system') group by conv_id")
def conv_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    return t.join(t.filter("role = 'system'").select("conv_id").distinct(), "conv_id", "left_anti").groupBy("conv_id").agg(F.count("*").alias("messages"))


FOLLOWUP_SQL = f"""select conv_id, turn, len(ws) > 0 and prior is not null and (list_has_any(ws, ['{"', '".join(P.PRONOUNS)}']) or {" or ".join(f"contains(low, '{o}')" for o in P.OPENERS)} or (len(ws) <= 6 and not regexp_matches(text, '(?:^|[^A-Za-z0-9_])[A-Z][A-Za-z0-9-]+'))) as followup
from (select *, lower(trim(text)) as low, regexp_extract_all(lower(trim(text)), '[a-z'']+') as ws, lag(text) over (partition by conv_id order by turn) as prior from conversations)"""


@QUERIES.add(FOLLOWUP_SQL)
def followup_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = F.coalesce(F.lag(F.lit("x")).over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    return table(spark, sf_dir, "conversations").withColumn("prior", prior).select("conv_id", "turn", C.is_followup(F.col("text"), F.col("prior")).alias("followup"))


@QUERIES.add(f"""
with f as ({FOLLOWUP_SQL}), t as (select conv_id, turn, coalesce(text, '') as text, coalesce(followup, false) as followup from conversations join f using (conv_id, turn))
select conv_id, turn, cast(null as varchar) as error, case when followup then trim(coalesce(last_value(case when not followup then text end ignore nulls) over w, '') || ' ' || text) else text end as search, cast(count(*) over (partition by conv_id order by turn) as bigint) as said
from t window w as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)
""")
def turn_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations replayed: a follow-up is searched with the last question that stood by itself, which is carried along."""
    t = table(spark, sf_dir, "conversations")
    before = F.coalesce(F.lag(F.lit("x")).over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    flagged = t.withColumn("followup", F.coalesce(C.is_followup(F.col("text"), before), F.lit(False))).select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), "followup")

    def step(state: tuple[str, int], row: dict) -> tuple[tuple[str, int], dict]:
        last, said = state
        search = f"{last} {row['text']}".strip(" ") if row["followup"] else row["text"]
        return (last if row["followup"] else row["text"], said + 1), {"search": search, "said": said + 1}

    return replay(flagged, lambda: ("", 0), step, "search string, said long")


@QUERIES.add(r"""
select conv_id, case when t = '' then 'New chat' else t end as title from (select conv_id, trim(substr(array_to_string(string_split(regexp_replace(regexp_replace(trim(trim(regexp_extract(regexp_replace(text, '^\s+|\s+$', '', 'g'), '^[^\n]*'), '"''')), '\s+', ' ', 'g'), '[.!?,:;]+$', ''), ' ')[1:8], ' '), 1, 60)) as t
  from (select conv_id, arg_min(text, turn) as text from conversations where role = 'user' group by conv_id))
""")
def title_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", X.clean_title(F.col("text")).alias("title"))


CONTEXTS = [(1, "aaa", "bbb"), (2, "aaa bbb", "bbb"), (3, "", "x"), (4, "x" * 30, "y" * 30)]
CONTEXTS_SQL = "select 100 + conv_id * 1000 + turn, text, case when turn % 2 = 0 then text else role end from conversations"


@QUERIES.add(f"select id, substr(case when contains(old, new) then old when old = '' then new else old || chr(10) || new end, 1, 40) as merged from {sql_made(CONTEXTS_SQL, CONTEXTS, 'id, old, new')}")
def context_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = F.col("old"), F.col("new")
    merged = F.when(old.contains(new), old).when(old == "", new).otherwise(F.concat(old, F.lit("\n"), new))
    return made(spark, sf_dir, CONTEXTS_SQL, CONTEXTS, "id long, old string, new string").select("id", F.substring(merged, 1, 40).alias("merged"))


@QUERIES.add("""
select user_id, last_seen, case when age > 86400 * 2 then 'expired' when k > 100 then 'evicted' else 'live' end as state from (
  select *, row_number() over (order by last_seen desc, user_id) as k, date_diff('second', last_seen, max(last_seen) over ()) as age from (select user_id, date_trunc('second', max(ts)) as last_seen from events group by user_id))
""")
def session_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idle sessions expire; of the live ones the 100 used last stay.

    The order that matters is that of the top 100, which is found by a partial
    top-k, not by ranking all sessions in one task.
    """
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.date_trunc("second", F.max("ts")).alias("last_seen"))
    newest = seen.agg(F.max("last_seen").alias("now"))
    top = seen.orderBy(F.desc("last_seen"), "user_id").limit(100).select("user_id", F.lit(True).alias("top"))
    joined = seen.join(F.broadcast(newest), F.lit(True)).join(F.broadcast(top), "user_id", "left")  # one row; 100 rows
    age = F.unix_timestamp("now") - F.unix_timestamp("last_seen")
    state = F.when(age > 86400 * 2, "expired").when(F.col("top").isNull(), "evicted").otherwise("live")
    return joined.select("user_id", "last_seen", state.alias("state"))


@QUERIES.add("""
select event_type, count(*) as requests, count(*) filter (where prev is not null and date_diff('microsecond', prev, ts) <= 3600000000) as hits
from (select *, lag(ts) over (partition by user_id, event_type order by ts, event_id) as prev from events) group by event_type
""")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request is a hit if its key was asked within the hour before; the TTL starts anew with each use."""
    prev = F.lag("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").withColumn("prev", prev)
    return e.groupBy("event_type").agg(F.count("*").alias("requests"), F.count_if(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prev").cast("timestamp")) <= 3_600_000_000).alias("hits"))


@QUERIES.add("""
with added as (select conv_id, max(turn) + 1 as turn, 'user' as role, 'And what about ' || count(*) || ' more?' as text from conversations where conv_id % 5 = 0 group by conv_id),
store as (select conv_id, turn, role, text from conversations union all select * from added)
select conv_id, count(*) as messages, max(turn) as updated, arg_max(role, turn) as last_role, sha256(coalesce(arg_max(text, turn), '')) as last_text from store group by conv_id
""")
def conv_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of messages appended to a store: each conversation's number of messages, last turn (its time of update) and last message."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = t.filter("conv_id % 5 = 0").groupBy("conv_id").agg((F.max("turn") + 1).alias("turn"), F.count("*").alias("n"))
    batch = added.select("conv_id", F.col("turn").cast(dict(t.dtypes)["turn"]).alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("And what about "), F.col("n").cast("string"), F.lit(" more?")).alias("text"))
    return C.conversation_state(t.unionByName(batch)).select("conv_id", "messages", "updated", "last_role", F.sha2(F.coalesce("last_text", F.lit("")).cast("binary"), 256).alias("last_text"))


@QUERIES.add("""
with asked as (select conv_id % 3 as version, lower(trim(text)) as question, turn, conv_id, (conv_id * 7 + turn * 13) % 5 > 0 as grounded from conversations),
keys as (select question, version, max(conv_id * 1000 + turn) as used, count(*) as uses from asked where grounded and version = 1 group by all)
select sha256(question) as question, version, uses, used from keys order by used desc, question limit 100
""")
def answer_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an answer cache holds: grounded answers of the current version alone, the hundred used last."""
    t = table(spark, sf_dir, "conversations")
    asked = t.select((F.col("conv_id") % 3).alias("version"), F.lower(F.trim("text")).alias("question"), (F.col("conv_id") * 1000 + F.col("turn")).alias("used"), ((F.col("conv_id") * 7 + F.col("turn") * 13) % 5 > 0).alias("grounded"))
    kept = C.cached_answers(asked, 1, 100)
    return kept.select(F.sha2(F.col("question").cast("binary"), 256).alias("question"), "version", "uses", "used")


@QUERIES.add("select sha256(q) as query, count(*) as uses from (select lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) as q from conversations where role = 'user') where q <> '' group by q")
def distinct_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question once before it is embedded, and how often it stands; blanks and case aside."""
    q = F.lower(F.regexp_replace(F.trim("text"), r"\s+", " "))
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'").select(q.alias("q")).filter("q <> ''")
    return asked.groupBy("q").agg(F.count("*").alias("uses")).select(F.sha2(F.col("q").cast("binary"), 256).alias("query"), "uses")
