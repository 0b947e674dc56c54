"""Evaluation: a document is answerable if its quality label is 1 and refused if it fails the quality gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions import patterns as P, text as X
from corpusloom.operators import evaluation as E
from corpusloom.plans.guard_queries import SQL_NUMS
from corpusloom.plans.registry import Catalogue, table
from corpusloom.plans.text_queries import SQL_QUALITY, made, sql_made, sql_values, values

QUERIES = Catalogue()
JUDGED_SQL = f"judged as (select d.doc_id, d.lang, d.n_chars, l.quality = 1 as answerable, d.reason <> 'ok' as refused, l.toxic from ({SQL_QUALITY.replace('{source}', 'documents')}) d join labels l using (doc_id))"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", (X.quality_reason(F.col("text")) != "ok").alias("refused"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "n_chars", (F.col("quality") == 1).alias("answerable"), "refused", "toxic")


@QUERIES.add(f"""
select conv_id, turn, array_to_string(list_filter(nums, lambda x: not list_contains(ctx, x)), ',') as unsupported, len(list_filter(nums, lambda x: not list_contains(ctx, x))) = 0 as grounded
from (select conv_id, turn, {SQL_NUMS.format('text')} as nums, {SQL_NUMS.format('coalesce(prior, chr(32))')} as ctx from (select *, lag(text) over (partition by conv_id order by turn) as prior from conversations))
""")
def numeric_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    prior = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    missing = F.array_except(X.normalized_numbers(F.col("text")), X.normalized_numbers(F.col("prior")))
    return table(spark, sf_dir, "conversations").withColumn("prior", prior).select("conv_id", "turn", F.array_join(missing, ",").alias("unsupported"), (F.size(missing) == 0).alias("grounded"))


@QUERIES.add(r"""
select doc_id, case when len(a) = 0 then 1.0 else round(len(list_filter(a, lambda x: list_contains(b, x))) / len(a), 6) end as faithfulness from (
  select doc_id, list_distinct(regexp_extract_all(substr(text, 1, cast(length(text) // 2 as bigint)), '[0-9]+(?:\.[0-9]+)?')) as a, regexp_extract_all(substr(text, cast(length(text) // 2 + 1 as bigint)), '[0-9]+(?:\.[0-9]+)?') as b from documents)
""")
def numeric_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of a text stands for the answer, the second for its context."""
    half = F.floor(F.char_length("text") / 2).cast("int")
    number = F.lit(r"[0-9]+(?:\.[0-9]+)?")
    a = F.array_distinct(F.regexp_extract_all(F.substr("text", F.lit(1), half), number, 0))
    b = F.regexp_extract_all(F.substr("text", half + 1), number, 0)
    rows = table(spark, sf_dir, "documents").select("doc_id", a.alias("a"), b.alias("b"))
    return rows.select("doc_id", F.when(F.size("a") == 0, 1.0).otherwise(F.round(F.size(F.filter("a", lambda x: F.array_contains(F.col("b"), x))) / F.size("a"), 6)).alias("faithfulness"))


FIDELITY = [(1, "It is 360 m wide", "swath 360 km and 2 days"), (2, "360 km and 4.50 kg of 7", "360 km; 4.5 kg"), (3, "INSAT-3D [S1] nothing", "x"), (4, "", "5"), (5, "1,400 km", "1400 km")]
FIDELITY_SQL = "select 100 + l_orderkey * 10 + l_linenumber, 'It is ' || cast(floor(l_quantity) as int) || ' km and ' || l_linenumber || ' days', cast(floor(l_quantity) as int) || case when l_linenumber % 2 = 0 then ' km' else ' m' end from lineitem"
_SQL_PAIRS = (
    "list_zip(list_transform(list_transform(regexp_extract_all({0}, '" + E.QUANTITY + "', 1), lambda x: replace(x, ',', '')), lambda x: case when contains(x, '.') then regexp_replace(regexp_replace(x, '0+$', ''), '\\.$', '') else x end), "
    "list_transform(regexp_extract_all({0}, '" + E.QUANTITY + "', 2), lambda u: regexp_replace(lower(coalesce(u, '')), '[^a-z0-9/^]', '', 'g')))"
)
_STATE = "case when len(list_filter(known, lambda k: k[1] = q[1])) = 0 then 'unknown' when q[2] = '' or len(list_filter(known, lambda k: k[1] = q[1] and k[2] <> '')) = 0 or len(list_filter(known, lambda k: k[1] = q[1] and k[2] = q[2])) > 0 then 'grounded' else 'swap' end"


@QUERIES.add(f"""
select id, cast(len(said) as integer) as total, cast(len(list_filter(states, lambda s: s = 'grounded')) as integer) as grounded, cast(len(list_filter(states, lambda s: s = 'swap')) as integer) as unit_swaps
from (select id, said, list_transform(said, lambda q: {_STATE}) as states from (select id, {_SQL_PAIRS.replace('{0}', 'a')} as said, {_SQL_PAIRS.replace('{0}', 'c')} as known from {sql_made(FIDELITY_SQL, FIDELITY, 'id, a, c')}))
""")
def numeric_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, FIDELITY_SQL, FIDELITY, "id long, a string, c string")
    return rows.select("id", E.numeric_fidelity(F.col("a"), F.col("c")).alias("f")).select("id", "f.total", "f.grounded", "f.unit_swaps")


FORMULAS = [(1, "so $$ \\sigma_0 = 4 $$ holds", "$\\sigma_0=4$"), (2, "so $x$", "$$y$$"), (3, "plain a = b", "a=b"), (4, "anything", "")]
FORMULAS_SQL = "select 100 + doc_id, text || ' where $ x = ' || doc_id || ' $ holds', case when doc_id % 3 = 0 then '$$x = ' || doc_id || '$$' when doc_id % 3 = 1 then lang else 'y = 1' end from documents"
_FORM = r"trim(regexp_replace(coalesce(nullif(regexp_extract({0}, '(?s)\$\$(.+?)\$\$', 1), ''), nullif(regexp_extract({0}, '(?s)\$(.+?)\$', 1), ''), {0}), '\s+', '', 'g'), '$')"


@QUERIES.add(rf"""
select id, w = '' or contains(regexp_replace(a, '\s+', '', 'g'), w) or len(list_filter(regexp_extract_all(a, '(?s)\$\$.+?\$\$|\$.+?\$'), lambda s: contains({_FORM.replace('{0}', 's')}, w))) > 0 as ok from (select id, a, {_FORM.replace('{0}', 'e')} as w from {sql_made(FORMULAS_SQL, FORMULAS, 'id, a, e')})
""")
def formula_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, FORMULAS_SQL, FORMULAS, "id long, a string, e string").select("id", E.formula_fidelity(F.col("a"), F.col("e")).alias("ok"))


CITED = [(1, "Fact one is stated here clearly [S1]. Another long fact without any source at all. SOURCES: [S1, S3]", 2), (2, "No citations in this sentence at all.", 1), (3, "[S2] and [S9]", 2), (4, "", 0)]
CITED_SQL = "select 100 + conv_id * 1000 + turn, text || ' It is so [S' || (turn % 4 + 1) || ']. SOURCES: [S1, S' || (turn % 5 + 1) || ']', 2 from conversations"
_CITED = "list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(a, '\\[S([0-9]+)\\]', 1), lambda x: 'S' || x), list_filter(list_transform(string_split(regexp_extract(a, '(?i)SOURCES:\\s*\\[([^\\]]*)\\]', 1), ','), lambda x: trim(x)), lambda x: regexp_matches(x, '^S[0-9]+$')))))"


@QUERIES.add(f"select id, array_to_string({_CITED}, ',') as cited, array_to_string(list_filter({_CITED}, lambda x: cast(substr(x, 2) as integer) > n), ',') as fabricated, array_to_string(list_filter({_CITED}, lambda x: cast(substr(x, 2) as integer) <= n), ',') as surviving from {sql_made(CITED_SQL, CITED, 'id, a, n')}")
def citation_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, CITED_SQL, CITED, "id long, a string, n int").select("id", E.cited(F.col("a")).alias("c"), _valid().alias("v"))
    return rows.select("id", F.array_join("c", ",").alias("cited"), F.array_join(F.array_except("c", "v"), ",").alias("fabricated"), F.array_join(F.array_sort(F.array_intersect("c", "v")), ",").alias("surviving"))


def _valid():
    return F.filter(F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: F.concat(F.lit("S"), i.cast("string"))), lambda x: x != "S0")


@QUERIES.add(rf"""
select id, cast(len({_CITED}) as integer) as cited, cast(len(list_filter({_CITED}, lambda x: cast(substr(x, 2) as integer) > n)) as integer) as fabricated, cast(len(fs) as integer) as factual, cast(len(list_filter(fs, lambda s: not regexp_matches(s, '\[S[0-9]+\]'))) as integer) as uncited
from (select *, list_filter(string_split(regexp_replace(regexp_replace(a, '{P.SOURCES_FOOTER}', ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(trim(s)) > 25) as fs from {sql_made(CITED_SQL, CITED, 'id, a, n')})
""")
def citation_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, CITED_SQL, CITED, "id long, a string, n int").select("id", E.citation_integrity(F.col("a"), _valid()).alias("c"))
    return rows.select("id", "c.cited", F.size("c.fabricated").alias("fabricated"), "c.factual", "c.uncited")


@QUERIES.add(f"""
with {JUDGED_SQL}, c as (select count(*) filter (where answerable and not refused) as true_answer, count(*) filter (where answerable and refused) as false_refusal, count(*) filter (where not answerable and refused) as true_refusal, count(*) filter (where not answerable and not refused) as hallucinated from judged)
select *, coalesce(round(false_refusal / nullif(false_refusal + true_answer, 0), 6), 0) as false_refusal_rate, coalesce(round(hallucinated / nullif(hallucinated + true_refusal, 0), 6), 0) as hallucination_rate,
  coalesce(round(true_refusal / nullif(true_refusal + false_refusal, 0), 6), 0) as refusal_precision, coalesce(round(true_refusal / nullif(true_refusal + hallucinated, 0), 6), 0) as refusal_recall from c
""")
def refusal_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(_judged(spark, sf_dir))


@QUERIES.add("select conv_id, turn, round((cast(contains(low, 'the') as integer) + cast(contains(low, 'la') as integer) + cast(contains(low, 'der') as integer)) / 3.0, 6) as hit_rate from (select *, lower(text) as low from conversations)")
def hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(sum((low.contains(w).cast("int") for w in ("the", "la", "der")), F.lit(0)) / 3.0, 6).alias("hit_rate"))


@QUERIES.add("select d.doc_id, d.lang, l.quality, c.messages from documents d join labels l using (doc_id) left join (select conv_id, count(*) as messages from conversations group by conv_id) c on c.conv_id = d.doc_id")
def eval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("messages"))
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return joined.join(turns, "doc_id", "left")


@QUERIES.add(f"with {JUDGED_SQL} select round(avg(case when answerable and not refused then n_chars end), 6) as mean_answered, coalesce(round(avg(case when toxic > 5 then n_chars end), 6), 0) as mean_absent, count(*) as n, count(*) filter (where answerable and not refused) as scored from judged")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered = F.col("answerable") & ~F.col("refused")
    return _judged(spark, sf_dir).agg(
        F.round(F.avg(F.when(answered, F.col("n_chars"))), 6).alias("mean_answered"), F.coalesce(F.round(F.avg(F.when(F.col("toxic") > 5, F.col("n_chars"))), 6), F.lit(0.0)).alias("mean_absent"), F.count("*").alias("n"), F.count_if(answered).alias("scored")
    )


@QUERIES.add(f"with {JUDGED_SQL} select lang, round(avg(case when refused then 0 else 1 end), 6) as mean, avg(case when refused then 0 else 1 end) < 0.85 as violated from judged where answerable group by lang")
def stratum_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.avg(F.when(F.col("refused"), 0).otherwise(1))
    return _judged(spark, sf_dir).filter("answerable").groupBy("lang").agg(F.round(m, 6).alias("mean"), (m < E.STRATUM_FLOOR).alias("violated"))


LANGS = [("en",), ("de",), ("fr",), ("es",), ("xx",)]


@QUERIES.add(f"select stratum, count(doc_id) as n from {sql_values(LANGS, 'stratum')} left join documents on lang = stratum group by stratum")
def stratum_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return values(spark, LANGS, "stratum string").join(counts, F.col("stratum") == F.col("lang"), "left").select("stratum", F.coalesce("n", F.lit(0)).alias("n"))


@QUERIES.add("select coalesce(lang, 'OVERALL') as type, count(*) as n, round(avg(n_chars), 6) as mean from documents group by rollup(lang)")
def scorecard_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").rollup("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean")).select(F.coalesce("lang", F.lit("OVERALL")).alias("type"), "n", "mean")


METRICS = [("ce3_fabricated_cite_rate", 0.0), ("judge_kappa", None)]
METRICS_SQL = "select 'faithfulness', round(avg(cast(quality as double)), 6) from labels union all select 'hallucination_rate', round(avg(cast(toxic as double)), 6) from labels union all select 'ce1_grounded_rate', round(avg(case when n_chars > 100 then cast(1 as double) else cast(0 as double) end), 6) from documents"


@QUERIES.add(f"select name, metric, cast(value as double) as value, cast(threshold as double) as threshold, case when value is null then 'SKIP' when (direction = 'min' and value >= threshold) or (direction = 'max' and value <= threshold) then 'PASS' else 'FAIL' end as status from {sql_values(E.GATES, 'name, metric, direction, threshold').replace('fixture', 'g')} left join {sql_made(METRICS_SQL, METRICS, 'm, value').replace('fixture', 'f')} on metric = m")
def gate_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.scorecard(made(spark, sf_dir, METRICS_SQL, METRICS, "metric string, value double"))
    return found.withColumns({c: F.col(c).cast("double") for c in ("value", "threshold")})


@QUERIES.add()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir).select("lang", F.when(F.col("refused"), 0.0).otherwise(1.0).alias("score"))
    return E.bootstrap(rows, "lang", "score")


@QUERIES.add()
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir).select("lang", (F.when(F.col("refused"), 0.0).otherwise(1.0) - F.when(F.col("answerable"), 1.0).otherwise(0.0)).alias("delta"))
    return E.bootstrap(rows, "lang", "delta").withColumn("excludes_zero", (F.col("lo") > 0) | (F.col("hi") < 0))


@QUERIES.add("(select 'union' as op, lang, source from documents where n_chars > 5000 union select 'union', lang, source from documents where n_chars < 300) union all (select 'except', lang, source from documents where n_chars < 3000 except select 'except', lang, source from documents where n_chars > 6000) union all (select 'intersect', lang, source from documents where n_chars < 300 intersect select 'intersect', lang, source from documents where n_chars > 6000)")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("n_chars", "lang", "source")
    part = lambda op, where: d.filter(where).select(F.lit(op).alias("op"), "lang", "source")
    both = part("union", "n_chars > 5000").union(part("union", "n_chars < 300")).distinct()
    return both.union(part("except", "n_chars < 3000").subtract(part("except", "n_chars > 6000"))).union(part("intersect", "n_chars < 300").intersect(part("intersect", "n_chars > 6000")))


@QUERIES.add("""
with said as (select conv_id, role, text from conversations),
expected as (select conv_id, list_distinct(flatten(list(regexp_extract_all(text, '[A-Za-z]{7,}')))) as names from said where role = 'user' group by conv_id),
context as (select conv_id, lower(coalesce(string_agg(text, ' '), '')) as c from said where role = 'assistant' group by conv_id)
select conv_id, len(names) as expected, case when len(names) = 0 then 1.0 else round(len(list_filter(names, lambda n: contains(coalesce(c, ''), lower(n)))) / len(names), 6) end as hit_rate
from expected left join context using (conv_id)
""")
def retrieval_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the expected names (the long words of a conversation's questions) that stand in its context (the answers), case aside; 1 where nothing is expected."""
    t = table(spark, sf_dir, "conversations")
    expected = t.filter("role = 'user'").groupBy("conv_id").agg(F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), 0)))).alias("names"))
    context = t.filter("role = 'assistant'").groupBy("conv_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("context"))
    return E.retrieval_hit_rate(expected.join(context, "conv_id", "left"), "names", "context").select("conv_id", F.size("names").cast("long").alias("expected"), "hit_rate")
