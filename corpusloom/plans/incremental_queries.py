"""Inserts without repeats, deltas, manifests and golden sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions import ontology as O
from corpusloom.operators import graph as G, incremental as I
from corpusloom.operators.similarity import centroid
from corpusloom.plans.registry import Catalogue, table
from corpusloom.plans.text_queries import made, sql_made
from corpusloom.session import fresh_dir
from corpusloom.sources.artefacts import artefact, table_print
from corpusloom.sources.csv_files import csv_documents
from corpusloom.sources.keyed import KeyedTable

QUERIES = Catalogue()


@QUERIES.add("""
select chunk_id, arg_min(doc_id, doc_id) as doc_id from (select substr(sha1(text), 1, 16) as chunk_id, doc_id from documents) where chunk_id not in (select substr(sha1(text), 1, 16) from documents where source = 'src3') group by chunk_id
""")
def vector_dedup_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.substring(F.sha1("text"), 1, 16).alias("chunk_id"), "doc_id", "source")
    return I.new_rows(rows.select("chunk_id", "doc_id"), rows.filter("source = 'src3'"), "chunk_id", F.col("doc_id"))


@QUERIES.add("""
select source, count(*) as files, count(distinct file_hash) as hashes from (select source, sha256(text) as file_hash from documents) where file_hash not in (select sha256(text) from documents where lang = 'de') group by source
""")
def incremental_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "lang", F.sha2("text", 256).alias("file_hash"))
    fresh = rows.join(rows.filter("lang = 'de'").select("file_hash").distinct(), "file_hash", "left_anti")
    return fresh.groupBy("source").agg(F.count("*").alias("files"), F.count_distinct("file_hash").alias("hashes"))


STATE_SQL = "(select doc_id, case when lang = 'fr' then 'old' else md5(text) end as old from documents where lang <> 'es')"


def _delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5("text").alias("digest"))
    state = rows.filter("lang <> 'es'").select("doc_id", F.when(F.col("lang") == "fr", "old").otherwise(F.col("digest")).alias("digest"))
    return I.delta_verdicts(rows, state, "doc_id", "digest")


@QUERIES.add(f"select lang, case when old is null then 'new' when old <> md5(text) then 'updated' else 'skip' end as verdict, count(*) as n from documents left join {STATE_SQL} using (doc_id) group by all")
def delta_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delta(spark, sf_dir).groupBy("lang", "verdict").agg(F.count("*").alias("n"))


@QUERIES.add(f"select doc_id, digest, count(*) as n from (select doc_id, old as digest from {STATE_SQL} where doc_id not in (select doc_id from documents where lang in ('fr', 'es')) union all select doc_id, md5(text) from documents where lang in ('fr', 'es')) group by all")
def delta_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = _delta(spark, sf_dir).filter("verdict <> 'skip'").select("doc_id", "digest")
    rows = table(spark, sf_dir, "documents").filter("lang <> 'es'").select("doc_id", F.when(F.col("lang") == "fr", "old").otherwise(F.md5("text")).alias("digest"))
    return I.replace_rows(rows, changed, "doc_id").groupBy("doc_id", "digest").agg(F.count("*").alias("n"))


@QUERIES.add("select user_id, arg_max(event_id, (ts, event_id)) as event_id, max(ts) as ts from events group by user_id")
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")])


@QUERIES.add("select count(*) as documents, count(distinct source) as sources, cast(sum(greatest(1, ceil(length(text) / 700.0))) as bigint) as chunks, count(distinct sha256(text)) as distinct_texts from documents")
def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = F.greatest(F.lit(1), F.ceil(F.char_length("text") / 700))
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources"), F.sum(chunks).alias("chunks"), F.count_distinct(F.sha2("text", 256)).alias("distinct_texts"))


GOLDEN = [("a", "single", "What?", "Ref", True), ("b", "odd", "Why?", "Ref", True), ("b", "oos", "", None, False), (None, "single", "Q", None, True), ("c", "formula", "F?", "x", True)]
GOLDEN_SQL = "select 100 + conv_id * 1000 + turn, 'q' || conv_id, case turn % 4 when 0 then 'single' when 1 then 'formula' when 2 then 'odd' else 'oos' end, text, case when turn % 3 = 0 then text end, turn % 2 = 0 from conversations"
STRATA = ["single", "multihop", "comparison", "followup", "numeric_edge", "formula", "oos", "unsafe", "sparse"]


@QUERIES.add(f"""
select pos, array_to_string(list_filter([case when id is null then 'id' end, case when stratum not in ('{"', '".join(STRATA)}') then 'stratum' end, case when trim(question) = '' then 'question' end,
  case when answerable and ref is null then 'reference' end, case when id is not null and n > 1 then 'duplicate' end], lambda x: x is not null), ',') as problems
from (select *, count(*) over (partition by id) as n from {sql_made(GOLDEN_SQL, [(k, *g) for k, g in enumerate(GOLDEN)], 'pos, id, stratum, question, ref, answerable')})
""")
def golden_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, GOLDEN_SQL, [(k, *g) for k, g in enumerate(GOLDEN)], "pos long, id string, stratum string, question string, ref string, answerable boolean")
    repeated = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 and id is not null").select("id", F.lit(True).alias("twice"))
    rows = rows.join(repeated, "id", "left")
    checks = [
        F.when(F.col("id").isNull(), "id"),
        F.when(~F.col("stratum").isin(STRATA), "stratum"),
        F.when(F.trim("question") == "", "question"),
        F.when(F.col("answerable") & F.col("ref").isNull(), "reference"),
        F.when(F.col("twice"), "duplicate"),
    ]
    return rows.select("pos", F.array_join(F.array_compact(F.array(*checks)), ",").alias("problems"))


@QUERIES.add("""
select n, sha256(concat_ws('|', cast(n as varchar), cast(s0 as varchar), cast(s1 as varchar), cast(s2 as varchar), cast(s3 as varchar), cast(s4 as varchar), cast(s5 as varchar), cast(s6 as varchar), cast(s7 as varchar))) as checksum from (
  select count(*) as n, """ + ", ".join(f"sum(cast('0x' || substr(h, {1 + 8 * i}, 8) as bigint)) as s{i}" for i in range(8)) + """ from (select sha256(cast(item_id as varchar) || '|' || text) as h from benchmark))
""")
def golden_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.order_free_checksum(table(spark, sf_dir, "benchmark"), F.concat_ws("|", F.col("item_id").cast("string"), "text"))


@QUERIES.add("""
select key, arg_min(name, seq) as name, arg_min(type, seq) as type, array_to_string(list_sort(list(distinct name)), ',') as aliases from (
  select lower(replace(replace(n_name, ' ', ''), '-', '')) as key, n_name as name, 'Location' as type, n_nationkey as seq from nation
  union all select lower(replace(replace(n_name, ' ', ''), '-', '')), lower(n_name), 'Concept', 1000 + c_custkey from customer join nation on c_nationkey = n_nationkey) group by key
""")
def keyed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities merged into a table of unique keys, the second batch twice: only buckets that change are written again."""
    n = table(spark, sf_dir, "nation")
    first = n.select("n_name", F.col("n_name").alias("name"), F.lit("Location").alias("type"), F.col("n_nationkey").cast("long").alias("seq"))
    later = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.lower("n_name").alias("name"), F.lit("Concept").alias("type"), (F.col("c_custkey") + 1000).alias("seq"))
    held = KeyedTable(spark, fresh_dir(spark, "entities"), "key string, name string, type string, seq long, aliases array<string>", ["key"], 16)
    for batch in (first, later, later):
        held.merge(batch.withColumn("key", O.canonical_key(F.col("n_name"))).withColumn("aliases", F.array("name")), G.merged_entities)
    held.check()
    return held.rows().select("key", "name", "type", F.array_join("aliases", ",").alias("aliases"))


@QUERIES.add("""
select i, round(avg(x), 6) as mean from (select unnest(range(1, len(embedding) + 1)) as i, unnest(embedding) as x from embeddings where label = 1) group by i
""")
def centroid_artefact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of a label, kept under a name made from the rows it was computed from; the second call loads it."""
    root, rows = fresh_dir(spark, "artefacts"), table(spark, sf_dir, "embeddings").filter("label = 1").select("vec_id", "embedding")
    for _ in range(2):
        found = artefact(spark, root, "centroid", ["mean", table_print(rows)], lambda: centroid(rows, "embedding"))
    return found.select(F.posexplode("centroid").alias("i", "mean")).select((F.col("i") + 1).cast("long").alias("i"), F.round("mean", 6).alias("mean"))


@QUERIES.add("select 's_suppkey: ' || s_suppkey || chr(10) || 's_name: ' || s_name as text, cast(null as varchar) as error from supplier")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as CSV files and read back as one document a row."""
    folder = fresh_dir(spark, "csv")
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").write.option("header", "true").csv(folder)
    return csv_documents(spark, folder).select("text", "error")
