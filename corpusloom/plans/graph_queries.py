"""Knowledge-graph queries; the graph is that of suppliers, customers, nations and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusloom.functions import ontology as O
from corpusloom.operators import graph as G
from corpusloom.operators.retrieval import bm25, tokenized
from corpusloom.plans.registry import Catalogue, table
from corpusloom.plans.text_queries import SQL_TOKENS, made, sql_made, sql_texts_with, sql_values, texts_with, values

QUERIES = Catalogue()

EDGES_SQL = """edges as (
  select s_name as src, 'LOCATED_IN' as name, n_name as dst from supplier join nation on s_nationkey = n_nationkey
  union all select n_name, 'PART_OF', r_name from nation join region on n_regionkey = r_regionkey
)"""
BOTH_SQL = "both_ways as (select src as a, dst as b, src || ' ' || name || ' ' || dst as edge from edges union all select dst, src, src || ' ' || name || ' ' || dst from edges)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    located = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("src"), F.lit("LOCATED_IN").alias("name"), F.col("n_name").alias("dst"))
    part = n.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.lit("PART_OF").alias("name"), F.col("r_name").alias("dst"))
    return located.unionByName(part)


def _sql_list(xs: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _sql_map(m: dict[str, str]) -> str:
    return "map {" + ", ".join(f"'{k}': '{v}'" for k, v in m.items()) + "}"


def _key_sql(x: str) -> str:
    low = rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s-]', ' ', 'g'), '\s+', ' ', 'g'))"
    return f"replace(array_to_string({_strip_sql(f'''string_split({low}, ' ')''')}, ''), '-', '')"


def _strip_sql(words: str) -> str:
    lead = f"case when list_contains({_sql_list(O.DETERMINERS)}, {words}[1]) then {words}[2:] else {words} end"
    return f"case when len({lead}) > 1 and list_contains({_sql_list(O.TRAILING_TYPES)}, ({lead})[-1]) then ({lead})[:-2] else {lead} end"


NAMES = [("the INSAT-3D satellite",), ("INSAT 3D",), ("insat3d",), ("The Ocean Sensor",), ("a Big Mission",), ("SAC",), ("  Mega  Tropiques series",), ("sensor",), ("the",)]


@QUERIES.add(rf"""
select name, key, coalesce({_sql_map(O.LEXICON)}[key], nullif(bare, ''), trim(name)) as canonical
from (select name, {_key_sql('name')} as key, trim(array_to_string({_strip_sql(r"string_split(trim(regexp_replace(name, '\s+', ' ', 'g')), ' ')")}, ' '), ' -') as bare
  from (select distinct 'the ' || p_brand || ' sensor' as name from part union all select * from {sql_values(NAMES, 'name')}))
""")
def entity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select(F.concat(F.lit("the "), "p_brand", F.lit(" sensor")).alias("name")).distinct()
    rows = brands.unionByName(values(spark, NAMES, "name string"))
    return rows.select("name", O.canonical_key(F.col("name")).alias("key"), O.canonical_name(F.col("name")).alias("canonical"))


@QUERIES.add("select conv_id, turn, array_to_string(list_filter(es, lambda x, i: list_position(es, x) = i), ',') as entities from (select conv_id, turn, regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])([A-Z][A-Za-z0-9-]+)', 1) as es from conversations)")
def entity_spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all("text", F.lit("(?:^|[^A-Za-z0-9_])([A-Z][A-Za-z0-9-]+)"), 1))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(found, ",").alias("entities"))


VERBS = [("carries",), ("was launched by",), ("is",), ("acquired",), ("Part Of",), ("is equipped with a",), ("PRODUCES",), ("  ",), ("flies over",), ("has",), ("related to",)]
VERBS_SQL = "select distinct p_type from part"
PHRASES = [v for v in sorted(O.VERB_TO_RELATION, key=len, reverse=True) if " " in v]


@QUERIES.add(f"""
select verb, case when trim(verb) = '' then null else coalesce({_sql_map(O.VERB_TO_RELATION)}[raw], case {' '.join(f"when contains(raw, '{p}') then '{O.VERB_TO_RELATION[p]}'" for p in PHRASES)}
  when list_contains({_sql_list(O.RELATION_TYPES)}, own) then own when list_contains({_sql_list(O.TRIVIAL)}, own) then null else own end) end as relation
from (select verb, lower(trim(verb)) as raw, trim(regexp_replace(upper(trim(verb)), '[^A-Za-z0-9_]+', '_', 'g'), '_') as own from {sql_made(VERBS_SQL, VERBS, 'verb')})
""")
def relation_canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, VERBS_SQL, VERBS, "verb string").select("verb", O.canonical_relation(F.col("verb")).alias("relation"))


TYPES = [("ORG",), ("Satellite",), ("data format",), ("unknown thing",), (None,), ("Use Case",), ("gpe",)]
TYPES_SQL = "select distinct c_mktsegment from customer union select distinct p_type from part"


@QUERIES.add(f"""
select raw, coalesce({_sql_map(O.TYPE_ALIASES)}[lower(trim(raw))], case when list_contains({_sql_list(O.NODE_TYPES)}, title) then title end, 'Concept') as type
from (select raw, array_to_string(list_transform(string_split(trim(raw), ' '), lambda w: upper(w[1]) || lower(w[2:])), '') as title from {sql_made(TYPES_SQL, TYPES, 'raw')})
""")
def node_type_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, TYPES_SQL, TYPES, "raw string").select("raw", O.node_type(F.col("raw")).alias("type"))


SENTENCES = [(1, "Acme Corp acquired Beta Works. Gamma Lab developed Delta Engine"), (2, "Alpha is Omega"), (3, "nothing here"), (4, "Big House owns Small Shed")]
SENTENCES_SQL = "select 100 + s_suppkey, replace(s_name, '#', ' ') || ' leads ' || n_name || ' Branch. ' || n_name || ' Office is Open' from supplier join nation on s_nationkey = n_nationkey"


@QUERIES.add(rf"""
select id, trim(s) as subject, upper(v) as relation, trim(o) as object, cast(0.4 as double) as confidence from (
  select id, unnest(regexp_extract_all(t, '{G.SVO}', 1)) as s, unnest(regexp_extract_all(t, '{G.SVO}', 2)) as v, unnest(regexp_extract_all(t, '{G.SVO}', 3)) as o from {sql_made(SENTENCES_SQL, SENTENCES, 'id, t')})
where not list_contains({_sql_list(O.TRIVIAL)}, upper(v))
""")
def svo_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.svo(made(spark, sf_dir, SENTENCES_SQL, SENTENCES, "id long, t string"), "id", "t")


@QUERIES.add()
def quantity_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixture = values(spark, [(-1, "The spatial resolution is 1 km. Revisit time of 2 days.\nFrequency 1.2 x 10^3 MHz with 5 channels"), (-2, "page 7")], "doc_id long, text string")
    return G.mine_quantities(table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(fixture), "doc_id", "text")


MEASURES = [(1, "1", "km"), (2, "2.5", "days"), (3, "7", None), (4, "1.2 x 10^3", "MHz"), (5, "40", "parsec"), (6, "3", "GHz")]
MEASURES_SQL = "select 100 + l_orderkey * 10 + l_linenumber, '' || cast(floor(l_quantity) as int), case l_linenumber % 4 when 0 then 'km' when 1 then 'days' when 2 then 'GHz' else 'parsec' end from lineitem"
UNIT_ROWS = [(k, b, f) for k, (b, f) in O.UNITS.items()]


@QUERIES.add(rf"""
select id, v * coalesce(factor, 1) as base_value, coalesce(base, '') as base_unit from (
  select *, case when contains(raw, 'x') then cast(regexp_extract(raw, '^([0-9.]+)', 1) as double) * pow(10, cast(regexp_extract(raw, '\^?(-?[0-9]+)$', 1) as integer)) else cast(raw as double) end as v from {sql_made(MEASURES_SQL, MEASURES, 'id, raw, u')})
left join {sql_values(UNIT_ROWS, 'k, base, factor')} on lower(u) = k
""")
def unit_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = values(spark, UNIT_ROWS, "k string, base string, factor double")
    rows = made(spark, sf_dir, MEASURES_SQL, MEASURES, "id long, raw string, u string")
    power = F.regexp_extract("raw", r"\^?(-?[0-9]+)$", 1).cast("int")
    v = F.when(F.col("raw").contains("x"), F.regexp_extract("raw", r"^([0-9.]+)", 1).cast("double") * F.pow(F.lit(10.0), power)).otherwise(F.expr("try_cast(raw as double)"))
    joined = rows.join(F.broadcast(units), F.lower("u") == F.col("k"), "left")  # the unit table is a constant
    return joined.select("id", (v * F.coalesce("factor", F.lit(1.0))).alias("base_value"), F.coalesce("base", F.lit("")).alias("base_unit"))


@QUERIES.add(rf"""
with found as (select id, trim(s) as subject, upper(v) as relation, trim(o) as object from (
  select id, unnest(regexp_extract_all(t, '{G.SVO}', 1)) as s, unnest(regexp_extract_all(t, '{G.SVO}', 2)) as v, unnest(regexp_extract_all(t, '{G.SVO}', 3)) as o from {sql_texts_with(SENTENCES)}) where not list_contains({_sql_list(O.TRIVIAL)}, upper(v)))
select lower(subject) as src, relation as name, lower(object) as dst, count(*) as mentions, count(distinct id) as chunks from found group by all
""")
def kg_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's relations built anew from all stored texts, with how often and in how many of them each stands."""
    return G.rebuild(texts_with(spark, sf_dir, SENTENCES), "id", "t")


@QUERIES.add()
def entity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy leaders of near-duplicate vectors of one label, all vectors against all of their label in blocks; the reference's limit of 0.92 joins none of the test vectors, so 0.2 is taken."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("type"), F.col("embedding").alias("v"))
    return G.entity_clusters(e, least=0.2)


TRIPLES = [(1, 0, "A", "carries", "B", 0.9), (1, 1, "a", "carries", "b", 0.95), (1, 2, "A", "is", "C", 0.9), (2, 0, "X", "related to", "Y", 0.9), (2, 1, "P", "acquired", "Q", 1.7), (2, 2, "P", "uses", "p", 0.9), (3, 0, "M", "uses", "N", None), (3, 1, "", "uses", "N", 0.7), (3, 2, "M", "measures", "T", 0.2)]
TRIPLES_SQL = "select 100 + l_orderkey, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey, l_linestatus, case l_linenumber % 3 when 0 then 'carries' when 1 then 'uses' else 'is' end, l_returnflag, cast(l_discount as double) * 10 from lineitem"


@QUERIES.add(f"""
select chunk, pos, subject, relation, object, confidence from (
  select *, row_number() over (partition by chunk, lower(subject), relation, lower(object) order by pos) as rn from (
    select chunk, pos, subject, object, cast(greatest(0, least(1, coalesce(c, 0.8))) as double) as confidence, coalesce({_sql_map(O.VERB_TO_RELATION)}[verb], case when verb = 'is' then null else upper(replace(verb, ' ', '_')) end) as relation from {sql_made(TRIPLES_SQL, TRIPLES, 'chunk, pos, subject, verb, object, c')})
  where subject <> '' and object <> '' and lower(subject) <> lower(object) and relation is not null) where rn = 1 and confidence >= 0.6 and relation <> 'RELATED_TO'
""")
def triple_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.validate_triples(made(spark, sf_dir, TRIPLES_SQL, TRIPLES, "chunk long, pos long, subject string, verb string, object string, confidence double"), 0.6)


ANCHORS = [(1, 0, "Foo", "Concept", "Bar", "Satellite"), (1, 1, "Sat", "Satellite", "Zed", "Concept"), (2, 0, "A", "Concept", "B", "Sensor"), (3, 0, "C", "Concept", "D", "Concept"), (3, 1, "E", "Concept", "F", "Concept")]
ANCHORS_SQL = "select 100 + o_custkey, o_orderkey, o_orderpriority, case when o_orderkey % 5 = 0 then 'Sensor' else 'Concept' end, o_orderstatus, case when o_orderkey % 7 = 0 then 'Mission' else 'Concept' end from orders"


@QUERIES.add(f"""
select chunk, case when cls = 1 then ob else su end as anchor from (select *, row_number() over (partition by chunk order by cls, pos) as rn from (
  select *, case when st in ('Satellite', 'Sensor', 'Mission', 'Product') then 0 when ot in ('Satellite', 'Sensor', 'Mission', 'Product') then 1 else 2 end as cls from {sql_made(ANCHORS_SQL, ANCHORS, 'chunk, pos, su, st, ob, ot')})) where rn = 1
""")
def pick_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, ANCHORS_SQL, ANCHORS, "chunk long, pos long, su string, st string, ob string, ot string")
    first = ["Satellite", "Sensor", "Mission", "Product"]
    kind = F.when(F.col("st").isin(first), 0).when(F.col("ot").isin(first), 1).otherwise(2)
    anchor = F.when(kind == 1, F.col("ob")).otherwise(F.col("su"))
    return rows.groupBy("chunk").agg(F.min_by(anchor, F.struct(kind.alias("k"), "pos")).alias("anchor"))


@QUERIES.add()
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = [(1, '{"triples":[{"subject":"A","object":"B"}]}'), (2, 'noise {"triples":[{"subject":"A","object":"B"},{"subject":"C","obj'), (3, "nothing"), (4, None)]
    broken = """select 100 + conv_id * 1000 + turn, substr('{"triples":[{"subject":"' || role || '","object":"T' || turn || '"},{"subject":"B","object":"C"}]}', 1, 30 + turn * 9) from conversations"""  # answers that break off
    return G.salvage(made(spark, sf_dir, broken, answers, "id long, raw string"), "id", "raw")


@QUERIES.add("""
select key, arg_min(name, seq) as name, arg_min(type, seq) as type, count(distinct name) as n_aliases from (
  select lower(replace(replace(n_name, ' ', ''), '-', '')) as key, n_name as name, 'Location' as type, n_nationkey as seq from nation
  union all select lower(replace(replace(n_name, ' ', ''), '-', '')), lower(n_name), 'Concept', 1000 + c_custkey from customer join nation on c_nationkey = n_nationkey) group by key
""")
def kg_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    first = n.select("n_name", F.col("n_name").alias("name"), F.lit("Location").alias("type"), F.col("n_nationkey").cast("long").alias("seq"))
    later = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.lower("n_name").alias("name"), F.lit("Concept").alias("type"), (F.col("c_custkey") + 1000).alias("seq"))
    rows = first.unionByName(later).withColumn("key", O.canonical_key(F.col("n_name")))
    return G.upsert_entities(rows).select("key", "name", "type", F.size("aliases").cast("long").alias("n_aliases"))


@QUERIES.add("""
select c_mktsegment as src, 'HAS_CUSTOMERS_IN' as name, n_name as dst, max(c_acctbal) as confidence, arg_min(c_name, c_custkey) as provenance from customer join nation on c_nationkey = n_nationkey group by all
""")
def kg_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return G.upsert_relations(rows.select(F.col("c_mktsegment").alias("src"), F.lit("HAS_CUSTOMERS_IN").alias("name"), F.col("n_name").alias("dst"), F.col("c_acctbal").alias("confidence"), F.col("c_name").alias("provenance"), F.col("c_custkey").alias("seq")))


MEASURED = [(1, "Sat", "swath", "1400 km"), (2, "sat", "Swath", "1400 KM"), (3, "Sat", "swath", "700 km"), (4, "Oth", "altitude", "2 m")]
MEASURED_SQL = "select 100 + l_orderkey * 10 + l_linenumber, l_linestatus, l_returnflag, cast(floor(l_quantity) as int) || ' km' from lineitem"


@QUERIES.add(f"select lower(entity || '|' || prop || '|' || raw) as key, arg_min(entity, seq) as entity, arg_min(raw, seq) as raw, count(*) as seen from {sql_made(MEASURED_SQL, MEASURED, 'seq, entity, prop, raw')} group by 1")
def kg_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, MEASURED_SQL, MEASURED, "seq long, entity string, prop string, raw string").withColumn("key", F.lower(F.concat_ws("|", "entity", "prop", "raw")))
    return rows.groupBy("key").agg(F.min_by("entity", "seq").alias("entity"), F.min_by("raw", "seq").alias("raw"), F.count("*").alias("seen"))


@QUERIES.add("select distinct l_suppkey as entity, o_orderpriority as source from lineitem join orders on l_orderkey = o_orderkey")
def kg_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("l_suppkey").alias("entity"), F.col("o_orderpriority").alias("source")).distinct()


@QUERIES.add("select distinct s_suppkey as chunk from supplier join nation on s_nationkey = n_nationkey where n_nationkey in (1, 3, 5) or lower(n_name) in (select lower(r_name) from region) or lower(s_name) like '%7'")
def entity_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The disjunction as a union of equality joins."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    by_key = s.join(values(spark, [(1,), (3,), (5,)], "k int"), F.col("n_nationkey") == F.col("k"), "left_semi")
    by_name = s.join(table(spark, sf_dir, "region"), F.lower("n_name") == F.lower("r_name"), "left_semi")
    by_end = s.filter(F.lower("s_name").endswith("7"))
    return by_key.unionByName(by_name).unionByName(by_end).select(F.col("s_suppkey").alias("chunk")).distinct()


@QUERIES.add("select p_partkey as part, p_name as name, cast(1.0 as double) as score from part where contains(lower(p_name), 're') order by p_partkey limit 10")
def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "part").filter(F.lower("p_name").contains("re")).orderBy("p_partkey").limit(10)
    return hits.select(F.col("p_partkey").alias("part"), F.col("p_name").alias("name"), F.lit(1.0).alias("score"))


ENTITY_QUERIES = [(1, "green almond"), (2, "red steel box"), (3, "nothing such here"), (4, "re")]


@QUERIES.add(f"""
with d as (select p_partkey as id, {SQL_TOKENS.replace("text", "p_name")} as tokens from part), q as (select id as query_id, {SQL_TOKENS.replace("text", "t")} as tokens from {sql_values(ENTITY_QUERIES, 'id, t')}),
terms as (select query_id, term, count(*) as qtf from (select query_id, unnest(tokens) as term from q) group by all),
p as (select id, dl, term, count(*) as tf from (select id, len(tokens) as dl, unnest(tokens) as term from d) group by all),
idfs as (select term, ln((select count(*) from d) - count(*) + 0.5) - ln(count(*) + 0.5) as idf0 from p group by term), means as (select avg(idf0) as mean_idf from idfs), size as (select avg(len(tokens)) as avgdl from d),
bm as (select query_id, id, round(sum(qtf * case when idf0 < 0 then 0.25 * mean_idf else idf0 end * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from terms join p using (term) join idfs using (term), means, size group by all)
select query_id, id as part, score, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from bm where score > 0) where rank <= 10
""")
def entity_fulltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by the words of their names, best score first; entity_search only asks whether a name holds a string."""
    queries = values(spark, ENTITY_QUERIES, "query_id int, text string")
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))
    found = bm25(tokenized(queries, "query_id", "query_id"), tokenized(names, "doc_id", "doc_id"), 10)
    return found.select("query_id", F.col("doc_id").alias("part"), "score", "rank")


QUESTIONS = [(1, "What lies in EUROPE or ASIA?"), (2, "FRANCE and GERMANY and FRANCE"), (3, "nothing named"), (4, "Suppliers of AFRICA, AMERICA, ASIA, EUROPE and CHINA")]


@QUERIES.add(f"""
with {EDGES_SQL}, degree as (select node, count(*) as degree from (select src as node from edges union all select dst from edges) group by node),
said as (select question, unnest(es) as node, generate_subscripts(es, 1) as pos from (select id as question, regexp_extract_all(t, '[A-Z][A-Za-z]+') as es from {sql_values(QUESTIONS, 'id, t')}))
select question, node as seed, degree, rank from (select question, node, degree, row_number() over (partition by question order by degree, lowest, node) as rank from (select question, node, min(pos) as lowest from said group by all) join degree using (node)) where rank <= 3
""")
def seed_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names in a question that the graph knows, rare ones first, three at most."""
    questions = values(spark, QUESTIONS, "question int, t string")
    return G.seeds(questions, "question", "t", _edges(spark, sf_dir), 3)


@QUERIES.add(f"""
with {EDGES_SQL}, {BOTH_SQL}, hub as (select node, count(*) as n from (select src as node from edges union all select dst from edges) group by node having count(*) >= 3),
summary as (select node as hub, node || ' ' || array_to_string(list_sort(list(distinct b))[1:50], ' ') as summary from hub join both_ways on a = node group by node)
select question, hub, hits, rank from (select *, row_number() over (partition by question order by hits desc, hub) as rank from (
  select id as question, hub, len(list_filter(list_distinct(regexp_extract_all(t, '[A-Za-z]+')), lambda w: list_contains(string_split(lower(summary), ' '), lower(w)))) as hits from {sql_values(QUESTIONS, 'id, t')}, summary) where hits > 0) where rank <= 2
""")
def community_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The communities whose members a question names most, two at most."""
    edges = _edges(spark, sf_dir)
    return G.community_search(values(spark, QUESTIONS, "question int, t string"), "question", "t", edges, 3, 50, 2)


PATHS_SQL = f"""with recursive {EDGES_SQL}, {BOTH_SQL}, walk as (
  select r_name as seed, r_name as node, cast([] as varchar[]) as es, 0 as length from region
  union all select seed, b, list_append(es, edge), length + 1 from walk join both_ways on a = node where length < 3 and not list_contains(es, edge)
), found as (select seed, length, array_to_string(es, ' | ') as path, node from walk where length > 0), ranked as (select *, row_number() over (partition by seed order by length, path) as rank from found)"""


@QUERIES.add(f"{PATHS_SQL} select seed, length, path, node from ranked where rank <= 50")
def graph_khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "region").select(F.col("r_name").alias("seed"))
    return G.paths(seeds, _edges(spark, sf_dir), 3, 50)


@QUERIES.add(f"""{PATHS_SQL}, said as (select seed, path, len(string_split(path, ' | ')) as steps, {SQL_TOKENS.replace("text", "replace(path, '_', ' ')")} as words from ranked where rank <= 50)
select seed, path, score, rank from (select seed, path, round(hits / len(words), 6) as score, row_number() over (partition by seed order by round(hits / len(words), 6) desc, steps, path) as rank
  from (select *, len(list_filter(words, lambda w: list_contains(['supplier', 'located', 'asia', 'europe'], w))) as hits from said)) where rank <= 8
""")
def path_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best eight paths of a seed by the share of their words that a question has; models' scores can take its place."""
    question = F.array(*map(F.lit, ("supplier", "located", "asia", "europe")))
    return G.rerank_paths(graph_khop(spark, sf_dir), question, 8)


@QUERIES.add(f"{PATHS_SQL} select seed, edge, min(rank) as first_rank from (select seed, rank, unnest(string_split(path, ' | ')) as edge from ranked where rank <= 50) group by seed, edge")
def path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = graph_khop(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy("length", "path")))
    return ranked.select("seed", "rank", F.explode(F.split("path", " \\| ")).alias("edge")).groupBy("seed", "edge").agg(F.min("rank").alias("first_rank"))


@QUERIES.add(f"""{PATHS_SQL} select seed, path, round(1.0 / (1 + n_new), 6) as score from (select r.seed, r.path, count(distinct e.edge) filter (where f.first_rank = r.rank) as n_new from ranked r, (select seed, rank, unnest(string_split(path, ' | ')) as edge from ranked where rank <= 50) e,
  (select seed, edge, min(rank) as first_rank from (select seed, rank, unnest(string_split(path, ' | ')) as edge from ranked where rank <= 50) group by all) f where r.rank <= 50 and e.seed = r.seed and e.rank = r.rank and f.seed = e.seed and f.edge = e.edge group by r.seed, r.path)""")
def graph_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = graph_khop(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy("length", "path")))
    edges = ranked.select("seed", "path", "rank", F.explode(F.split("path", " \\| ")).alias("edge"))
    first = F.min("rank").over(Window.partitionBy("seed", "edge"))
    return edges.withColumn("new", (first == F.col("rank")).cast("int")).groupBy("seed", "path").agg(F.round(1.0 / (1 + F.sum("new")), 6).alias("score"))


@QUERIES.add(f"with {EDGES_SQL} select dst as hub, '(' || src || ') -[' || name || ']-> (' || dst || ')' as fact from edges")
def graph_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select(F.col("dst").alias("hub"), F.concat(F.lit("("), "src", F.lit(") -["), "name", F.lit("]-> ("), "dst", F.lit(")")).alias("fact")).distinct()


@QUERIES.add(f"with {EDGES_SQL} select node, count(*) as degree from (select src as node from edges union all select dst from edges) group by node having count(*) >= 3 order by degree desc, node limit 50")
def hub_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hubs(_edges(spark, sf_dir), 3, 50)


@QUERIES.add(f"""with {EDGES_SQL}, {BOTH_SQL}, hub as (select node from (select src as node from edges union all select dst from edges) group by node having count(*) >= 3 order by count(*) desc, node limit 50)
select a as hub, array_to_string(list_sort(list(distinct b))[1:50], ',') as members, count(*) as n_facts from (select *, row_number() over (partition by a order by edge) as rn from both_ways where a in (select node from hub)) where rn <= 80 group by a""")
def community_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return G.communities(G.hubs(edges, 3, 50), edges, 50, 80).withColumn("members", F.array_join("members", ","))


@QUERIES.add(f"with {EDGES_SQL} select (select count(*) from (select src from edges union select dst from edges)) as entities, (select count(*) from edges) as relations, (select count(*) from documents) as documents, (select count(distinct source) from documents) as sources")
def schema_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, docs = _edges(spark, sf_dir), table(spark, sf_dir, "documents")
    counts = G.degrees(edges).agg(F.count("*").alias("entities"))
    for other in (edges.agg(F.count("*").alias("relations")), docs.agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources"))):
        counts = counts.join(F.broadcast(other), F.lit(True))  # one row each
    return counts


_CHAIN_SQL = f"""
qs as (select n_nationkey as question, 'Which suppliers are located in ' || n_name || ' or elsewhere in ' || r_name || ' and near CHINA?' as t from nation join region on n_regionkey = r_regionkey union all select -1, 'nothing named'),
degree as (select node, count(*) as degree from (select src as node from edges union all select dst from edges) group by node),
said as (select question, unnest(es) as node, generate_subscripts(es, 1) as pos from (select question, regexp_extract_all(t, '[A-Z][A-Za-z]+') as es from qs)),
start as (select question, node as seed, row_number() over (partition by question order by degree, lowest, node) as rank from (select question, node, min(pos) as lowest from said group by all) join degree using (node) qualify rank <= 6),
walk as (select seed, seed as node, cast([] as varchar[]) as es, 0 as length from (select distinct seed from start)
  union all select seed, b, list_append(es, edge), length + 1 from walk join both_ways on a = node where length < 2 and not list_contains(es, edge)),
around as (select seed, length, array_to_string(es, ' | ') as path, node from walk where length > 0 qualify row_number() over (partition by seed order by length, array_to_string(es, ' | ')) <= 50),
met as (select question, length, path, min(node) as node from start join around using (seed) group by all),
worded as (select *, {SQL_TOKENS.replace("text", "replace(path, '_', ' ')")} as words from met join (select question, {SQL_TOKENS.replace("text", "t")} as asked from qs) using (question)),
best as (select question, path, node, row_number() over (partition by question order by round(len(list_filter(words, lambda w: list_contains(asked, w))) / len(words), 6) desc, length, path) as rank from worded qualify rank <= 8),
nodes as (select question, node from best union select question, seed from start),
few as (select n_name as node, c_custkey as chunk, c_name || ' of ' || n_name as line, c_acctbal as weight from customer join nation on c_nationkey = n_nationkey qualify row_number() over (partition by n_name order by c_acctbal desc, c_custkey) <= 3),
found as (select question, line, row_number() over (partition by question order by weight desc, chunk) as rank from (select question, chunk, max(weight) as weight, min(line) as line from nodes join few using (node) group by all) qualify rank <= 3),
hub as (select node from degree where degree >= 3), summary as (select node as hub, lower(node || ' ' || array_to_string(list_sort(list(distinct b))[1:50], ' ')) as summary from hub join both_ways on a = node group by node),
hits as (select question, hub, len(list_filter(list_distinct(regexp_extract_all(t, '[A-Za-z]+')), lambda w: list_contains(string_split(summary, ' '), lower(w)))) as hits from qs, summary),
near as (select question, hub, row_number() over (partition by question order by hits desc, hub) as rank from hits where hits > 0 qualify rank <= 2)
"""


@QUERIES.add(f"""
with recursive {EDGES_SQL}, {BOTH_SQL}, {_CHAIN_SQL}
select question, coalesce((select string_agg(seed, chr(10) order by rank) from start where start.question = qs.question), '') as seeds, coalesce((select string_agg(path, chr(10) order by rank) from best where best.question = qs.question), '') as facts,
  coalesce((select string_agg(line, chr(10) order by rank) from found where found.question = qs.question), '') as evidence, coalesce((select string_agg(hub, chr(10) order by rank) from near where near.question = qs.question), '') as communities from qs
""")
def graph_answer_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole graph chain: six seeds, paths of two hops, the eight that share most words with the question, three pieces of evidence, two communities."""
    n, edges = table(spark, sf_dir, "nation"), _edges(spark, sf_dir)
    asked = n.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("question"), F.concat(F.lit("Which suppliers are located in "), "n_name", F.lit(" or elsewhere in "), "r_name", F.lit(" and near CHINA?")).alias("t"))
    questions = asked.unionByName(values(spark, [(-1, "nothing named")], "question long, t string"))
    customers = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    chunks = customers.select(F.col("n_name").alias("node"), F.col("c_custkey").alias("chunk"), F.concat("c_name", F.lit(" of "), "n_name").alias("line"), F.col("c_acctbal").alias("weight"))
    return G.answer_context(questions, edges, chunks)
