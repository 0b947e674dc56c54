"""Vector and keyword search, fusion, reranking and context building.

The vectors have no link to documents in the test tables: where both channels
are fused, a vector stands for the document or benchmark item of the same id,
which makes the ranking checkable but not meaningful.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusloom.functions import patterns as P, text as X
from corpusloom.operators import retrieval as R, similarity as S
from corpusloom.operators.fragments import fragment_hits
from corpusloom.operators.keyword_index import KeywordIndex
from corpusloom.operators.rounds import retrieve_until
from corpusloom.operators.vector_index import VectorIndex
from corpusloom.plans.registry import Catalogue, table
from corpusloom.session import cut, fresh_dir, held
from corpusloom.plans.text_queries import SQL_TOKENS

QUERIES = Catalogue()
TOP, POOL = 5, 20

BM25_SQL = f"""
d as (select doc_id, {SQL_TOKENS} as tokens from documents),
q as (select item_id as query_id, {SQL_TOKENS} as tokens from benchmark),
terms as (select query_id, term, count(*) as qtf from (select query_id, unnest(tokens) as term from q) group by all),
p as (select doc_id, dl, term, count(*) as tf from (select doc_id, len(tokens) as dl, unnest(tokens) as term from d) group by all),
dfs as (select term, count(*) as df from p group by term),
size as (select count(*) as n, avg(len(tokens)) as avgdl from d),
idfs as (select term, ln(n - df + 0.5) - ln(df + 0.5) as idf0 from dfs, size),
means as (select avg(idf0) as mean_idf from idfs),
bm as (select query_id, doc_id, round(sum(qtf * case when idf0 < 0 then 0.25 * mean_idf else idf0 end * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
  from terms join p using (term) join idfs using (term), size, means group by query_id, doc_id),
bm25 as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from bm where score > 0) where rank <= {POOL})
"""
VEC_SQL = f"""
e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
vec as (select * from (select q.vec_id as query_id, c.vec_id as doc_id, round(list_cosine_similarity(q.v, c.v), 6) as score, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.v, c.v), 6) desc, c.vec_id) as rank
  from e q, e c where q.vec_id in (select item_id from benchmark) and c.vec_id in (select doc_id from documents)) where rank <= {POOL})
"""
RRF_SQL = f"""
hits as (select query_id, doc_id, rank, greatest(0.0, least(1.0, score)) as relevance from vec union all select query_id, doc_id, rank, round(score / (max(score) over (partition by query_id) + 1e-9), 6) from bm25),
fused as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from (select query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) as score, max(relevance) as relevance from hits group by all))
"""


def _bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return R.bm25(R.tokenized(table(spark, sf_dir, "benchmark"), "item_id", "query_id"), docs, k)


def _vectors(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    queries = held(e, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    known = e.select("vec_id").join(table(spark, sf_dir, "documents", ["doc_id"]), F.col("vec_id") == F.col("doc_id"), "left_semi")  # ids alone
    corpus = held(e, known, "vec_id").select("vec_id", F.col("embedding").alias("v"))
    return S.nearest(queries, corpus, k).select("query_id", F.col("vec_id").alias("doc_id"), "score", "rank")


def _fused(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    keyword = _bm25(spark, sf_dir, POOL)
    best = F.max("score").over(Window.partitionBy("query_id"))
    keyword = keyword.select("query_id", "doc_id", "rank", F.round(F.col("score") / (best + 1e-9), 6).alias("relevance"))
    vectors = _vectors(spark, sf_dir, POOL).select("query_id", "doc_id", "rank", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("relevance"))
    return R.reciprocal_rank_fusion(vectors.unionByName(keyword), k)


@QUERIES.add(f"with {BM25_SQL} select n as n_docs, round(avgdl, 6) as avgdl, (select count(*) from dfs) as n_terms, round(mean_idf, 6) as mean_idf from size, means")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.corpus_stats(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return found.select("n_docs", F.round("avgdl", 6).alias("avgdl"), "n_terms", F.round("mean_idf", 6).alias("mean_idf"))


@QUERIES.add(f"with {BM25_SQL} select query_id, doc_id, rank, round(score / (max(score) over (partition by query_id) + 1e-9), 4) as relevance from bm25 where rank <= {TOP}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max("score").over(Window.partitionBy("query_id"))
    return _bm25(spark, sf_dir, TOP).select("query_id", "doc_id", "rank", F.round(F.col("score") / (best + 1e-9), 4).alias("relevance"))


@QUERIES.add(f"with {BM25_SQL} select query_id, doc_id, rank, round(score / (max(score) over (partition by query_id) + 1e-9), 4) as relevance from bm25 where rank <= {TOP}")
def keyword_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of bm25_topk from a stored index that was filled by two inserts, the second of which finds most documents there."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    index = KeywordIndex(spark, fresh_dir(spark, "keywords"), buckets=16)
    index.insert(docs.filter("doc_id % 10 <> 3"))
    index.insert(docs)
    found = index.search(R.tokenized(table(spark, sf_dir, "benchmark"), "item_id", "query_id"), TOP)
    best = F.max("score").over(Window.partitionBy("query_id"))
    return found.select("query_id", "doc_id", "rank", F.round(F.col("score") / (best + 1e-9), 4).alias("relevance"))


@QUERIES.add()
def iterative_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of benchmark answered in three rounds at most from a stored keyword index; the reader, a rule in place of a model, wants passages from enough sources and asks for the longest words of the last one."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "source", "text"])
    index = KeywordIndex(spark, fresh_dir(spark, "keywords"), buckets=16)
    index.insert(docs)

    def retrieve(asked: DataFrame) -> DataFrame:
        hits = cut(index.search(asked.select("query_id", X.tokens(F.col("text")).alias("tokens")), 2))
        lines = held(docs, hits, "doc_id").select("doc_id", F.concat(F.lit("["), "source", F.lit("] "), F.substring_index("text", "\n", 1)).alias("passage"))
        return hits.join(lines, "doc_id").select("query_id", "rank", "passage")

    return retrieve_until(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question")), retrieve, source_reader)


def source_reader(asked: DataFrame) -> DataFrame:
    """(query_id, answer): the sources of the context if they are 2 to 4, as the id wants, else a wish for the two longest words of its last line."""
    sources = F.array_sort(F.array_distinct(F.regexp_extract_all("context", F.lit(r"(?m)^\[(\w+)\]"), 1)))
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.element_at(F.split("context", "\n", -1), -1)), F.lit("[a-z]+"), 0))
    longest = F.transform(F.slice(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, 2), lambda x: x["w"])
    enough = F.size(sources) >= 2 + F.col("query_id") % 3
    return asked.select("query_id", F.when(enough, F.concat(F.lit("From "), F.array_join(sources, ", "))).otherwise(F.concat(F.lit("NEED_MORE: "), F.array_join(longest, ", "))).alias("answer"))


@QUERIES.add("""
with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings)
select query_id, vec_id, score, 1 - score as distance, rank from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from (select q.vec_id as query_id, c.vec_id, round(list_cosine_similarity(q.v, c.v), 6) as score from e q, e c where q.vec_id % 20 = 0)) where rank <= 5
""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    found = S.nearest(e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select("vec_id", F.col("embedding").alias("v")), 5)
    return found.select("query_id", "vec_id", "score", (1 - F.col("score")).alias("distance"), "rank")


@QUERIES.add("""
with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings)
select query_id, vec_id, score, rank from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from (select q.vec_id as query_id, c.vec_id, round(list_cosine_similarity(q.v, c.v), 6) as score from e q, e c where q.vec_id % 20 = 0)) where rank <= 10
""")
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact neighbours from a stored index of cells that was filled by two inserts."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select("vec_id", F.col("embedding").alias("v"))
    index = VectorIndex(spark, fresh_dir(spark, "vectors"))
    index.insert(rows.filter("vec_id % 10 <> 3"))
    index.insert(rows)
    return index.search(e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 10, exact=True)


@QUERIES.add("select count(*) as n, count(distinct len(embedding)) = 1 as consistent, max(len(embedding)) as dimension from embeddings")
def dim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size("embedding")
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"), (F.count_distinct(n) == 1).alias("consistent"), F.max(n).alias("dimension"))


@QUERIES.add("""
with old as (select count(*) as n, sum(n_chars) as c, max(doc_id) as m from documents where doc_id % 10 <> 3), new as (select count(*) as n, sum(n_chars) as c, max(doc_id) as m from documents)
select 'unchanged' as corpus, false as stale union all select 'grown', old.n <> new.n or old.c <> new.c or old.m <> new.m from old, new
""")
def bm25_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a keyword index of an earlier state of the corpus must be built anew, by fingerprints that are sums."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    return R.stale(docs, docs, "unchanged").unionByName(R.stale(docs.filter("doc_id % 10 <> 3"), docs, "grown"))


@QUERIES.add(f"with {BM25_SQL}, {VEC_SQL}, {RRF_SQL} select query_id, doc_id, score, relevance, rank from fused where rank <= {POOL}")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, POOL)


DENSITY_SQL = r"(select doc_id, coalesce(round(len(list_filter(ws, lambda x: regexp_matches(x, '[0-9]'))) / nullif(len(ws), 0), 4), 0) as density, regexp_matches(text, '(?s)\$\$.*?\$\$') as formula from (select *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as ws from documents))"


@QUERIES.add(f"""
with {BM25_SQL}, {VEC_SQL}, {RRF_SQL}
select query_id, doc_id, relevance, row_number() over (partition by query_id order by round(score * (case when formula then 1.25 else 1 end) * (1 + 0.25 * density), 9) desc, doc_id) as rank
from fused join {DENSITY_SQL} using (doc_id) where rank <= {POOL} qualify row_number() over (partition by query_id order by round(score * (case when formula then 1.25 else 1 end) * (1 + 0.25 * density), 9) desc, doc_id) <= 6
""")
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both channels fused, features of the pool's texts boosted, the best six kept; texts are read for the pool alone."""
    fused = cut(_fused(spark, sf_dir, POOL))
    texts = held(table(spark, sf_dir, "documents", ["doc_id", "text"]), fused, "doc_id").select("doc_id", X.matches(F.col("text"), P.DISPLAY_MATH).alias("formula"), X.numeric_density(F.col("text")).alias("density"))
    joined = fused.join(texts, "doc_id").withColumn("s", F.round(R.boosted(F.col("score"), F.col("formula"), F.col("density"), F.lit(True)), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("s"), "doc_id")
    return joined.select("query_id", "doc_id", "relevance", F.row_number().over(order).alias("rank")).filter("rank <= 6")


@QUERIES.add(f"""
select doc_id, round(score, 6) as score, row_number() over (partition by source order by round(score, 6) desc, doc_id) as rank from (
  select doc_id, source, n_chars / 1000.0 * (case when formula then 1.25 else 1 end) * (1 + 0.25 * density) as score from documents join {DENSITY_SQL} using (doc_id)) qualify row_number() over (partition by source order by round(score, 6) desc, doc_id) <= 10
""")
def feature_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    scored = table(spark, sf_dir, "documents").select("doc_id", "source", F.round(R.boosted(F.col("n_chars") / 1000.0, X.matches(text, P.DISPLAY_MATH), X.numeric_density(text), F.lit(True)), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "doc_id"))).filter("rank <= 10").select("doc_id", "score", "rank")


@QUERIES.add(f"""
with {BM25_SQL}, {VEC_SQL}, {RRF_SQL}
select query_id, doc_id, relevance, row_number() over (partition by query_id order by relevance desc, doc_id) as rank from
  (select f.query_id, f.doc_id, round(greatest(0, least(1, list_cosine_similarity(a.v, b.v))), 6) as relevance from fused f join e a on a.vec_id = f.query_id join e b on b.vec_id = f.doc_id where f.rank <= {POOL})
qualify row_number() over (partition by query_id order by relevance desc, doc_id) <= 6
""")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = cut(_fused(spark, sf_dir, POOL)).select("query_id", "doc_id")
    e = table(spark, sf_dir, "embeddings")
    q, d = (held(e.select(F.col("vec_id").alias(key), F.col("embedding").alias(key[0])), fused, key) for key in ("query_id", "doc_id"))
    scored = fused.join(q, "query_id").join(d, "doc_id").select("query_id", "doc_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), S.cosine(F.col("q"), F.col("d")))), 6).alias("relevance"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id"))).filter("rank <= 6")


@QUERIES.add("""
select conv_id, turn, round(case when m <= 0 then 0 else greatest(0, least(1, raw / m)) end, 6) as norm from (select *, max(raw) over (partition by conv_id) as m from (select conv_id, turn, (conv_id * 31 + turn * 17) % 41 - 20.0 as raw from conversations))
""")
def rerank_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "conversations").select("conv_id", "turn", ((F.col("conv_id") * 31 + F.col("turn") * 17) % 41 - 20.0).alias("raw"))
    m = F.max("raw").over(Window.partitionBy("conv_id"))
    clamped = F.when(m <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw") / m)))
    return raw.select("conv_id", "turn", F.round(clamped, 6).alias("norm"))


FRAGMENTS = ["$$", "the ", "api_key", "= 4"]
FRAGMENT_SQL = "(values " + ", ".join(f"({i}, '{f}')" for i, f in enumerate(FRAGMENTS)) + ") f(query_id, fragment)"
EXACT_SQL = rf"select query_id, doc_id, row_number() over (partition by query_id order by doc_id) as rank from {FRAGMENT_SQL}, documents where contains(lower(regexp_replace(text, '\s+', '', 'g')), lower(regexp_replace(fragment, '\s+', '', 'g'))) qualify row_number() over (partition by query_id order by doc_id) <= 5"


def _exact(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """First k documents that hold a fragment, white space aside; the fragments are a short list tested in one pass."""
    form = X.match_form(F.col("text"))
    held = F.array(*[F.when(form.contains("".join(f.split()).lower()), F.lit(i)) for i, f in enumerate(FRAGMENTS)])
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_compact(held)).alias("query_id"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))).filter(F.col("rank") <= k).select("query_id", "doc_id", "rank")


@QUERIES.add(EXACT_SQL)
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact(spark, sf_dir, 5)


MET_SQL = r"""
met as (select distinct query_id, doc_id from asked join (select doc_id, lower(regexp_replace(text, '\s+', '', 'g')) as hay from documents where text is not null) on contains(hay, form) where length(form) >= 2)
select query_id, doc_id, row_number() over (partition by query_id order by doc_id) as rank from met qualify row_number() over (partition by query_id order by doc_id) <= 5
"""


@QUERIES.add(rf"""
with raw as (select doc_id as query_id, unnest(list_transform(regexp_extract_all(text, '{P.FORMULA_FRAGMENT}'), lambda x: trim(trim(x, '$ ')))) as fragment from documents where doc_id % 20 = 0),
asked as (select distinct query_id, lower(regexp_replace(fragment, '\s+', '', 'g')) as form from raw), {MET_SQL}
""")
def fragment_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formulas of every 20th text looked up in all texts."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    asked = docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.explode(X.formula_fragments(F.col("text"))).alias("fragment"))
    return fragment_hits(asked, docs, 5)


@QUERIES.add(rf"""
with asked as (select distinct item_id as query_id, lower(regexp_replace(unnest(regexp_split_to_array(text, '[.!?\n]')), '\s+', '', 'g')) as form from benchmark), {MET_SQL}
""")
def sentence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of all of benchmark looked up in all texts."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.split("text", r"[.!?\n]", -1)).alias("fragment"))
    return fragment_hits(asked, table(spark, sf_dir, "documents", ["doc_id", "text"]), 5)


@QUERIES.add(f"""
with x as ({EXACT_SQL}), r as (select doc_id % 4 as query_id, doc_id, row_number() over (partition by doc_id % 4 order by n_chars desc, doc_id) as rank from documents qualify rank <= 8)
select query_id, doc_id, tier = 0 as exact, row_number() over (partition by query_id order by tier, rank, doc_id) as rank from
  (select query_id, doc_id, rank, 0 as tier from x union all select query_id, doc_id, rank, 1 from r where not exists (select 1 from x where x.query_id = r.query_id and x.doc_id = r.doc_id))
""")
def exact_first_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "doc_id")
    ranked = table(spark, sf_dir, "documents").select((F.col("doc_id") % 4).cast("int").alias("query_id"), "doc_id", "n_chars").withColumn("rank", F.row_number().over(order)).filter("rank <= 8")
    return R.exact_first(_exact(spark, sf_dir, 5), ranked)


RERANK_SQL = f"""
rr as (select query_id, doc_id, relevance, row_number() over (partition by query_id order by relevance desc, doc_id) as rank from
  (select f.query_id, f.doc_id, round(greatest(0, least(1, list_cosine_similarity(a.v, b.v))), 6) as relevance from fused f join e a on a.vec_id = f.query_id join e b on b.vec_id = f.doc_id where f.rank <= {POOL})
  qualify row_number() over (partition by query_id order by relevance desc, doc_id) <= 6)"""


def _neutral_sql(text: str) -> str:
    for pattern, _, _ in P.INJECTION:
        text = f"regexp_replace({text}, '(?i){pattern.replace(chr(39), chr(39) * 2)}', '{P.NEUTRALIZED}', 'g')"
    return text


@QUERIES.add(f"""
with {BM25_SQL}, {VEC_SQL}, {RRF_SQL}, {RERANK_SQL}, x as ({EXACT_SQL}),
kept as (select query_id, doc_id, 1.0 as relevance, rank, 0 as tier from x where query_id in (select item_id from benchmark)
  union all select query_id, doc_id, relevance, rank, 1 from rr where not exists (select 1 from x where x.query_id = rr.query_id and x.doc_id = rr.doc_id)),
ordered as (select query_id, doc_id, relevance, row_number() over (partition by query_id order by tier, rank, doc_id) as place from kept),
lines as (select query_id, place, relevance, '[Source: ' || source || ' | score=' || printf('%.6f', relevance) || ']' || chr(10) || {_neutral_sql("coalesce(text, '')")} as line from ordered join documents using (doc_id) where place <= 6)
select query_id, count(*) as passages, max(relevance) as top, max(relevance) >= 0.20 as grounded, sha256(string_agg(line, chr(10) || chr(10) order by place)) as context from lines group by query_id
""")
def hybrid_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from query to context: both channels fused, reranked by vectors, exact hits first, six passages neutralised and formatted, and whether they ground an answer."""
    exact = _exact(spark, sf_dir, 5).join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).distinct(), "query_id", "left_semi")
    ranked = cut(rerank_topk(spark, sf_dir))
    merged = R.exact_first(exact, ranked).filter("rank <= 6")
    scored = merged.join(ranked.select("query_id", "doc_id", "relevance"), ["query_id", "doc_id"], "left").withColumn("relevance", F.when(F.col("exact"), 1.0).otherwise(F.col("relevance")))
    scored = cut(scored.select("query_id", "doc_id", "relevance", "rank"))
    texts = held(table(spark, sf_dir, "documents", ["doc_id", "source", "text"]), scored, "doc_id").select("doc_id", "source", X.neutralize(F.coalesce("text", F.lit(""))).alias("passage"))
    line = F.concat(F.format_string("[Source: %s | score=%.6f]\n", F.col("source"), F.col("relevance")), F.col("passage"))  # relevance has six places
    lines = scored.join(texts, "doc_id").select("query_id", "rank", "relevance", line.alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n\n")  # six passages a query at most
    found = lines.groupBy("query_id").agg(F.count("*").alias("passages"), F.max("relevance").alias("top"), F.sha2(joined.cast("binary"), 256).alias("context"))
    return found.withColumn("grounded", F.col("top") >= 0.20)


@QUERIES.add("""
select conv_id, turn, parent, siblings from conversations join (select conv_id, string_agg(turn || ':' || text, chr(10) order by turn, text) as parent, count(*) as siblings from conversations group by conv_id) using (conv_id)
""")
def parent_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the whole texts of its siblings."""
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn").join(R.whole_parents(t), "conv_id")


@QUERIES.add("""
select conv_id, turn, parent_sha256, parent_chars, siblings from conversations join (
  select conv_id, sha256(coalesce(string_agg(turn || ':' || text, chr(10) order by turn, text), '')) as parent_sha256, coalesce(length(string_agg(turn || ':' || text, chr(10) order by turn, text)), 0) as parent_chars, count(*) as siblings
  from conversations group by conv_id) using (conv_id)
""")
def parent_expand_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole texts of a turn's siblings, built once a conversation and returned as hash and length."""
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn").join(R.parents(t), "conv_id")


@QUERIES.add("select doc_id, source, lang from documents where source = 'src3' and lang = 'en'")
def meta_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("source = 'src3' and lang = 'en'").select("doc_id", "source", "lang")


@QUERIES.add("""
select conv_id, sha256(string_agg('[Source: ' || role || ' | score=' || printf('%.4f', r) || ']' || chr(10) || text, chr(10) || chr(10) order by turn)) as context from
  (select *, case when turn % 3 = 0 then (turn % 11) / 16.0 else (turn % 13) / 16.0 end as r from conversations) group by conv_id
""")
def format_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.when(F.col("turn") % 3 == 0, (F.col("turn") % 11) / 16.0).otherwise((F.col("turn") % 13) / 16.0)
    line = F.concat(F.format_string("[Source: %s | score=%.4f]\n", F.col("role"), r), F.col("text"))
    hits = table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n\n")
    return hits.groupBy("conv_id").agg(F.sha2(joined.cast("binary"), 256).alias("context"))


@QUERIES.add("""
with e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings)
select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.v, b.v), 6) as similarity from e a join e b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 20 = 0 and round(list_cosine_similarity(a.v, b.v), 6) >= 0.2
""")
def near_dup_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("a"), "label", F.col("embedding").alias("q"))
    return S.links(asked, e.select(F.col("vec_id").alias("b"), "label", F.col("embedding").alias("v")), 0.2)


@QUERIES.add("""
with recursive e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
links as materialized (select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id where round(list_cosine_similarity(a.v, b.v), 6) >= 0.2),
reach as (select vec_id, vec_id as member from e union select r.vec_id, l.b from reach r join links l on l.a = r.member)
select vec_id, min(member) as class_id, (select count(*) from links where a = vec_id) as n_links from reach group by vec_id
""")
def near_dup_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors against all of their label, one row a vector; near_dup_vectors lists the links of every 20th alone."""
    return S.near_classes(table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("v")), 0.2)
