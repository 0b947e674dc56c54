"""Text features, cleaning, quality gates and chunking over documents and pages."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions import patterns as P, text as X
from corpusloom.functions.html import page_texts
from corpusloom.operators import chunking
from corpusloom.plans.registry import Catalogue, table

QUERIES = Catalogue()
SQL_TOKENS = rf"list_transform(regexp_extract_all(regexp_replace(coalesce(text, ''), '\\([A-Za-z]+)', ' \1 ', 'g'), '{P.TOKEN}'), lambda x: lower(x))"
SQL_BARE = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"
SQL_QUALITY = rf"""
  select *, case when n < 40 then 'short' when bad / n > 0.10 then 'encoding' when solid + math > 0 and (alnum + math) / (solid + math) < 0.50 then 'alphanumeric'
    when u < 8 then 'unique' when 1 - u / len(words) > 0.40 then 'repetition' else 'ok' end as reason
  from (select *, length(bare) as n, len(regexp_extract_all(bare, '{P.BAD_CHARACTER}')) as bad, length(bare) - length(regexp_replace(bare, '{P.DISPLAY_MATH}', '', 'g')) as math,
      length(regexp_replace(regexp_replace(bare, '{P.DISPLAY_MATH}', ' ', 'g'), '\s', '', 'g')) as solid, length(regexp_replace(regexp_replace(bare, '{P.DISPLAY_MATH}', ' ', 'g'), '[^\p{{L}}\p{{N}}]', '', 'g')) as alnum,
      regexp_extract_all(lower(bare), '{P.WORD}') as words, len(list_distinct(regexp_extract_all(lower(bare), '{P.WORD}'))) as u
    from (select *, {SQL_BARE} as bare from {{source}}))
"""


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixture, the same rows as in the SQL beside it."""
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], names: str) -> str:
    def literal(x) -> str:
        return "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"

    return "(values " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") fixture({names})"


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def made(spark: SparkSession, sf_dir: str, sql: str, rows: list[tuple], schema: str) -> DataFrame:
    """What a query over the given tables makes, in the columns of `schema`, and the rows of a fixture, which hold what the tables don't.

    The query is plain enough to be part of the SQL that the results are checked against (`sql_made`).
    """
    for name in _TABLES:
        if re.search(rf"\b(from|join) {name}\b", sql):
            view = f"{name}_{uuid.uuid4().hex}"
            table(spark, sf_dir, name).createOrReplaceTempView(view)
            sql = re.sub(rf"\b(from|join) {name}\b", rf"\1 {view}", sql)
    fixture = values(spark, rows, schema)
    found = spark.sql(sql).toDF(*fixture.columns)
    return found.select(*[F.col(c).cast(t) for c, t in fixture.dtypes]).unionByName(fixture)


def sql_made(sql: str, rows: list[tuple], names: str) -> str:
    return f"(select * from ({sql}) rows_made union all select * from {sql_values(rows, names)}) fixture({names})"


def texts_with(spark: SparkSession, sf_dir: str, rows: list[tuple]) -> DataFrame:
    """(id, t): the texts of documents, and the rows of a fixture, which hold what documents don't."""
    return table(spark, sf_dir, "documents", ["doc_id", "text"]).toDF("id", "t").unionByName(values(spark, rows, "id long, t string"))


def sql_texts_with(rows: list[tuple]) -> str:
    return f"(select doc_id as id, text as t from documents union all select * from {sql_values(rows, 'id, t')}) texts"


@QUERIES.add(rf"""
select doc_id, len({SQL_TOKENS}) as n_tokens,
  regexp_matches(text, '{P.DISPLAY_MATH}') or regexp_matches(text, '{P.INLINE_MATH}') or regexp_matches(text, '{P.LATEX_COMMAND}') as has_formula,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{P.TABLE_ROW}'))) >= 2 as has_table,
  regexp_matches(text, '{P.FORMULA_QUERY}') as formula_query,
  coalesce(round(len(list_filter(ws, lambda x: regexp_matches(x, '[0-9]'))) / nullif(len(ws), 0), 4), 0) as numeric_density
from (select *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as ws from documents)
""")
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(X.tokens(text)).cast("long").alias("n_tokens"), X.has_formula(text).alias("has_formula"), X.has_table(text).alias("has_table"), X.matches(text, P.FORMULA_QUERY).alias("formula_query"), X.numeric_density(text).alias("numeric_density")
    )


@QUERIES.add(rf"select doc_id, array_to_string({SQL_TOKENS}, ' ') as tokens from documents")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.tokens(F.col("text")), " ").alias("tokens"))


FORMULA_ROWS = [(1, r"see $\sigma^0 = 4$ and $$x + y$$ or \alpha_1 and T_b = 10^3"), (2, "no math at all"), (3, "$ a $ then $a$ twice"), (4, "")]


@QUERIES.add(f"""
select id, array_to_string(list_filter(fs, lambda x, i: list_position(list_transform(fs, lambda y: lower(regexp_replace(y, '\\s+', '', 'g'))), lower(regexp_replace(x, '\\s+', '', 'g'))) = i), ' | ') as fragments
from (select id, list_filter(list_transform(regexp_extract_all(t, '{P.FORMULA_FRAGMENT}'), lambda x: trim(trim(x, '$ '))), lambda x: length(regexp_replace(x, '\\s+', '', 'g')) >= 2) as fs from {sql_texts_with(FORMULA_ROWS)})
""")
def formula_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts_with(spark, sf_dir, FORMULA_ROWS).select("id", F.array_join(X.formula_fragments(F.col("t")), " | ").alias("fragments"))


@QUERIES.add(f"select doc_id, reason, reason = 'ok' as passed from ({SQL_QUALITY.replace('{source}', 'documents')})")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.quality_reason(F.col("text")).alias("reason")).withColumn("passed", F.col("reason") == "ok")


CHUNKS_SQL = "(select doc_id, unnest(list_transform(range(0, greatest(length(text), 1), 700), lambda s: {'idx': s // 700, 'text': substr(text, s + 1, 800)}), recursive := true) from documents)"


@QUERIES.add(f"select doc_id, count(*) as chunks, count(*) filter (where reason = 'ok') as kept from ({SQL_QUALITY.replace('{source}', CHUNKS_SQL)}) where doc_id in (select doc_id from ({SQL_QUALITY.replace('{source}', 'documents')}) where reason = 'ok') group by doc_id having count(*) filter (where reason = 'ok') > 0")
def quality_gate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(X.quality_reason(F.col("text")) == "ok")
    chunks = chunking.fixed_windows(docs.select("doc_id", "text"), "text", 800, 100)
    counted = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(X.quality_reason(F.col("chunk")) == "ok").alias("kept"))
    return counted.filter("kept > 0")


CLEAN_SQL = r"""
select doc_id, sha256(regexp_replace(array_to_string(list_transform(list_zip(string_split(regexp_replace(text, '(?s:\$\$.+?\$\$)|\$[^$\n]+\$', chr(1), 'g'), chr(1)), regexp_extract_all(text, '(?s:\$\$.+?\$\$)|\$[^$\n]+\$')),
  lambda z: regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(z[1], chr(173), '', 'g'), '([\p{L}\p{N}_]+)-\s*\n\s*([\p{L}\p{N}_]+)', '\1\2', 'g'), '[■□▪●•' || chr(65533) || ']', ' ', 'g'), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') || coalesce(z[2], '')), ''), '^\s+|\s+$', '', 'g')) as cleaned
from documents
"""


@QUERIES.add(CLEAN_SQL)
def clean_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.clean_markdown(F.col("text")).cast("binary"), 256).alias("cleaned"))


def _html_sql() -> str:
    x = "coalesce(html, '')"
    for tag in P.JUNK_TAGS:
        x = rf"regexp_replace({x}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', ' ', 'g')"
    x = rf"regexp_replace(regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g'), '(?is)^.*?<body\b[^>]*>', ''), '(?s)<[^>]+>', ' ', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return rf"select page_id, trim(regexp_replace({x}, '\s+', ' ', 'g')) as body from pages"


@QUERIES.add(_html_sql())
def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.strip_html(F.col("html")).alias("body"))


@QUERIES.add()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page text by parsing: nesting is followed, containers named as cookie bars, banners and so on go; html_clean keeps to what regexes can say."""
    return page_texts(table(spark, sf_dir, "pages", ["page_id", "html"])).select("page_id", "body")


FILES = [(1, "a/Report.PDF", 100), (2, "b/page.html", 5), (3, "notes.md", 9), (4, "sheet.xlsx", 7), (5, "pic.GIF", 30_000_000), (6, "x.exe", 1), (7, "noext", 2), (8, "pic.png", 2000)]
FILES_SQL = "select 100 + doc_id, source || '/' || doc_id || case doc_id % 6 when 0 then '.pdf' when 1 then '.HTML' when 2 then '.md' when 3 then '.xlsx' when 4 then '.gif' else '.exe' end, n_chars from documents"
FORMAT_ROWS = [tuple(f) for f in P.FORMATS]


@QUERIES.add(f"""
select id, source_type, category, gated, coalesce(enabled, false) as enabled from
  (select *, lower(regexp_extract(path, '\\.[^./]+$')) as suffix from {sql_made(FILES_SQL, FILES, 'id, path, n')}) f
  left join (select *, coalesce(switch, 'office') = 'office' as enabled from {sql_values(FORMAT_ROWS, 'sfx, source_type, category, gated, switch, pages')}) r on suffix = sfx
""")
def format_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.route_formats(made(spark, sf_dir, FILES_SQL, FILES, "id long, path string, n long"), switches={"office"}).select("id", "source_type", "category", "gated", "enabled")


@QUERIES.add(f"""
select doc_id, coalesce(source_type, 'unknown') as source_type, case when coalesce(pages, false) then page end as page, contains(lower(path), 'scan') or contains(lower(path), 'src1') as forced_ocr
from (select doc_id, 'In/' || source || case when doc_id % 7 = 0 then '/Scan' else '/file' end || ['.pdf', '.html', '.md', '.docx', '.bin'][cast(doc_id % 5 + 1 as integer)] as path, doc_id % 9 as page from documents)
left join {sql_values(FORMAT_ROWS, 'sfx, source_type, category, gated, switch, pages')} on lower(regexp_extract(path, '\\.[^./]+$')) = sfx
""")
def file_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of files by suffix: source type, page numbers only where the format keeps them, and whether a path asks for OCR of whole pages."""
    suffix = F.get(F.array(*map(F.lit, (".pdf", ".html", ".md", ".docx", ".bin"))), (F.col("doc_id") % 5).cast("int"))
    name = F.when(F.col("doc_id") % 7 == 0, "/Scan").otherwise("/file")
    files = table(spark, sf_dir, "documents", ["doc_id", "source"]).select("doc_id", F.concat(F.lit("In/"), "source", name, suffix).alias("path"), (F.col("doc_id") % 9).alias("page"))
    return chunking.metadata_defaults(files, ocr=("scan", "src1")).select("doc_id", "source_type", "page", "forced_ocr")


@QUERIES.add("select doc_id, length(text) as n from documents where length(text) <= 2000")
def size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.char_length("text").cast("long").alias("n")).filter("n <= 2000")


@QUERIES.add("select doc_id, sha256(text) as file_hash, sha256('{\"source\": \"' || source || '\", \"lang\": \"' || lang || '\"}') as node_hash, substr(sha256(cast(doc_id as varchar)), 1, 16) as session_hash from documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = F.concat(F.lit('{"source": "'), "source", F.lit('", "lang": "'), "lang", F.lit('"}'))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"), F.sha2(node, 256).alias("node_hash"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16).alias("session_hash"))


CHARSET_ROWS = [(-1, "tab\tand\nline"), (-2, "bell\x07"), (-3, "zero\u200bwidth"), (-4, "नमस्ते")]


@QUERIES.add(rf"select id, not regexp_matches(regexp_replace(t, '[\n\r\t]', '', 'g'), '\p{{C}}') as ok from (select doc_id as id, text as t from documents union all select * from {sql_values(CHARSET_ROWS, 'id, t')})")
def charset_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t")).unionByName(values(spark, CHARSET_ROWS, "id long, t string"))
    return rows.select("id", X.charset_ok(F.col("t")).alias("ok"))


MARKDOWN = [(1, "intro\n# One\nbody a\n## Two\nbody b\n### Three\nc\n# Four\nd"), (2, "no headers here"), (3, "# Only")]


@QUERIES.add(f"""
select id, cast(i - 1 as integer) as pos, regexp_extract(s, '^(#{{1,3}}) ', 1) as level, regexp_extract(s, '^#{{1,3}} ([^\\n]*)', 1) as header, s as body
from (select id, unnest(ss) as s, generate_subscripts(ss, 1) as i from (select id, list_filter(string_split(regexp_replace(t, '(^|\\n)(#{{1,3}} )', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x) <> '') as ss from {sql_texts_with(MARKDOWN)}))
""")
def header_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.header_sections(texts_with(spark, sf_dir, MARKDOWN), "t").select("id", "pos", "level", "header", F.col("section").alias("body"))


@QUERIES.add(f"select doc_id, cast(idx as integer) as idx, text as chunk from {CHUNKS_SQL}")
def fixed_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 800, 100)


@QUERIES.add()
def section_subsplit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.recursive_split(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 1600, 100)


@QUERIES.add(f"select doc_id, cast(idx as integer) as idx, substr(sha1(concat_ws('|', source, cast(idx as varchar), substr(text, 1, 64))), 1, 16) as chunk_id from (select c.*, source from {CHUNKS_SQL} c join (select doc_id, source from documents) using (doc_id))")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.fixed_windows(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text", 800, 100)
    return chunks.select("doc_id", "idx", chunking.chunk_id(F.col("source"), F.col("idx"), F.col("chunk")).alias("chunk_id"))


@QUERIES.add(r"""
select doc_id, len(ss) as n_sentences, len(list_filter(ss, lambda x: length(trim(x)) > 25)) as n_factual
from (select doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') as ss from documents)
""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = X.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(split).cast("long").alias("n_sentences"), F.size(F.filter(split, lambda x: F.char_length(F.trim(x)) > 25)).cast("long").alias("n_factual"))


@QUERIES.add("select source, sha256(substr(string_agg(text, chr(10) || chr(10) order by doc_id), 1, 6000)) as joined, count(*) as n from documents group by source")
def doc_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.concat_by(table(spark, sf_dir, "documents").select("source", "doc_id", "text"), "source", "doc_id", "text", 6000).select("source", F.sha2(F.col("joined").cast("binary"), 256).alias("joined"), "n")
