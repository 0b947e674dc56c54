"""One query per operator over its whole table, and the SQL of those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm.decontaminate import contamination
from corpusloom.llm.hard_negatives import hard_negatives
from corpusloom.llm.languages import identify_languages
from corpusloom.llm.license_scan import scan_licenses
from corpusloom.llm.line_dedup import dedup_lines
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.phrases import collocations
from corpusloom.llm.quality_classifier import classify
from corpusloom.llm.quality_rules import judge
from corpusloom.llm.simhash import near_duplicates
from corpusloom.llm.token_store import read_tokens, write_tokens
from corpusloom.llm.url_filter import Rule, filter_urls
from corpusloom.llm.warc import read_archives, write_archives
from corpusloom.llm.workspace import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table; texts are spread over the cores where their file has fewer row groups."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in ("documents", "pages") else found


URL_RULES = [Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"), Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block")]
#: The listed URLs are made by a rule: every 13th number below 60,000 in each language on these hosts.
LISTED_HOSTS = ["tionsh.example.net", "tionble.example.com", "tiontion.example.com", "ththth.example.net", "tionble.example.org", "ththon.example.org"]
LISTED_LANGS = ["en", "de", "fr", "es"]


def listed_urls(spark: SparkSession) -> DataFrame:
    numbers = spark.range(0, 60_000, 13).withColumnRenamed("id", "n")
    hosts = F.explode(F.array(*map(F.lit, LISTED_HOSTS))).alias("host")
    langs = F.explode(F.array(*map(F.lit, LISTED_LANGS))).alias("lang")
    return numbers.select("n", hosts).select("n", "host", langs).select(F.format_string("https://%s/%s/%d", "host", "lang", "n").alias("url"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_urls(_table(spark, sf_dir, "pages"), listed_urls(spark), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "canonical", "listed")


OP1_SQL = r"""
with listed as (
  select distinct h || '/' || l || '/' || cast(n as varchar) as key
  from range(0, 60000, 13) t(n), (values ('tionsh.example.net'), ('tionble.example.com'), ('tiontion.example.com'), ('ththth.example.net'), ('tionble.example.org'), ('ththon.example.org')) hs(h),
       (values ('en'), ('de'), ('fr'), ('es')) ls(l)
), cut as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest, coalesce(instr(url, '://') > 0, false) as has from pages
), parts as (
  select page_id, has, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) as q from cut
), canon as (
  select page_id, host, path,
         case when has then regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '') || regexp_replace(regexp_replace(path, '(/index)?\.html?$', ''), '/+$', '')
           || case when len(ps) > 0 then '?' || array_to_string(ps, '&') else '' end end as canonical
  from (select *, list_sort(list_filter(string_split(q, '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[a-z]*|ref|fbclid|gclid)(=|$)'))) as ps from parts)
), rules as (
  select * from (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) r(rh, rp, rv)
), fitting as (
  select page_id, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(rv, length(rh || rp)) as rv
  from canon join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id
)
select c.page_id, host, path, rule, coalesce(rv, case when l.key is not null then 'block' else 'allow' end) as verdict, canonical, l.key is not null as listed
from canon c left join fitting using (page_id) left join listed l on c.canonical = l.key
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.drop("text", "lang")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(_table(spark, sf_dir, "pages"))
    return read_archives(spark, manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as hex from pages
), heads as (
  select hex, payload_bytes, max(page_id) as head from p group by hex, payload_bytes
)
select page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         cast(((cast('0x' || substr(hex, cast(i // 4 * 5 + 1 as integer), 5) as bigint) >> cast(15 - 5 * (i % 4) as integer)) & 31) + 1 as integer), 1)), '') as payload_digest,
       case when page_id = head then 'response' else 'revisit' end as record_type, case when page_id = head then null else head end as refers_to
from p join heads using (hex, payload_bytes)
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
with lines as (
  select doc_id, generate_subscripts(ls, 1) as pos, unnest(ls) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)
), keyed as (
  select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines
), repeated as (
  select k, max(doc_id) as keeper from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3
), judged as (
  select doc_id, pos, line, r.k is not null and doc_id <> r.keeper as gone from keyed left join repeated r using (k)
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from judged group by doc_id
"""


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_tokens(_table(spark, sf_dir, "documents"))
    return read_tokens(spark, manifest, with_ids=False, digests=True).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), with_ids=False)


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


OP10_SQL = r"""
with bench as (
  select item_id, string_split(w, ' ') as w from (
    select item_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) as w from benchmark)
  where w <> ''
), windows as (
  select distinct item_id, least(len(w), 13) as n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) as s from bench)
), docs as (
  select doc_id, case when w = '' then [] else string_split(w, ' ') end as w from (
    select doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) as w from documents)
), grams as (
  select doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from docs cross join (select distinct n from windows))
), hits as (
  select doc_id, n, s, item_id from grams join windows using (n, g)
), places as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from hits) group by doc_id
), items as (
  select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hits group by doc_id
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from docs d left join places using (doc_id) left join items using (doc_id)
"""


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents
), worded as (
  select lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') as w from pieces
), f as (
  select lang, m, array_to_string(w[s:s + m - 1], ' ') as phrase, count(*) as f from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as s from worded, (values (1), (2), (3)) t(m)) group by all
), frequent as (
  select * from f where f >= 10
), totals as (
  select lang, cast(sum(f) as bigint) as n from f where m = 1 group by lang
), cuts as (
  select lang, m, phrase, f as a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') as p1, array_to_string(string_split(phrase, ' ')[k + 1:m], ' ') as p2 from (select *, unnest(range(1, m)) as k from frequent where m > 1)
), scored as (
  select c.*, x.f as l, y.f as r, cast((1000000::hugeint * a * a) // (x.f::hugeint * y.f) as bigint) as score from cuts c join frequent x on x.lang = c.lang and x.phrase = p1 join frequent y on y.lang = c.lang and y.phrase = p2
), worst as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), covers as (
  select lang, inner_, max(f) as longer from (select lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) as inner_ from frequent where m = 3) group by all
), kept as (
  select w.* from worst w left join covers v on v.lang = w.lang and v.inner_ = w.phrase where v.longer is null or 100 * v.longer < 50 * w.a
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from kept join totals using (lang)
qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(found.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


OP12_SQL = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), met as (
  select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), positives as (
  select anchor_id, other as positive_id, score as positive_score from met where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5
)
select p.anchor_id, positive_id, cast(row_number() over w as integer) as rank, other as negative_id, positive_score, score as negative_score
from positives p join met m on m.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
window w as (partition by p.anchor_id, positive_id order by score desc, other)
qualify row_number() over w <= 10
"""


def op13_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_simhash": op2_simhash,
    "op3_quality_rules": op3_quality_rules,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_license_scan": op5_license_scan,
    "op6_warc": op6_warc,
    "op7_line_dedup": op7_line_dedup,
    "op8_token_store": op8_token_store,
    "op9_packing": op9_packing,
    "op10_winnowing": op10_winnowing,
    "op11_phrases": op11_phrases,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_languages": op13_languages,
}
ORACLES = {"op1_url_filter": OP1_SQL.strip(), "op6_warc": OP6_SQL.strip(), "op7_line_dedup": OP7_SQL.strip(), "op10_winnowing": OP10_SQL.strip(), "op11_phrases": OP11_SQL.strip(), "op12_hard_negatives": OP12_SQL.strip()}
