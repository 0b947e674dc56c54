"""From raw documents to packed sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm.decontaminate import contamination
from corpusloom.llm.line_dedup import dedup_lines
from corpusloom.llm.near_copies import near_copies
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.quality_rules import judge
from corpusloom.llm.workspace import cut, fresh_dir, spread

#: Rows of dropped ids that may be sent to every task (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def _without(docs: DataFrame, gone: DataFrame, keys: list[tuple]) -> DataFrame:
    """docs without the rows whose keys (expressions over docs, columns of gone) are in gone; nulls match nulls."""
    gone = cut(gone)
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    on = None
    for mine, theirs in keys:
        same = mine.eqNullSafe(gone[theirs])
        on = same if on is None else on & same
    return docs.join(gone, on, "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged."""
    return judge(docs, only_kept=True)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; n_chars is that of the new text."""
    found = dedup_lines(docs)
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity of about 0.8 or more): that of the smallest id, then of the smallest hash of its text; rows of a null id come last."""
    groups = cut(near_copies(docs))
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key")
    heads = cut(groups.groupBy("root").agg(F.min(order).alias("head")))
    joined = groups.join(heads, "root")
    is_head = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & F.col("text_key").eqNullSafe(F.col("head.text_key"))
    repeated = joined.filter(is_head).count() > heads.count()
    gone = joined.filter(~is_head).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    kept = _without(docs, gone, [(docs["doc_id"], "gone_id"), (F.xxhash64(docs["text"]), "gone_key")])
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate, unchanged."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.filter("contaminated").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    return _without(docs, gone, [(docs["doc_id"], "gone_id"), (F.xxhash64(docs["text"]), "gone_key")])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a document, placed in sequences of at most 2048 tokens."""
    return pack_documents(docs, with_ids=False)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: Fertility and packing need tokenizers, which SQL has not; tests/llm compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = fresh_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        made.write.parquet(f"{out}/{k}-{name}")
        docs = spark.read.parquet(f"{out}/{k}-{name}")
    return docs
