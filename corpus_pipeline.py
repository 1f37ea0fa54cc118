"""The corpus pipeline: documents to packed training sequences.

Each stage applies one operator of ``corridor.llm`` to all that the stage
before it kept; its output is written as Parquet and read again as the next
one's documents.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor.llm import line_dedup, minhash, mixing, packing, quality_rules
from corridor.llm._store import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _only(df: DataFrame, keep, text: str = "clean_text") -> DataFrame:
    """Rows where ``keep`` holds, with ``text`` as their text.  The two travel
    as one exploded struct, so that what they are computed from is computed
    once; a plain filter would repeat it below the projection."""
    rest = [c for c in COLUMNS if c != "text"]
    one = F.filter(F.array(F.struct(keep.alias("keep"), F.col(text).alias("text"))), lambda x: x["keep"])
    return _documents(df.select(*rest, F.explode(one).alias("one")).select(*rest, F.col("one.text").alias("text")))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines."""
    return _only(quality_rules.quality_rules(docs), F.col("kept"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that an earlier one has; those of
    which no word is left go, near copies are left to the next stage."""
    d = line_dedup.line_dedup(docs)
    return _only(d, (F.col("n_deleted") == 0) | F.coalesce(F.col("clean_text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True)))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest id."""
    docs = docs.select(*COLUMNS).withColumn("node", F.xxhash64("text"))
    kept = minhash.NearDuplicates(docs).kept().select(F.col("doc_id").alias("kept_id"), F.col("node").alias("kept_node"))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("node") == F.col("kept_node"))
    return _documents(docs.dropDuplicates(["doc_id", "node"]).join(kept, same))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes; documents that it has twice are there twice."""
    return _documents(mixing.Mix(docs).documents(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", clean),
    ("line_dedup", dedup_lines),
    ("minhash", dedup_documents),
    ("mixing", mix),
    ("packing", pack),
]

#: Packing needs a tokenizer, which SQL has not; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
