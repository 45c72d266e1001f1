"""The corpus pipeline: five stages of the llm package over documents, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.staging import staged, unstage
from eventloom.llm.common import documents
from eventloom.llm.op1_decontaminate import decontaminate
from eventloom.llm.op3_fuzzy_lines import dedup_lines
from eventloom.llm.op4_quality_rules import quality
from eventloom.llm.op5_minhash import near_duplicates
from eventloom.llm.op9_mixing import mix_sources


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null and empty texts have no words and go; repeated rows are judged alike."""
    judged = quality(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")), keep=("row",))
    # The row number keeps the optimizer from putting the filter, with all measures written out again, below the projection.
    return judged.withColumn("at", F.monotonically_increasing_id()).where("kept AND at >= 0").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines, n_chars counted again; those that lose all their words go, for all they say stands elsewhere.

    Null texts stay as they are. A copy of a whole document thus goes here, by its lines, before the next stage sees it.
    """
    out = dedup_lines(docs).where((F.col("n_removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the smallest doc_id. Texts without words are alone and stay."""
    copies = staged(near_duplicates(docs).where("NOT kept").select("doc_id"), "copies")
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item. Null texts hold none and stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents by their source's rate, in one shuffled order; adds copy and rate. Null is a source like any other."""
    return mix_sources(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("source_mixing", mixing_stage),
]

#: SQL can't express the MinHash stages; tests/llm holds the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written, and its predecessor's table removed. An empty table gives an empty result."""
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
        unstage(*before)
        before = [docs]
    return docs
