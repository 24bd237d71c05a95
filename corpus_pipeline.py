"""A corpus from raw documents to packed sequences: quality rules, near-dedup, substring dedup, mixing, packing.

Null and empty texts fail the quality rules, so later stages only see them if called by themselves: near-dedup keeps them, each in
a class of its own; substring dedup lets them go, as nothing is left; mixing keeps them; packing gives them no row. An empty
table gives an empty result at each stage. Texts of any length are taken whole, and further columns are carried up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomlake.llm.cluster import saved, where_computed
from fathomlake.llm.fmindex import substring_dedup
from fathomlake.llm.mixing import mixing_rates
from fathomlake.llm.neardup import near_duplicates
from fathomlake.llm.packing import pack_documents
from fathomlake.llm.quality import quality_rules


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules. Rows are judged one by one, repeated ones alike."""
    return where_computed(quality_rules(docs), F.col("kept")).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: that of the smallest id. Rows without an id stay too, and all rows that share that id."""
    gone = near_duplicates(docs).where("doc_id <> class_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 13 words and more that a document of smaller id holds; a document of which nothing is left goes.

    Rows that share an id don't take passages from each other; rows without one lose nothing.
    """
    out = substring_dedup(docs).where(F.col("kept") != "")
    return out.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate, rounded by a hash of its id, and at least once; repeated rows each."""
    rates = mixing_rates(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rates.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return pack_documents(docs)


STAGES = [("quality rules", quality_stage), ("near dedup", near_dedup_stage), ("substring dedup", substring_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL can't express near-dedup, mixing and packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = saved(docs) if k < len(STAGES) - 1 else docs
    return docs
