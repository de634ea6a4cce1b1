"""The training-corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage reads what the stage before it wrote and returns the columns of documents, the last one the packed pieces.
Near-dedup is operator 10's SimHash (fingerprints, blocks, pivot distance tables, components) of five-word shingle sets, and beyond it the exact
join of sets of similarity 0.8 or more, most of which SimHash alone would leave; one text of each group stays.
A document that line dedup leaves without a word is dropped there, as all of it stands in documents before.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm import common, decontaminate, linededup, neardup, packing, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = linededup.dedup_lines(docs)
    left = cut.where((F.col("_deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    columns = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("_deleted") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumns(columns).drop("_deleted")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs, max_bits=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]

#: Posteriors, alignment and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.write_table(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
