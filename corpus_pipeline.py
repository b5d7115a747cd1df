"""A corpus from raw documents: toxic ones and near copies go, benchmark passages go, secrets are masked, sources are mixed.

Each stage takes what its predecessor kept, written as Parquet. All but the last return the columns
of documents; the last adds size, source_size, target and taken, and leaves out what the mix doesn't take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm.decontaminate import drop_contaminated
from trackloom.llm.mixing import mix
from trackloom.llm.neardup import drop_near_duplicates
from trackloom.llm.scratch import Scratch
from trackloom.llm.secrets import mask_secrets
from trackloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs).filter("taken > 0")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixing", mixing),
]

#: Learned scores, fuzzy groups and entropy spans aren't for SQL; tests compare each stage's rows with plain versions of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.keep_only(name)
    return docs
