"""The corpus pipeline: toxicity, near-duplicates, secrets, mixing, packing, in this order.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. Stages but the last return the
columns of documents:

- toxicity drops the documents that a model trained on the labels rejects;
- near_dedup keeps one document of each group of near-duplicates;
- secrets replaces every secret in a text by a mark and keeps all rows;
- mixing repeats and cuts documents until each source has the words that its weight gives it;
- packing cuts the texts' ids into pieces and places them in sequences.

Cases: a null text counts as the empty one, which is neither toxic by evidence nor linked, holds no secret, has no words
and packs as its end id; it stays null. Rows with null or repeated ids are judged each by its own text. Repeated rows go
or stay by what their stage says of each. Ties are broken by hashes and ids, so reruns agree. Texts are read whole. Empty
tables give empty results. Further columns are kept under any name until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm import mixing, neardup, packing, secrets, toxicity
from loomfield.plans.shared import materialize


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The toxicity model is trained, which SQL can't express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
