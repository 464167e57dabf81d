"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corelode.llm import toxicity as grades
from corelode.llm.decontaminate import decontaminate
from corelode.llm.line_dedup import dedup_lines
from corelode.llm.near_dedup import near_duplicates
from corelode.llm.packing import pack
from corelode.session import keep

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

# Toxicity scores, sketches and token ids are beyond SQL: the tests compare stages with brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labels of these documents, does not reject."""
    model = grades.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return grades.reject_toxic(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated lines; ``n_chars`` follows the text."""
    fewer = dedup_lines(docs).select(*docs.columns)
    return fewer.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one with the least id. Rows without an id stay."""
    lost = near_duplicates(docs).filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("lost_id")).distinct()
    return docs.join(lost, docs["doc_id"] == lost["lost_id"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the training sequences."""
    return pack(docs, TOKENIZER)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each result but the last is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
