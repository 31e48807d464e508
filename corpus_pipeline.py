"""Filtering a corpus of documents and packing it into training sequences, stage by stage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvigil.llm.decontaminate import decontaminate
from logvigil.llm.near_dedup import near_duplicates
from logvigil.llm.packing import pack_documents
from logvigil.llm.quality import score_documents, train
from logvigil.llm.queries import PACK_END, TOKENIZER
from logvigil.llm.secrets import redact_secrets
from logvigil.session import shared_dir, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it is fitted on labelled documents of this stage's input."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
    return score_documents(docs, model).where("predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every class; rows without an id stay."""
    classes = near_duplicates(docs.where("doc_id IS NOT NULL"))
    first = stage(classes.where("doc_id = class_id").groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n")), "first")
    kept = docs.join(first, docs["doc_id"] == first["_id"]).select(*docs.columns)
    if not first.where("_n > 1").isEmpty():  # rows with equal ids are one document
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; ``n_chars`` follows the text."""
    clean = redact_secrets(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint")))
    return clean.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 2048 tokens."""
    return pack_documents(docs, TOKENIZER, PACK_END)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

ORACLE_SQL = None  # SQL cannot express the classifier or the tokenizer; tests/llm/test_pipeline.py holds run() against a plain model


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet to the shared folder and read back by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (name, stage_) in enumerate(STAGES):
        stage_(spark, docs, sf_dir).write.parquet(path := f"{base}/{n}-{name}")
        docs = spark.read.parquet(path)
    return docs
