"""Training corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from signaldesk.llm import bpe, decontam, quality_rules, simhash, toxicity
from signaldesk.llm.common import shared_folder, table
from signaldesk.runtime import prepare

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep; null and empty texts go."""
    return quality_rules.clean_documents(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the network is trained on labelled rows that are still there."""
    prepare(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    prepare(spark)
    return simhash.drop_near_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    prepare(spark)
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the token count and the digests of ids and decoded text."""
    prepare(spark)
    return bpe.token_digests(docs, bpe.vocabulary_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_stage), ("toxicity", toxicity_stage), ("near copies", near_copy_stage),
    ("decontamination", decontamination_stage), ("tokens", token_stage)]

#: The network and the latent space have no SQL form; tests hold the stages against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is a written table, so a lost executor costs a read."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
