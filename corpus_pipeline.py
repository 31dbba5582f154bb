"""The corpus pipeline: documents to packed windows, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.llm.fertility import quality_rules
from skyweave.llm.jaccard_join import drop_near_duplicates
from skyweave.llm.line_templates import drop_recurring_lines
from skyweave.llm.mixing import take_documents
from skyweave.llm.packing import pack_documents
from skyweave.llm.queries import id_digest, vocabularies
from skyweave.session import shared_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# Tokenizer measures, regions of a metric space, flows and packing are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL: str | None = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the fertility bands keep."""
    return quality_rules(docs, **vocabularies(), carry=docs.columns).where("kept").select("document.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates; ``n_chars``, where there is one, counts the new text."""
    found = drop_recurring_lines(docs)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_dropped") > 0, F.char_length("text").cast(dict(docs.dtypes).get("n_chars", "bigint"))).otherwise(F.col("document")["n_chars"]) if "n_chars" in docs.columns else None}
    return found.select(*[new[c].alias(c) if c in new else F.col("document")[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component."""
    return drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return take_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 ids."""
    return id_digest(pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        path = shared_path(spark, f"pipeline-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
