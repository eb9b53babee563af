"""A training-corpus pipeline of five stages, each written as Parquet and read again before the next one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlane.llm.bpe import encode_and_decode
from graphlane.llm.common import bucket_of, table, written
from graphlane.llm.decontam import drop_contaminated
from graphlane.llm.exact_dedup import drop_exact_copies
from graphlane.llm.minhash import drop_near_duplicates
from graphlane.llm.quality import quality_scores

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.5 or more); it learns from the labels of ids whose
    crc32 modulo 3 is not 1."""
    scored = quality_scores(docs, table(spark, sf_dir, "labels"), bucket_of("doc_id", 3) != 1)
    return scored.where(F.col("score") >= 0.5).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal up to blanks, that with the least id."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the least id."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each document the number of its tokens and the digests of its ids and of the text decoded from them."""
    return encode_and_decode(docs, digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("decontamination", decontaminate),
    ("bpe", tokenize),
]

#: SQL can express neither the trained classifier nor the alignment.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, from the documents; each one's result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
