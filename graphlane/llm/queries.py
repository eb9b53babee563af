"""The opN_ queries of the corpus operators over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlane.llm.bpe import encode_and_decode
from graphlane.llm.common import bucket_of, table
from graphlane.llm.decontam import contamination
from graphlane.llm.exact_dedup import exact_dedup
from graphlane.llm.langid import identify
from graphlane.llm.licenses import license_scan
from graphlane.llm.minhash import near_duplicates
from graphlane.llm.paragraphs import repeated_paragraphs
from graphlane.llm.quality import quality_scores
from graphlane.llm.sharding import consistent_shards
from graphlane.llm.suffix_dedup import substring_dedup


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = bucket_of("doc_id", 4) == 2
    found = identify(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = bucket_of("doc_id", 3) == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_scores(docs, table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of a tree: corpus / runs of 256 ids / runs of 16 ids. The first id of a folder is its
    LICENSE, whatever it holds, so that what lies below inherits the licences that these have."""
    name = F.expr("if(doc_id % 16 = 0, 'LICENSE', cast(doc_id as string))")
    folders = F.expr("if(doc_id % 256 = 0, concat('run', doc_id div 256), concat('run', doc_id div 256, '/part', doc_id div 16))")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", F.lit("corpus"), folders, name).alias("path"), "text")
    return license_scan(docs, "path")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistent_shards(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"), digests=True)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_near_dedup, op2_exact_dedup, op3_language_id, op4_quality, op5_paragraph_dedup, op6_decontamination, op7_license_scan, op8_sharding, op9_bpe, op10_suffix_dedup)}

ORACLE_SQL = {
    "op2_exact_dedup": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256 FROM n JOIN g USING (text_sha256)""",
}
