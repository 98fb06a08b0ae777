"""The queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from .codebooks import compressed
from .common import read
from .exact_dedup import exact_groups
from .exact_topk import nearest
from .line_dedup import drop_repeated_lines
from .mixing import mix
from .negatives import hard_negatives
from .pieces import sampled_pieces
from .quality import quality_verdicts
from .simhash import near_groups
from .sql import ORACLE as ORACLE
from .substring_dedup import remove_repeated_words
from .suffix_dedup import remove_repeated_bytes
from .token_counts import counts_after, redactions
from .warc import archived


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after its personal data is replaced."""
    docs = read(spark, sf_dir, "documents")
    return counts_after(docs, redactions(docs))


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents")).drop("text_hash")


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(read(spark, sf_dir, "documents"))


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the sampled segmentations of every document."""
    sampled = sampled_pieces(read(spark, sf_dir, "documents"))
    return sampled.select("doc_id", "sample", "n_pieces", F.sha2("pieces", 256).alias("pieces_sha256"), "log_probability", "perturbed", "log_inclusion", "round_trip")


def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(read(spark, sf_dir, "pages"))


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(read(spark, sf_dir, "documents"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("text_hash")


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(read(spark, sf_dir, "documents"))


def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))


def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(read(spark, sf_dir, "embeddings"))


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_token_counts": token_counts,
    "op2_exact_dedup": exact_dedup,
    "op3_suffix_array_dedup": suffix_dedup,
    "op4_sentencepiece": pieces,
    "op5_mixing": mixing,
    "op6_warc": warc,
    "op7_simhash": simhash,
    "op8_substring_dedup": substring_dedup,
    "op9_quality_rules": quality,
    "op10_line_dedup": line_dedup,
    "op11_exact_topk": exact_topk,
    "op12_hard_negatives": negatives,
    "op13_vector_codes": vector_codes,
    "pipeline": corpus_pipeline.run,
}
