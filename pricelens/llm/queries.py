"""The registered queries of the corpus operators: ``opN_<name>`` over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm import (decontamination, license_scan, merkle, near_dedup, packing, pii, prefix_tokens, quality, sharding, suffix_dedup, token_files, url_rules,
                           whitening)
from pricelens.llm.common import read_table

#: Tokens of a packed sequence, the limit of a whole text, and the shards.
SEQUENCE, LIMIT, SHARDS = 2048, 1024, 8


def vocabulary(name: str) -> str:
    """Where the installed public vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens. Null and empty texts are the end id alone; equal rows are interchangeable."""
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), SEQUENCE)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts of all whole texts. A null text counts as empty: 0 tokens."""
    return prefix_tokens.count_documents(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), LIMIT)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of every document. Null and empty texts have no words and fail."""
    return quality.digest(read_table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data of every document. Null and empty texts have none."""
    return pii.digest(read_table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat 50-byte strings of earlier documents. Null and empty texts keep nothing and lose nothing."""
    return suffix_dedup.removals(read_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the ``rows`` law. A null text has size 1; null ids sort first."""
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), SHARDS)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (document, benchmark item that it holds)."""
    found = decontamination.contaminations(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "passage_start", *[F.round(c, 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")])


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under word-pair similarity 0.8. Texts without words link with nothing."""
    return near_dedup.digest(read_table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, fitting rule and verdict of every page. A null url has an empty host and path."""
    return url_rules.judge_pages(read_table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document. Null and empty texts have none."""
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and what tampering does to them. Null fields are hashed as such; null ids come first."""
    return merkle.digest(read_table(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from bit-packed files. A null text is the end id alone."""
    return token_files.digest(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every usable embedding. Vectors that are null, empty or hold null or non-finite entries are dropped."""
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_best_fit_packing, op2_token_counts, op3_quality_rules, op4_pii, op5_suffix_dedup, op6_sharding, op7_decontamination, op8_near_duplicates, op9_url_filters,
        op10_license_scan, op11_merkle_manifest, op12_token_files, op13_embedding_whitening)}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {"op8_near_duplicates": near_dedup.DIGEST_SQL, "op6_sharding": sharding.shard_sql(SHARDS), "op9_url_filters": url_rules.JUDGE_SQL,
                           "op11_merkle_manifest": merkle.DIGEST_SQL}
