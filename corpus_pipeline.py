"""Corpus pipeline: stages over ``documents``, each written and read again.

Every stage takes (spark, docs, sf_dir), works on all that the stage before
kept, and returns documents with the same columns; the last returns the packed
pieces. Documents that a stage rejects are gone for the next one:

1. quality rules: documents that the rules reject go, and lines that too many
   distinct documents of a host have are taken out of the texts that stay;
2. near duplicates (five-word shingles, similarity 0.8): one of each group stays;
3. benchmark decontamination: documents that hold a test item go;
4. personal data: spans are masked by their kind;
5. best-fit packing of the texts into sequences.

Null and empty texts fail the quality rules. An empty table gives an empty
result. Columns that a stage doesn't name stay as they are; ``n_chars`` follows
the text where the table has it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm import decontamination, near_dedup, packing, pii, quality
from pricelens.llm.common import read_table, short_batches
from pricelens.llm.queries import SEQUENCE, vocabulary
from pricelens.session import ensure_checkpoint_dir


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without boilerplate lines."""
    short_batches(spark)
    return _measured(quality.keep_good(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates."""
    return near_dedup.keep_first(docs, width=5, percent=80)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return _measured(pii.masked(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' pieces and their places in sequences."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), SEQUENCE)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("decontamination", without_benchmarks),
          ("personal data", private_data), ("packing", pack)]

#: SQL expresses neither the packing plan nor the vocabulary's merges; the tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the table of documents; the last one's rows."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
