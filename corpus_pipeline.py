"""The corpus pipeline: quality rules, near copies, benchmark passages, secrets, encoding.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``, of which they only rely on
``doc_id`` and ``text``. Texts are read whole and every stage works on all rows its predecessor kept. Near copies are those of
the operator's own bound, a similarity of 0.85.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import bpe, decontaminate, neardup, quality, secrets
from tidegauge.llm.common import stored
from tidegauge.llm.queries import VOCABULARY
from tidegauge.session import pin_utc

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.filtered(docs).select(*COLUMNS)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; a repeated row stays once."""
    found = neardup.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("dropped")).distinct()
    return docs.select(*COLUMNS).join(found, F.col("doc_id") == F.col("dropped"), "left_anti").dropDuplicates()


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; ``n_chars`` is counted anew."""
    return secrets.masked(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of what is left."""
    return bpe.digests(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("quality rules", keep_quality), ("MinHash near-dedup", keep_one_copy), ("benchmark decontamination", drop_contaminated),
          ("secret scans", mask_secrets), ("BPE encoding and decoding", encode)]
#: Expectation-maximisation, connected components and byte-pair merges are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written to the shared folder and read as the next one's documents, so no stage is computed twice."""
    pin_utc(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for _, stage in first:
        docs = stored(stage(spark, docs, sf_dir), "pipeline")
    return last(spark, docs, sf_dir)
