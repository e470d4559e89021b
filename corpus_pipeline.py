"""Training corpus out of raw documents: filter, deduplicate, cut repeats, decontaminate, tokenize.

Every stage takes (spark, documents, folder of the tables) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. All but the last return the columns of
``documents``; all words stages take five words and a similarity of 0.8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakesteward.llm.common import saved
from lakesteward.llm.compression import accepted
from lakesteward.llm.contamination import decontaminated
from lakesteward.llm.hyperminhash import deduplicated
from lakesteward.llm.sampling import sampled_segmentations
from lakesteward.llm.suffixes import without_repeats


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    return accepted(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id."""
    return deduplicated(docs, words=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 200 bytes that start more than once go from the texts."""
    return without_repeats(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exactly or edited, go."""
    return decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, lossless: one sampled segmentation of each text."""
    return sampled_segmentations(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("leaks", leaks),
    ("pieces", pieces),
]

#: SQL cannot express the trained, sketched and sampled stages
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``, each stored before the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
