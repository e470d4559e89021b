"""The registered queries of the operators for training data, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakesteward.llm import oracles
from lakesteward.llm.alignment import aligned_tokens
from lakesteward.llm.block_search import top_products
from lakesteward.llm.compression import quality_scores
from lakesteward.llm.contamination import leaks
from lakesteward.llm.hyperminhash import near_duplicates
from lakesteward.llm.passages import near_duplicate_passages
from lakesteward.llm.pivots import nearest_vectors
from lakesteward.llm.sampling import sampled_segmentations
from lakesteward.llm.sharding import sharded
from lakesteward.llm.suffixes import repeat_removal
from lakesteward.llm.token_counts import token_counts
from lakesteward.llm.warc import archived_pages
from lakesteward.llm.whitening import whitened

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pivot_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings"), every=50, k=5)


def warc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(spark, table(spark, sf_dir, "pages"))


def compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_removal(table(spark, sf_dir, "documents"))


def trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_segmentations(table(spark, sf_dir, "documents"))


def compact_window_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_passages(table(spark, sf_dir, "documents"))


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def hyperminhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def sharded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"), 16)


def whitened_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


def tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_tokens(table(spark, sf_dir, "documents"))


def block_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), every=50, k=5)


QUERIES: dict[str, Query] = {
    "op1_permutation_index": pivot_neighbours,
    "op2_warc": warc_pages,
    "op3_compression_quality": compression_quality,
    "op4_suffix_repeats": suffix_repeats,
    "op5_token_counts": trie_token_counts,
    "op6_sharding": sharded_documents,
    "op7_compact_windows": compact_window_passages,
    "op8_benchmark_leaks": benchmark_leaks,
    "op9_sampled_pieces": sampled_pieces,
    "op10_hyperminhash": hyperminhash_groups,
    "op11_whitening": whitened_vectors,
    "op12_tokenizer_alignment": tokenizer_alignment,
    "op13_block_top_products": block_top_products,
}

ORACLES: dict[str, str] = {
    "op2_warc": oracles.WARC,
    "op4_suffix_repeats": oracles.REPEATS,
    "op6_sharding": oracles.SHARDING,
    "op10_hyperminhash": oracles.NEAR_DUPLICATES,
    "op13_block_top_products": oracles.TOP_PRODUCTS,
}
