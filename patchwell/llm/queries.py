"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, exact_dedup, hard_negatives, html_extract, language_id, lexical_search, mixing, quality, sentencepiece_codec, simhash_dedup, substring_dedup, suffix_dedup, url_filter
from .common import tokenizer_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": lambda spark, d: embedding_dedup.near_duplicates(table(spark, d, "embeddings")),
    "op2_exact_dedup": lambda spark, d: exact_dedup.deduplicate(table(spark, d, "documents")),
    "op3_language_id": lambda spark, d: language_id.identify(table(spark, d, "documents")),
    "op4_suffix_dedup": lambda spark, d: suffix_dedup.remove_repeats(table(spark, d, "documents")),
    "op5_quality": lambda spark, d: quality.rate(table(spark, d, "documents"), table(spark, d, "labels")),
    "op6_substring_dedup": lambda spark, d: substring_dedup.remove_repeated_windows(table(spark, d, "documents")),
    "op7_sentencepiece": lambda spark, d: sentencepiece_codec.encode_decode(table(spark, d, "documents"), tokenizer_path(), outputs=False),
    "op8_mixing": lambda spark, d: mixing.mix(table(spark, d, "documents")).select(*mixing.QUERY_COLUMNS),
    "op9_html_extract": lambda spark, d: html_extract.extract(table(spark, d, "pages")),
    "op10_simhash_dedup": lambda spark, d: simhash_dedup.near_duplicates(table(spark, d, "documents")),
    "op11_hard_negatives": lambda spark, d: hard_negatives.contract(table(spark, d, "embeddings")),
    "op12_lexical_search": lambda spark, d: lexical_search.search(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op13_url_filter": lambda spark, d: url_filter.contract(table(spark, d, "pages"), table(spark, d, "labels")).select(*url_filter.QUERY_COLUMNS),
}
ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": embedding_dedup.ORACLE,
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
    "op13_url_filter": url_filter.ORACLE,
}
