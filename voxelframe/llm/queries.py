"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard_join, line_dedup, mixing, quality_rules, sharding, site_bayes, substring_dedup, topk_search, url_filter
from .common import documents
from .oracle import SQL  # noqa: F401


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(documents(spark, sf_dir))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), tokenizer_path())


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(documents(spark, sf_dir, "pages"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op8_site_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_bayes.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup(documents(spark, sf_dir).select("doc_id", "text"), info=True)
    return got.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_bpe, op3_topk_search, op4_url_filter, op5_jaccard_join, op6_mixing, op7_quality_rules, op8_site_bayes, op9_sharding, op10_line_dedup)
}
