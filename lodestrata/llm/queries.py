"""The queries of the operators in this package: whole tables, production parameters, results as the contracts say."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import bpe, html_extract, minhash, mixing, pii, quality, quotes, sharding, suffix_tree, topk
from lodestrata.llm.shared import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.tokenize(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, ["doc_id"])


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.stored(table(spark, sf_dir, "documents"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op5_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op6_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quotes.link(table(spark, sf_dir, "conversations"))
    return out.withColumn("text_md5", F.md5(F.col("text").cast("binary"))).drop("text")


def quoted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotation linking (op6) of conversations whose messages quote one another, as the tables' own do not."""
    out = quotes.link(quotes.quoted_replies(table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "turn", "role", "parent_turn", "n_linked", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_tokens").alias("n_tokens"), F.col("_topic").alias("topic"), F.round("_probability", 6).alias("probability"), F.col("_kept").alias("kept"))


def op8_topk_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", topk.K)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), ["doc_id"])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe,
        op2_html_text,
        op3_sharding,
        op4_minhash_dedup,
        op5_suffix_tree_score,
        op6_quote_linking,
        op7_mixing,
        op8_topk_inner_product,
        op9_quality,
        op10_pii,
        quoted_replies,
    )
}
#: Where SQL can express the result. op1, op4, op5, op9 and op10 are tested against brute force in tests/llm.
ORACLE = {"op2_html_text": html_extract.ORACLE, "op3_sharding": sharding.ORACLE, "op6_quote_linking": quotes.ORACLE, "quoted_replies": quotes.QUOTED_ORACLE, "op7_mixing": mixing.oracle(), "op8_topk_inner_product": topk.ORACLE}
