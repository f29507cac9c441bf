"""The queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SHARDS = 40
PIECES = "piece_bpe_32k.model"
LINE_RATIO = 0.3
RANKS = "byte_bpe_multi_50k.tiktoken"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from eventloom.llm.bpe import token_columns

    outputs = "n_tokens", "ids_sha256", "decoded_sha256"
    return token_columns(documents(spark, sf_dir).select("doc_id", "text"), "text", public_tokenizers.path(RANKS), public_tokenizers.PATTERN, outputs, ["doc_id"])


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.sharding import text_shards

    return text_shards(documents(spark, sf_dir).select("doc_id", "text"), "doc_id", "text", [1.0] * SHARDS, grown=[1.0])


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from eventloom.llm.counts import count_columns

    return count_columns(documents(spark, sf_dir).select("doc_id", "text"), "text", public_tokenizers.path(PIECES), ["doc_id"])


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.exact import exact_groups

    return exact_groups(documents(spark, sf_dir).select("doc_id", "text"), "doc_id", "text")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.language import held_out, language_columns, train

    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = train(docs, "doc_id", "text", "lang")
    predicted = language_columns(docs, "text", model, keep=["doc_id"])
    return predicted.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "accepted")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from eventloom.llm.lines import html_text, without_boilerplate

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    cleaned = without_boilerplate(pages, "url", html_text("html"), LINE_RATIO)
    return cleaned.select("page_id", "host", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.media import stored_columns

    return stored_columns(documents(spark, sf_dir).select("doc_id", "text"), "text", keep=["doc_id"])


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.substring import substring_duplicates

    return substring_duplicates(documents(spark, sf_dir).select("doc_id", "text"), "doc_id", "text")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.near import near_groups

    return near_groups(documents(spark, sf_dir).select("doc_id", "text"), "doc_id", "text")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from eventloom.llm.mixing import mixed

    docs = documents(spark, sf_dir).select("doc_id", "source", F.xxhash64("text").alias("digest"))
    return mixed(docs, "doc_id", "source", order_by="digest").drop("digest")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = op1_byte_bpe, op2_sharding, op3_token_counts, op4_exact_dedup, op5_language_id, op6_line_dedup, op7_media_columns, op8_substring_dedup, op9_minhash_dedup, op10_mixing
    return {f.__name__: f for f in every}
