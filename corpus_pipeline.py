"""A training corpus from raw documents: language ID, exact and near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on everything that the stage before it kept. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.bpe import token_columns
from eventloom.llm.exact import drop_exact_duplicates
from eventloom.llm.language import language_columns, train
from eventloom.llm.mixing import mixed
from eventloom.llm.near import drop_near_duplicates
from eventloom.plans.storage import forget, scratch, written

RANKS = "byte_bpe_multi_50k.tiktoken"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Rejected: no text, no letters, or a calibrated score under one half.

    Where there is nothing to learn from, because no document is labelled or every labelled one is held out, only
    documents without letters go. Repeated rows stay; an empty table stays empty.
    """
    model = train(docs, "doc_id", "text", "lang")
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return language_columns(docs, "text", model).where("accepted").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts. Null and empty texts are one group; an empty table stays empty."""
    return drop_exact_duplicates(docs, "doc_id", "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.75 or more on five-word shingles connect.

    Documents without words are linked with nothing and stay; an empty table stays empty.
    """
    return drop_near_duplicates(docs, "doc_id", "text")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: any prefix of the written files holds the sources at their weights.

    A null source is a source like others; null keys come first in their source; repeated rows stay; an empty table
    stays empty.
    """
    placed = mixed(docs.withColumn("__digest", F.xxhash64("text")), "doc_id", "source", order_by="__digest")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(parts, "position").sortWithinPartitions("position").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, their number, digests of the ids and of what they decode to, and place.

    place: a number that grows in the order of docs' files, which is the mixture's, whatever order they are read in: 20
    bits for a file's part, 12 for its number among the part's files, 31 for the row in it. A null or empty text has no
    tokens; repeated rows stay; an empty table stays empty.
    """
    outputs = "ids", "n_tokens", "ids_sha256", "decoded_sha256"
    name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    part, file = (F.coalesce(F.regexp_extract(name, p, 1).try_cast("long"), F.lit(0)) for p in (r"^part-(\d+)", r"-c(\d+)\."))
    placed = docs.withColumn("place", F.shiftleft(part, 43) + F.shiftleft(file, 31) + row)
    return token_columns(placed, "text", public_tokenizers.path(RANKS), public_tokenizers.PATTERN, outputs, ["doc_id", "lang", "source", "place"])


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("byte_bpe", tokens)]

#: SQL can't express the language model, so there is none; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over documents. Each stage's result is written to the shared folder before the next one reads it.

    What a stage has read, and what it has written besides its result, is deleted once the result is written; the last
    table that is written stays, for the result reads it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch():
            kept = written(stage(spark, docs, sf_dir), name, keep=True)
        forget(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
