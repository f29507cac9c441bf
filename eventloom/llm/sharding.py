"""Rendezvous hashing: every record goes to the shard with the highest score for its key. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import dense_number, key_byte, no_clash, written

#: Hex digits of an MD5 that make a uniform number; 13 digits are 52 bits, exact in a double.
DIGITS = 13


def _uniform(key: Column, shard: int) -> Column:
    """A number inside (0, 1) that the key and the shard decide."""
    digest = F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def _score(key: Column, shard: int, weight: float) -> Column:
    return F.lit(float(weight)) / -F.log(_uniform(key, shard))


def _best(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """struct(score, -shard) of the best shard; of equal scores the smallest shard wins."""
    rated = [F.struct(_score(key, first + s, w).alias("score"), F.lit(-(first + s)).alias("minus")) for s, w in enumerate(weights)]
    return rated[0] if len(rated) == 1 else F.greatest(*rated)


def shard_by_key(
    df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] = (), shard: str = "shard", grown_shard: str = "grown_shard"
) -> DataFrame:
    """Adds shard (0 ... len(weights)-1): record keys spread over the shards in proportion to their weights.

    The score of a key in a shard is weight / -ln(u) with u from a hash of key and shard; the highest score wins. A
    shard's scores don't depend on the other shards, so that a new shard takes records only into itself and a removed
    shard's records alone move. grown: weights of shards that are added; grown_shard tells where records are then.

    Nulls: a null key is the key of its own text "null". Equal keys share a shard, whatever else their rows hold, so a
    key that repeats stays together. Weights must be positive. An empty table stays empty; columns named shard or
    grown_shard are replaced.
    """
    if not weights or min([*weights, *grown]) <= 0:
        raise ValueError("there must be shards, with positive weights")
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))
    out = df.withColumn("__best", _best(name, weights))
    picked = {shard: (-F.col("__best.minus")).cast("int")}
    if grown:
        more = F.greatest(F.col("__best"), _best(name, grown, len(weights)))
        picked[grown_shard] = (-more["minus"]).cast("int")
    return out.withColumns(picked).drop("__best")


def text_shards(df: DataFrame, key: str, text: str, weights: Sequence[float], grown: Sequence[float] = (), extra: int = 16) -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard of every record of df.

    size: UTF-8 bytes of the text plus extra; a null text has none and the CRC of nothing. slot: 0, 1, 2 ... without
    gaps in each shard, in the order (first byte of the key's MD5, key, size, CRC); rows equal in all of these are
    interchangeable. The 256 values of that byte bound what one task numbers to a 256th of a shard. An empty table gives
    an empty result; other columns of df are neither read nor returned; a key that is named as a column of the result
    is a ValueError.
    """
    no_clash(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    narrow = df.select(
        F.col(f"`{key}`"), (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + extra).cast("long").alias("size"), F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")).alias("text_crc32")
    )
    placed = shard_by_key(narrow, key, weights, grown)
    if not grown:
        placed = placed.withColumn("grown_shard", F.lit(None).cast("int"))
    placed = written(placed.withColumn("__byte", key_byte(key)), "placed")  # narrow; scores and sums are computed once
    numbered = dense_number(placed, "shard", [F.col(f"`{key}`").asc_nulls_first(), F.col("size"), F.col("text_crc32")], "slot", F.col("__byte"))
    return numbered.select(F.col(f"`{key}`"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
