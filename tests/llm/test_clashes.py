"""Tables with nulls everywhere, repeated rows, very long texts, and columns named like those that operators use inside."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from eventloom.llm import bpe, counts, exact, language, lines, media, mixing, near, sharding, substring

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ROWS = [(1, "a b c d e f g", "en", "s1"), (1, "a b c d e f g", "en", "s1"), (None, None, None, None), (2, "", None, "s2"), (3, LONG, "fr", None), (None, "x", "en", "s1"), (4, "x" * 40_000, None, "s2"), (5, "a b c d e f h", "fr", "s2")]
#: Names that operators give to columns inside, beside those of their results.
NAMES = ["key", "print", "text_", "node", "row", "n", "number", "block_", "batch", "bucket", "component", "group", "rows", "least", "a", "b", "x", "y", "name", "level", "value", "at", "size_", "shard_", "kept_", "lang_", "system user"]


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(3)


@pytest.fixture(scope="module")
def crowded(plain):
    return plain.withColumns({n: F.lit(f"own {n}") for n in NAMES} | {"m": F.create_map(F.lit("k"), F.col("doc_id"))})


RESULTS = {
    "exact": lambda df: exact.exact_groups(df, "doc_id", "text"),
    "drop exact": lambda df: exact.drop_exact_duplicates(df, "doc_id", "text"),
    "near": lambda df: near.near_groups(df, "doc_id", "text", partitions=3),
    "drop near": lambda df: near.drop_near_duplicates(df, "doc_id", "text", partitions=3),
    "substring": lambda df: substring.substring_duplicates(df, "doc_id", "text"),
    "shards": lambda df: sharding.text_shards(df, "doc_id", "text", [1.0] * 5, [2.0]),
    "mixed": lambda df: mixing.mixed(df, "doc_id", "source", block_rows=2, order_by="text"),
    "language": lambda df: language.language_columns(df, "text", language.train(df, "doc_id", "text", "lang")),
    "tokens": lambda df: bpe.token_columns(df, "text", PATH, PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256")),
    "counts": lambda df: counts.count_columns(df, "text", public_tokenizers.path("piece_bpe_32k.model")),
    "media": lambda df: media.stored_columns(df, "text"),
    "lines": lambda df: lines.without_boilerplate(df, "source", F.col("text")),
}


@pytest.mark.parametrize("name", sorted(RESULTS))
def test_other_columns_change_nothing(plain, crowded, name):
    want, got = RESULTS[name](plain), RESULTS[name](crowded)
    rows = sorted(map(str, want.collect()))
    assert sorted(map(str, got.select(*want.columns).collect())) == rows
    if name not in ("exact", "near", "substring", "shards"):
        assert set(crowded.columns) <= set(got.columns)
        assert {r["system user"] for r in got.collect()} == {"own system user"}
    if not name.startswith("drop"):
        assert len(rows) == len(ROWS)


def test_what_stays(plain):
    kept = sorted(map(str, exact.drop_exact_duplicates(plain, "doc_id", "text").select("doc_id", F.md5("text")).collect()))
    assert len(kept) == 6  # one of the two equal rows and one of null and empty go
    kept = [(r.doc_id, (r.text or "")[:20]) for r in near.drop_near_duplicates(plain, "doc_id", "text", partitions=3).collect()]
    assert sorted(kept, key=str) == sorted([(1, "a b c d e f g"), (1, "a b c d e f g"), (None, ""), (2, ""), (3, LONG[:20]), (None, "x"), (4, "x" * 20), (5, "a b c d e f h")], key=str)
