import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
MINE = bpe.coder(PATH, P.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=MINE.ranks, special_tokens={})
TEXTS = [
    "",
    "a",
    " Hello, world!\n\nThe  quick\tbrown fox's 12345 jumps…  ",
    "Éauaux naïve 中文字符 русский текст עברית 🙂🙂👍🏽 \x00\x1c\x85  ",
    "<|endoftext|> ''s 'll don't",
    "ab" * 700,
    "aaaa" * 300 + "é" * 600,
    "thhethtionthingerehatis" * 15 + "x" * 511 + " " + "y" * 513,
    " " * 2000,
]


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_same_ids_as_the_library_and_round_trip():
    for text, mine in zip(TEXTS, MINE.encode(TEXTS), strict=True):
        assert ids(mine) == THEIRS.encode_ordinary(text)
        assert MINE.decode(mine) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60), st.text(alphabet="abeinorst ", max_size=200))
def test_any_text(a, b):
    for text in (a, b, a + b):
        assert ids(MINE.encode([text])[0]) == THEIRS.encode_ordinary(text)


def test_heap_and_matrix_agree():
    for word in ("thhethtionthing", "e" * 40, "antidisestablishmentarianismus" * 5):
        assert MINE._heap(word.encode()) == MINE._matrix([word.encode()], len(word))[0]


def test_columns(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(99, None, "x"), (0, TEXTS[2], "x"), (0, TEXTS[2], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.token_columns(df, "text", PATH, P.PATTERN, tuple(bpe.OUTPUTS))
    assert sorted(out.columns) == sorted({"doc_id", "text", *bpe.OUTPUTS})
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        raw = (r.text or "").encode()
        want = THEIRS.encode_ordinary(r.text or "")
        assert r.ids == want and r.n_tokens == len(want) and bytes(r.decoded) == raw
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(raw).hexdigest()
    back = bpe.decoded_column(out.drop("decoded"), "ids", PATH, P.PATTERN).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)
    assert bpe.token_columns(df.limit(0), "text", PATH, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.token_columns(df, "text", PATH, P.PATTERN, ("nothing",))
