import random
import re

import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from eventloom.llm import counts, lines

PATH = P.path("piece_bpe_32k.model")
PIECES, BYTES = counts.piece_file(PATH)
MINE = counts.counter(PATH)


def as_unigram(path):
    """The tokenizer of the model file, told that its pieces and scores are a unigram model's (model type 2 becomes 1)."""
    data = open(path, "rb").read()
    field = re.compile(rb"\x18\x02(?=\x20|\x2a|\x30|\x38|\x40|\x48|\x50)")
    for at in [m.start() for m in field.finditer(data, len(data) - 2000)]:
        try:
            model = sentencepiece.SentencePieceProcessor(model_proto=data[: at + 1] + b"\x01" + data[at + 2 :])
        except RuntimeError:
            continue
        if model.encode("aa aa aa", out_type=str) and model.get_piece_size() == 32000 and hasattr(model, "encode") and is_unigram(model):
            return model
    raise AssertionError("no model type found")


def is_unigram(model):
    return len(model.nbest_encode_as_pieces("hello there", 2)) == 2  # a BPE model has no n best


def library(vocabulary):
    return Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=any(p == "<0x00>" for p, _ in vocabulary)))


THEIRS = as_unigram(PATH)
OTHERS = library([("<unk>", 0.0), *PIECES, *((f"<0x{b:02X}>", 0.0) for b in BYTES)])


def theirs(text):
    return len(THEIRS.encode(text))


def others(text):
    return len(OTHERS.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0


TEXTS = ["", "a", "Hello world,  two   blanks ", "line\nbreak\ttab", "naïve Éauaux 中文字符 🙂🙂", "thhethtionthing" * 20, "▁▁x ▁", "<0x0A> <s> <unk>", " " * 50, "x" * 5000]


def test_same_counts_as_the_libraries():
    for text in TEXTS:
        assert MINE.count(text)[0] == theirs(text), text
        if "<" not in text:
            assert MINE.count(text)[0] == others(text), text


def test_names_of_pieces_that_are_no_text():
    own = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in ("a <s> b", "<s>", "</s><unk>", "<0x41>", "x<0x0A>y <pad>"):
        assert MINE.count(text)[0] == theirs(text)
        assert not {"<s>", "</s>", "<unk>", "<0x41>", "<0x0A>"} & set(own.encode(text, out_type=str))
    assert not {"<s>", "</s>", "<unk>", "<0x41>"} & set(MINE.scores) and len(BYTES) == 256


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40), st.text(alphabet="abeinorst \n▁é", max_size=80))
def test_any_text(a, b):
    for text in (a, b):
        assert MINE.count(text)[0] == theirs(text)
        if "<" not in text:
            assert MINE.count(text)[0] == others(text)


def test_ties_and_unknown_characters():
    rng = random.Random(1)
    for fallback in (False, True):
        for _ in range(60):
            pieces = sorted({"".join(rng.choices("ab▁c", k=rng.randint(1, 4))) for _ in range(12)})
            vocabulary = [(p, float(rng.choice([-1, -2, -3, -1.5]))) for p in pieces]
            own = counts.UnigramCounter(vocabulary, range(256) if fallback else ())
            other = library([("<unk>", 0.0), *vocabulary, *((f"<0x{b:02X}>", 0.0) for b in range(256 * fallback))])
            for _ in range(20):
                text = "".join(rng.choices("abc dé", k=rng.randint(1, 14)))
                assert own.count(text)[0] == len(other.encode("▁" + text.replace(" ", "▁")).ids)


def test_words_count_by_themselves_exactly():
    assert MINE.by_words
    for text in TEXTS[1:-1]:
        assert MINE.count(text) == MINE.segment("▁" + text.replace(" ", "▁"))
    with pytest.raises(ValueError):
        counts.UnigramCounter([])


def test_count_columns(spark):
    rows = [(i, t, "old") for i, t in enumerate([*TEXTS, None, TEXTS[2]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in counts.count_columns(df, "text", PATH).collect()}
    assert got == {i: theirs(t or "") for i, t, _ in rows}
    assert counts.count_columns(df.limit(0), "text", PATH).count() == 0


# lines


def plain_lines(rows, ratio):
    def host(url):
        m = re.match(lines.HOST, (url or "").lower())
        return m[1] if m else ""

    cut = [(i, host(u), [x.strip(" \t\r") for x in (t or "").split("\n") if x.strip(" \t\r")]) for i, u, t in rows]
    out = {}
    for i, h, own in cut:
        same = [x for _, g, x in cut if g == h]
        drop = {x for x in own if h and sum(x in s for s in same) > 1 and sum(x in s for s in same) / len(same) > ratio}
        kept = [x for x in own if x not in drop]
        out[i] = (h, len(own), len(own) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(spark):
    rng = random.Random(2)
    rows = []
    hosts = ["http://A.com/x", "https://u:p@a.com:80/y", "http://b.org", "http://few.net/z", None, "no url"]
    small = [f"http://small{n}.net/{k}" for n in (1, 2, 3, 4) for k in range(n)]
    for i in range(90):
        h = small[i] if i < len(small) else rng.choice(hosts)
        own = [rng.choice(["menu", " menu\r", "footer", f"own {rng.randrange(40)}", "", "rare line"]) for _ in range(rng.randint(0, 8))]
        rows.append((i, h, rng.choice(["\n".join(own)] * 9 + [None]), "old"))
    df = spark.createDataFrame(rows, "page_id long, url string, text string, host string").repartition(3)
    for ratio in (0.3, 0.1, 1.0):
        got = lines.without_boilerplate(df, "url", F.col("text"), ratio).collect()
        want = plain_lines([r[:3] for r in rows], ratio)
        assert {r.page_id: (r.host, r.n_lines, r.n_dropped, r.kept_text) for r in got} == want and len(got) == 90
        dropped = {n: sum(want[i][2] for i in range(len(small)) if want[i][0] == f"small{n}.net") for n in (1, 2, 3, 4)}
        assert not dropped[1] and (ratio == 1.0 or sum(dropped.values()) > 0)
    assert lines.without_boilerplate(df.limit(0), "url", F.col("text")).count() == 0
    with pytest.raises(ValueError):
        lines.without_boilerplate(df, "url", F.col("text"), 0)


def test_html_lines(spark):
    html = '<!DOCTYPE html><html><head><style>p{}</style><script>var t="</p>";</script></head><body><P class="x">one <b>bold</b></p><!-- no --><ul><li>two<li>three</ul>four<br/>five</body>'
    df = spark.createDataFrame([(html,), (None,), ("",)], "html string")
    got = [r[0] for r in df.select(lines.lines_of(lines.html_text("html"))).collect()]
    assert got == [["one bold", "two", "three", "four", "five"], [], []]
