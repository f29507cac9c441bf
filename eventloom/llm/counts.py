"""Token counts under a unigram vocabulary, without tokens: Aho-Corasick and Viterbi.

An automaton of the vocabulary enumerates all pieces that end at each character; dynamic programming carries the best
score and its number of pieces forward. Ties are the tokenizers library's: pieces that end at a character are tried
from the longest to the shortest and only a better score replaces one, then an unknown character, if it is no piece
itself, at ten less than the lowest score of the vocabulary. Unknown characters count as their UTF-8 bytes if the
vocabulary has byte pieces for these, else neighbouring ones as one. Only ordinary pieces are matched: the names of
control, unknown, unused and byte pieces, such as <s> or <0x41>, are text like any other where a text has them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from eventloom.llm.common import with_columns_from_text

#: Stands for a blank in pieces.
BLANK = "▁"
#: What an unknown character's score is below the lowest one.
PENALTY = 10.0
#: Parts of texts that a worker remembers at most, and the longest, in characters, that it remembers.
REMEMBERED, REMEMBERED_CHARS = 400_000, 64
PART = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class UnigramCounter:
    """Counts the pieces of the best segmentation; vocabulary: (piece, score) of ordinary pieces; byte_pieces: the bytes that have one."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_pieces: Iterable[int] = ()):
        if not vocabulary:
            raise ValueError("the vocabulary is empty")
        self.scores = {}
        for piece, score in vocabulary:
            if piece:
                self.scores[piece] = score
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - PENALTY
        self.byte_pieces = frozenset(byte_pieces)
        # whole numbers add up exactly in any order, and no piece goes on after a word's end: words count by themselves
        exact = all(float(s).is_integer() and abs(s) < 2**31 for s in self.scores.values())
        self.by_words = exact and BLANK in self.scores and not any(BLANK in p.lstrip(BLANK) for p in self.scores)
        self.known: dict[str, tuple[int, float]] = {}

    def segment(self, text: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation of the text as it stands."""
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        count, fused = [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        scores, unknown, done = self.scores, self.unknown, 0

        def close(end: int) -> None:
            """The unknown character before end, once all pieces that end there are tried."""
            char = text[end - 1]
            if char not in scores:
                value = best[end - 1] + unknown
                if best[end] is None or value > best[end]:
                    raw = char.encode()
                    best[end] = value
                    if self.byte_pieces.issuperset(raw):
                        count[end] = count[end - 1] + len(raw)
                    else:
                        count[end], fused[end] = count[end - 1] + (not fused[end - 1]), True

        for at, (length, score) in self.automaton.iter(text):
            end = at + 1
            while done < at:
                done += 1
                close(done)
            start = end - length
            value = best[start] + score
            if best[end] is None or value > best[end]:
                best[end], count[end], fused[end] = value, count[start] + 1, False
        while done < n:
            done += 1
            close(done)
        return count[n], best[n]

    def count(self, text: str) -> tuple[int, float]:
        """(pieces, score) of a text, whose blanks stand for BLANK and which begins with one; an empty one has none."""
        if not text:
            return 0, 0.0
        marked = BLANK + text.replace(" ", BLANK)
        if not self.by_words:
            return self.segment(marked)
        pieces, score, known = 0, 0.0, self.known
        for part in PART.findall(marked):
            found = known.get(part)
            if found is None:
                found = self.segment(part)
                if len(part) <= REMEMBERED_CHARS:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[part] = found
            pieces += found[0]
            score += found[1]
        return pieces, score


def piece_file(path: str) -> tuple[list[tuple[str, float]], list[int]]:
    """(piece, score) of the ordinary pieces of a SentencePiece model file, and the bytes that have pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    ordinary = [i for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    # a byte piece is called <0x00> ... <0xFF>
    return [(model.id_to_piece(i), model.get_score(i)) for i in ordinary], [int(model.id_to_piece(i)[3:5], 16) for i in every if model.is_byte(i)]


_COUNTERS: dict[str, UnigramCounter] = {}


def counter(path: str) -> UnigramCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = UnigramCounter(*piece_file(path))
    return _COUNTERS[path]


COUNTED = [T.StructField("n_tokens", T.LongType()), T.StructField("token_score", T.DoubleType())]


def count_columns(df: DataFrame, text: str, path: str, keep: list[str] | None = None, make_counter: Callable[[str], UnigramCounter] = counter) -> DataFrame:
    """Adds n_tokens and token_score, of the best segmentation of each whole text, from the vocabulary file at path.

    The file is a part of the installed tokenizer package, at the same path on every machine. A null text counts as
    empty: no tokens, score 0. Equal texts have equal values; time grows with the text's length; repeated rows stay; an
    empty table stays empty; columns of these names are replaced.
    """

    def make():
        own = make_counter(path)

        def apply(values: pa.Array) -> list:
            made = [own.count(x or "") for x in values.to_pylist()]
            return [[m[0] for m in made], [m[1] for m in made]]

        return apply

    return with_columns_from_text(df, text, COUNTED, make, keep)
