"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text is lower-cased bytes with blanks for what is no letter; its features are all of its 2-, 3- and 4-byte pieces,
hashed into buckets. The mean of the buckets' embeddings goes through a linear layer and a softmax whose temperature is
fitted on labelled texts kept out of training, so that a score is a probability; below min_score a text is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.common import with_columns_from_text

ORDERS = 2, 3, 4
BUCKET_BITS = 16
UNKNOWN = "und"
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def pieces(raws: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(bounds, buckets): for each order the bucket of the piece that starts at each byte of the joined texts; text i's
    pieces of order n start in bounds[i, 0] ... bounds[i, 1] - n."""
    joined = _FOLD[np.frombuffer(b" ".join([b"", *raws, b""]) + bytes(max(ORDERS)), np.uint8)]
    ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)
    bounds = np.stack([np.concatenate([[0], ends[:-1]]), ends + 1], 1) if len(raws) else np.zeros((0, 2), np.int64)
    long = len(joined) - max(ORDERS) + 1
    code, found = joined[:long].astype(np.uint32), []
    for n in range(2, max(ORDERS) + 1):
        code = code | joined[n - 1 : long + n - 1].astype(np.uint32) << np.uint32(8 * (n - 1))
        if n in ORDERS:
            mixed = (code ^ code >> np.uint32(15)) * np.uint32(2654435769 + 2 * n)
            found.append((mixed ^ mixed >> np.uint32(13)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BUCKET_BITS))
    return bounds, found


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    """logits: for each language and bucket the bucket's share of the logit, divided by the temperature.

    A model without languages, which has learnt from nothing, answers und, score 0, not accepted, to every text.
    """

    langs: list[str]
    logits: np.ndarray
    bias: np.ndarray
    min_score: float

    def probabilities(self, raws: list[bytes]) -> np.ndarray:
        bounds, buckets = pieces(raws)
        total = np.zeros((len(raws), len(self.langs)))
        count = np.zeros(len(raws))
        for n, of in zip(ORDERS, buckets, strict=True):
            stop = np.maximum(bounds[:, 1] - n + 1, bounds[:, 0])
            some = np.flatnonzero(stop > bounds[:, 0])
            if not len(some):
                continue
            cuts = np.stack([bounds[some, 0], stop[some]], 1).ravel()
            count[some] += stop[some] - bounds[some, 0]
            for k, column in enumerate(self.logits):
                total[some, k] += np.add.reduceat(column[of], cuts)[::2]
        z = total / np.maximum(count, 1)[:, None] + self.bias
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score from 0 to 1, and whether the prediction is accepted."""
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
        p = self.probabilities([(t or "").encode() for t in texts])
        best = p.argmax(1).tolist() if len(texts) else []
        score = np.round(p.max(1), 6).tolist() if len(texts) else []
        known = [has_letter(t) for t in texts]
        return (
            [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)],
            [s if k else 0.0 for s, k in zip(score, known, strict=True)],
            [k and s >= self.min_score for s, k in zip(score, known, strict=True)],
        )


def fit(texts: list[str], langs: list[str], dim: int = 16, updates: int = 12_000, rate: float = 0.5, seed: int = 7, min_score: float = 0.5) -> LanguageModel:
    """Trains on four fifths of the texts, whole and in short windows from anywhere in them, and fits the temperature on the rest.

    The number of updates is the same for few texts and many, so that a small sample is learnt as well. Without texts the
    model has no languages.
    """
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((0, 1 << BUCKET_BITS)), np.zeros(0), min_score)
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in langs])
    raws = [t.encode() for t in texts]
    embed = rng.normal(0, 0.1, (1 << BUCKET_BITS, dim)).astype(np.float32)
    layer = rng.normal(0, 0.1, (dim, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    order = rng.permutation(len(raws))
    held, train = (order[::5], np.delete(order, np.s_[::5])) if len(raws) >= 10 else (order, order)

    def window(raw: bytes) -> bytes | None:
        """A short piece of a text, or None for all of it."""
        if rng.random() < 0.5 or len(raw) < 40:
            return None
        n = int(rng.integers(20, min(200, len(raw))))
        at = int(rng.integers(0, len(raw) - n + 1))
        return raw[at : at + n]

    def features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        bounds, buckets = pieces([raw])
        lo, hi = bounds[0]
        bucket, n = np.unique(np.concatenate([b[lo : max(lo, hi - k + 1)] for k, b in zip(ORDERS, buckets, strict=True)]), return_counts=True)
        return bucket, (n / max(1, n.sum())).astype(np.float32)

    whole = {i: features(raws[i]) for i in train}
    epochs = -(-updates // len(train))
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            bucket, share = whole[i] if (part := window(raws[i])) is None else features(part)
            if not len(bucket):
                continue
            hidden = share @ embed[bucket]
            z = hidden @ layer + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y[i]] -= 1
            g *= rate * (1 - done / steps)
            back = layer @ g
            layer -= np.outer(hidden, g)
            bias -= g
            embed[bucket] -= np.outer(share * len(bucket) ** 0.5, back)
            done += 1
    model = LanguageModel(names, (embed.astype(np.float64) @ layer.astype(np.float64)).T.copy(), bias.astype(np.float64), min_score)
    cut = [raws[i] if (part := window(raws[i])) is None else part for i in held]
    logs = np.log(np.maximum(model.probabilities(cut), 1e-300))
    losses = {}
    for t in np.geomspace(0.1, 10, 41):
        z = logs / t
        z -= z.max(1, keepdims=True)
        losses[t] = float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(held)), y[held]]))
    best = min(losses, key=losses.get)
    model.logits /= best
    model.bias /= best
    return model


def held_out(key: str):
    """Whether a row is kept out of learning: the CRC of its key as text leaves 2 modulo 4. A null key: false."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(df: DataFrame, key: str, text: str, lang: str, rows: int = 4000, sample_bytes: int = 16 << 20, min_score: float = 0.5) -> LanguageModel:
    """Fits a model on whole texts of at most `rows` labelled rows that aren't held out, sample_bytes in all.

    The rows are those whose keys have the smallest hashes, so that the sample doesn't depend on the order of df; one
    that doesn't fit into what is left of sample_bytes is passed over. The key only decides what is sampled. Without a
    labelled text that has letters, or with an empty table, the model has no languages and answers und.
    """
    at = F.xxhash64(F.col(f"`{key}`"), F.lit(5))
    usable = df.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull() & ~held_out(key)).select(
        at.alias("at"), F.octet_length(F.col(f"`{text}`")).alias("size"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")
    )
    first = usable.select("at", "size").orderBy("at", "size").limit(rows).collect()
    left, passed = sample_bytes, []
    for r in first:
        if r.size > left:
            passed.append(r)
        else:
            left -= r.size
    got = []
    if first:
        fits = usable.where(F.col("at") <= first[-1].at)
        if passed:
            fits = fits.where(~F.struct("at", "size").isin([F.struct(F.lit(r.at), F.lit(r.size)) for r in passed]))
        got = [r for r in fits.orderBy("at", "size", "lang", "text").limit(rows).collect() if has_letter(r.text)]
    return fit([r.text for r in got], [r.lang for r in got], min_score=min_score)


PREDICTED = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]


def language_columns(df: DataFrame, text: str, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score (0 to 1) and accepted, from the whole text and nothing else.

    A null text or one without letters: und, score 0, not accepted. Equal texts have equal values; a text of any length
    is read whole; repeated rows stay; an empty table stays empty; columns of these names are replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        own = sent.value

        def apply(values: pa.Array) -> list:
            return list(own.predict(values.to_pylist()))

        return apply

    return with_columns_from_text(df, text, PREDICTED, make, keep)
