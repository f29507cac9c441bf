"""Substring duplicates by fixed-block anchors.

Texts are read in batches. Every batch indexes the non-overlapping blocks of ANCHOR words of its texts and probes with
every rolling window of ANCHOR words; two equal windows of at least 2 * ANCHOR - 1 words share at least one anchor.
Hashes travel sorted and packed, one blob for each batch and bucket of hashes, and meet in their bucket; batches hear
which of their anchors others hold too. Only windows around such hits are looked up in turn, by 95 bits made of their
words' BLAKE2b digests, which finds each one's smallest document; consecutive hits are the maximal exact repeats. A
common passage costs each batch that holds it a few bytes, whatever the number of its documents; texts move once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from eventloom.llm.common import no_clash
from eventloom.llm.words import Words

#: Bytes of text in a batch, on average, and batches for each bucket of hashes.
BATCH_BYTES, BATCHES = 4 << 20, 3
NO_KEY = np.int64(2**63 - 1)
_PROBES = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("probes", pa.binary()), ("anchors", pa.binary())])
_HITS = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("hits", pa.binary())])
_PRINTS = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("keys", pa.binary()), ("width", pa.int32())])
_SOURCES = pa.schema([("batch", pa.int32()), ("all", pa.binary()), ("some", pa.binary())])
#: The bit of a print's second half that tells that its batch has it in several rows.
SEVERAL = np.uint32(1 << 31)
_SOME = np.dtype([("a", "<u8"), ("least", "<i8")])


def _raws(table: pa.Table) -> list[bytes]:
    return [x or b"" for x in table.column("text").cast(pa.binary()).to_pylist()]


def _keys(table: pa.Table) -> np.ndarray:
    return table.column("key").cast(pa.int64()).fill_null(int(NO_KEY)).to_numpy()


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _packed(values: np.ndarray) -> bytes:
    """Sorted distinct 32-bit integers: the first, then steps of three bytes if all fit, else as they are."""
    values = values.astype("<u4")
    steps = np.diff(values)
    if len(steps) and steps.max() >= 1 << 24:
        return b"\0" + values.tobytes()
    return b"\1" + values[:1].tobytes() + steps.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    if blob[0] == 0 or len(blob) == 1:
        return np.frombuffer(blob, "<u4", offset=1)
    steps = np.zeros(((len(blob) - 5) // 3 + 1, 4), np.uint8)
    steps[0] = np.frombuffer(blob, np.uint8, 4, 1)
    steps[1:, :3] = np.frombuffer(blob, np.uint8, offset=5).reshape(-1, 3)
    return np.cumsum(steps.view("<u4").ravel(), dtype=np.uint32)


def _dealt(hashes: np.ndarray, buckets: int) -> dict[int, bytes]:
    """The distinct low halves of hashes in each bucket, sorted and packed."""
    placed = np.unique(_bucket(hashes, buckets).astype(np.uint64) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF))
    cuts = np.searchsorted(placed, np.arange(buckets + 1).astype(np.uint64) << np.uint64(32))
    low = placed.astype("<u4")
    return {b: _packed(low[cuts[b] : cuts[b + 1]]) for b in range(buckets) if cuts[b + 1] > cuts[b]}


def _anchor_windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the windows from each word on, whether they are whole, and whether they are anchors."""
    whole = words.whole(size)
    place = np.arange(len(words)) - np.repeat(words.first[:-1], words.counts)
    return words.windows(size), whole, whole & (place % size == 0)


def substring_duplicates(
    df: DataFrame, key: str, text: str, window: int = 13, partitions: int | None = None, with_spans: bool = False, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """key, n_words, n_removed and kept_sha256 of every row of df: words that repeat text of smaller keys go.

    Words are runs of bytes other than [\\x20\\x09-\\x0D]. A window is `window` consecutive words of one text. A word
    goes if a window that covers it has the same words as a window of a row with a smaller key, on the input as it
    stands. kept_sha256: of the words that stay, joined by one space. with_spans: also spans, the maximal repeats as
    array of (start, end) in words. key is an integer; a null key is larger than any other, and null keys don't repeat
    each other; rows of equal keys don't either. A null text has no words. A text of any length is read whole; an
    empty table gives an empty result; other columns of df are neither read nor returned. A key of another type, or
    one that is named as a column of the result, is a ValueError.

    The number of batches, and of buckets of hashes, is that of all texts' bytes over batch_bytes, unless partitions
    names that of buckets. A batch and a bucket are what one task holds, some thirty times batch_bytes in all; with n of
    both, n * n blobs are sent, so that batch_bytes has to grow with the root of the input: 4 MB are right up to some
    100 GB, 64 MB for 10 TB, 256 MB for 100 TB.
    """
    no_clash(key, "n_words", "n_removed", "kept_sha256", "spans")
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        raise ValueError(f"{key} must be a column of integers, not {df.schema[key].dataType.simpleString()}")
    anchor = (window + 1) // 2
    parts = partitions or 1 + (df.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0) // (BATCHES * batch_bytes)
    batches, buckets = BATCHES * parts, parts
    source = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    source = source.withColumn("batch", F.pmod(F.xxhash64("key", "text"), F.lit(batches)).cast("int")).repartition(parts, "batch")

    def probes(table: pa.Table) -> pa.Table:
        words = Words(_raws(table))
        hashes, whole, anchors = _anchor_windows(words, anchor)
        asked, held = _dealt(hashes[whole], buckets), _dealt(hashes[anchors], buckets)
        batch = table.column("batch")[0].as_py()
        return pa.table([pa.array(list(asked), pa.int32()), pa.array([batch] * len(asked), pa.int32()), list(asked.values()), [held.get(b, b"\1") for b in asked]], schema=_PROBES)

    def hits(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        who = table.column("batch").to_numpy()
        asked = [_unpacked(x) for x in table.column("probes").to_pylist()]
        held = np.unique(np.concatenate([_unpacked(x) for x in table.column("anchors").to_pylist()]))
        every = np.concatenate(asked).astype(np.uint64) << np.uint64(32) | np.repeat(who, [len(x) for x in asked]).astype(np.uint64)
        every.sort()
        value = (every >> np.uint64(32)).astype(np.uint32)
        again = np.zeros(len(value), bool)
        again[1:] = value[1:] == value[:-1]
        again[:-1] |= again[1:]
        value, batch = value[again], every[again].astype(np.uint32)
        found = held[np.minimum(np.searchsorted(held, value), max(0, len(held) - 1))] == value if len(held) else np.zeros(len(value), bool)
        value, batch = value[found], batch[found]
        order = np.argsort(batch, kind="stable")
        value, batch = value[order], batch[order]
        own, first = np.unique(batch, return_index=True)
        blobs = [_packed(x) for x in np.split(value, first[1:])] if len(own) else []
        return pa.table([pa.array(own.astype(np.int32)), pa.array([bucket] * len(own), pa.int32()), pa.array(blobs, pa.binary())], schema=_HITS)

    def prints(table: pa.Table, heard: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _PRINTS.empty_table()
        words, keys = Words(_raws(table)), _keys(table)
        hashes, whole, anchors = _anchor_windows(words, anchor)
        kept, own = np.unique(hashes[whole], return_counts=True)
        local = np.intersect1d(kept[own > 1], hashes[anchors])
        code = _bucket(hashes, buckets).astype(np.uint64) << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))
        told = [_unpacked(x).astype(np.uint64) | np.uint64(b << 32) for b, x in zip(heard.column("bucket").to_pylist(), heard.column("hits").to_pylist(), strict=True)]
        hit = whole & (_within(code, np.sort(np.concatenate(told))) if told else False)
        hit |= whole & _within(hashes, local)
        near = hit.copy()
        for j in range(1, window - anchor + 1):
            near[:-j] |= hit[j:]
        at = np.flatnonzero(near & words.whole(window))
        a, b, least, most = _merged(words.windows(window)[at], words.windows(window, 1)[at].astype(np.uint32) & ~SEVERAL, keys[words.owner()[at]])[:4]
        b |= np.where(most > least, SEVERAL, np.uint32(0))
        cuts = np.searchsorted(_bucket(a, buckets), np.arange(buckets + 1)).tolist()
        some = [k for k in range(buckets) if cuts[k + 1] > cuts[k]]
        narrow = not len(least) or least.min() >= 0 and least.max() < 1 << 32
        sent = a, b, least.astype("<u4" if narrow else "<i8")
        blobs = [pa.array([x[cuts[k] : cuts[k + 1]].tobytes() for k in some], pa.binary()) for x in sent]
        batch = table.column("batch")[0].as_py()
        return pa.table([pa.array(some, pa.int32()), pa.array([batch] * len(some), pa.int32()), *blobs, pa.array([4 if narrow else 8] * len(some), pa.int32())], schema=_PRINTS)

    def sources(table: pa.Table) -> pa.Table:
        firsts = [np.frombuffer(x, "<u8") for x in table.column("a").to_pylist()]
        a, b = np.concatenate(firsts), np.frombuffer(b"".join(table.column("b").to_pylist()), "<u4")
        own = np.concatenate([np.frombuffer(x, "<u4" if w == 4 else "<i8").astype(np.int64) for x, w in zip(table.column("keys").to_pylist(), table.column("width").to_pylist(), strict=True)])
        who = np.repeat(table.column("batch").to_numpy(), list(map(len, firsts)))
        _, _, smallest, _, group = _merged(a, b & ~SEVERAL, own)
        least = smallest[group]
        later, mixed = least < own, (least == own) & (b >= SEVERAL)
        answers: dict[int, list[bytes]] = {}
        for k, (told, kind) in enumerate(((later, None), (mixed, _SOME))):
            at = np.flatnonzero(told)
            at = at[np.argsort(who[at], kind="stable")]
            batch, first = np.unique(who[at], return_index=True)
            for x, part in zip(batch.tolist(), np.split(at, first[1:]), strict=False):
                if kind is None:
                    blob = a[part].tobytes()
                else:
                    rows = np.empty(len(part), kind)
                    rows["a"], rows["least"] = a[part], least[part]
                    blob = rows.tobytes()
                answers.setdefault(x, [b"", b""])[k] = blob
        return pa.table([pa.array(list(answers), pa.int32()), *(pa.array([x[k] for x in answers.values()], pa.binary()) for k in (0, 1))], schema=_SOURCES)

    fields = [T.StructField(key, source.schema["key"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    if with_spans:
        fields.append(T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))))
    result = T.StructType(fields)
    result_arrow = to_arrow_schema(result)

    def judged(table: pa.Table, heard: pa.Table) -> pa.Table:
        if not table.num_rows:
            return result_arrow.empty_table()
        raws, keys = _raws(table), _keys(table)
        words = Words(raws)
        gone = np.zeros(len(words) + 1, np.int64)
        later = np.sort(np.frombuffer(b"".join(heard.column("all").to_pylist()), "<u8"))
        mixed = np.frombuffer(b"".join(heard.column("some").to_pylist()), _SOME)
        if len(later) or len(mixed):
            a = words.windows(window)
            whole = words.whole(window)
            drop = whole & _within(a, later)
            mixed = mixed[np.argsort(mixed["a"], kind="stable")]
            at = np.flatnonzero(whole & _within(a, mixed["a"]))
            least = mixed["least"][np.searchsorted(mixed["a"], a[at])]
            drop[at[least < keys[words.owner()[at]]]] = True
            at = np.flatnonzero(drop)
            gone += np.bincount(at, minlength=len(gone)) - np.bincount(at + window, minlength=len(gone))
        gone = np.cumsum(gone)[:-1] > 0
        removed = np.add.reduceat(np.concatenate([gone, [False]]).astype(np.int64), words.first)[:-1] if len(raws) else []
        removed = np.where(words.counts > 0, removed, 0)
        shas, spans = [], []
        for i, raw in enumerate(raws):
            lo, hi = words.first[i], words.first[i + 1]
            own = raw.split()
            if removed[i]:
                own = [w for w, g in zip(own, gone[lo:hi].tolist(), strict=True) if not g]
            shas.append(hashlib.sha256(b" ".join(own)).hexdigest())
            if with_spans:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[lo:hi].astype(np.int8), [0]])))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
        columns = [table.column("key"), pa.array(words.counts), pa.array(removed.astype(np.int64)), pa.array(shas, pa.string())]
        return pa.table([*columns, *([pa.array(spans, result_arrow.field(4).type)] if with_spans else [])], schema=result_arrow)

    asked = source.groupBy("batch").applyInArrow(probes, from_arrow_schema(_PROBES))
    heard = asked.groupBy("bucket").applyInArrow(hits, from_arrow_schema(_HITS))
    printed = source.groupBy("batch").cogroup(heard.groupBy("batch")).applyInArrow(prints, from_arrow_schema(_PRINTS))
    known = printed.groupBy("bucket").applyInArrow(sources, from_arrow_schema(_SOURCES))
    return source.groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(judged, result)


def _within(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array found."""
    if not len(found) or not len(values):
        return np.zeros(len(values), bool)
    maybe = np.zeros(1 << 20, bool)
    maybe[found & np.uint64(0xFFFFF)] = True
    at = np.flatnonzero(maybe[values & np.uint64(0xFFFFF)])
    place = np.minimum(np.searchsorted(found, values[at]), len(found) - 1)
    out = np.zeros(len(values), bool)
    out[at] = found[place] == values[at]
    return out


def _merged(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (a, b), sorted, with the least and the greatest key of each; and each row's place among these."""
    order = np.lexsort((b, a))
    a, b, key = a[order], b[order], key[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    group = np.empty(len(a), np.int64)
    group[order] = np.cumsum(new) - 1
    if not len(a):
        return a, b, key, key, group
    return a[first], b[first], np.minimum.reduceat(key, first), np.maximum.reduceat(key, first), group
