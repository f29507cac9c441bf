"""Near duplicates: an LSH forest over MinHash signatures, then exact confirmation and connected components.

Each tree orders the signatures by values of its own. Neighbours in that order with a long common prefix are candidates:
all pairs of a region that shares `least` values, if it is small; a larger region is split by the next value, again
and again, and its rows are candidates with its smallest row and with the rows beside them. Candidates are confirmed on
whole shingle sets, first one for each document, then what still connects two different groups, so that a pair is left
out only if its ends are linked already. Where a larger region is not one group after that, an exact join of its sets'
rarest shingles gives every pair that can still be a link, so that none is lost there. A region that the end of a
partition cuts counts as a larger one, so that no region has to stand in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from eventloom.llm.common import chunks, no_clash, scratch, text_print, written
from eventloom.llm.words import Words
from eventloom.operators.components import moved, roots_of

TREES, DEPTH, LEAST = 32, 6, 4
#: Regions with at most so many rows give all their pairs; larger ones are split.
SMALL = 16
#: Rows beside a row in a region that can't be split any more.
BESIDE = 3
#: Signatures of one task that it remembers to pass each on once.
REMEMBERED = 1 << 20
#: Rounds of confirmation: one candidate of each document, then one of each document and group, then all that are left.
ROUNDS = 3
_RNG = np.random.default_rng(20)
_MASKS = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
_FACTORS = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
#: Bits of the buckets in which shingles are counted, to put the rare ones first.
COUNTED = 18
#: Rows of a shingle's bucket that one block of the exact join takes.
BLOCK = 1024
#: Shingles that are signed at a time, unless one text has more.
SIGNED = 1 << 15


def shingle_sets(raws: list[bytes], size: int = 5) -> list[np.ndarray]:
    """The distinct hashes of each text's shingles of size words, sorted; of a shorter text, of all its words."""
    words = Words(raws, lower=True)
    full = words.windows(size)
    short = {n: words.windows(n) for n in range(1, size) if (words.counts == n).any()}
    first, counts = words.first.tolist(), words.counts.tolist()
    return [np.unique(full[f : f + n - size + 1]) if n >= size else short[n][f : f + 1] if n else full[:0] for f, n in zip(first, counts, strict=False)]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """TREES * DEPTH least hashes of each set; sets must not be empty."""
    out = np.empty((len(sets), TREES * DEPTH), np.uint32)
    i = 0
    while i < len(sets):
        j, size = i + 1, len(sets[i])
        while j < len(sets) and size + len(sets[j]) <= SIGNED:
            size, j = size + len(sets[j]), j + 1
        values = (np.concatenate(sets[i:j]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[i : j - 1])])
        room = np.empty_like(values)
        for k in range(TREES * DEPTH):
            np.bitwise_xor(values, _MASKS[k], out=room)
            np.multiply(room, _FACTORS[k], out=room)
            out[i:j, k] = np.minimum.reduceat(room, starts)
        i = j
    return out


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signed(df: DataFrame, size: int) -> DataFrame:
    """The columns of df but text, n (shingles), node (128-bit digest of the set; null if empty) and sign, null if this task passed it on.

    text is df's first column.
    """
    carried = df.schema.fields[1:]
    schema = T.StructType([*carried, T.StructField("n", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("sign", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            for part in chunks(batch, 0):
                sets = shingle_sets([x or b"" for x in part.column(0).cast(pa.binary()).to_pylist()], size)
                nodes = [_digest(s) if len(s) else None for s in sets]
                new = [i for i, x in enumerate(nodes) if x is not None and x not in met and not met.add(x)]
                signs: list[bytes | None] = [None] * len(sets)
                if new:
                    for i, sign in zip(new, signatures([sets[i] for i in new]), strict=True):
                        signs[i] = sign.tobytes()
                own = [part.column(1 + i).cast(arrow.field(i).type) for i in range(len(carried))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(list(map(len, sets)), pa.int64()), pa.array(nodes, pa.binary()), pa.array(signs, pa.binary())], schema=arrow)
                if len(met) > REMEMBERED:
                    met = set()

    return df.mapInArrow(run, schema)


_LEAVES = pa.schema([*((f"x{i}", pa.int64()) for i in range(4)), ("node", pa.binary()), ("n", pa.int64())])
_PAIRS = pa.schema([("a", pa.binary()), ("b", pa.binary())])
#: big: not a pair, but a larger region (its tree and values) and a node in it.
_FOUND = pa.schema([*_PAIRS, ("big", pa.bool_())])
_COUNTS = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])
_POSTINGS = pa.schema(
    [("shingle", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("indexed", pa.bool_()), ("blocks", pa.int32()), ("node", pa.binary()), ("component", pa.binary()), ("stray", pa.bool_())]
)


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree: tree and values packed into four integers, in the order of the tree."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            signs = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint32).reshape(-1, TREES, DEPTH).astype(np.int64)
            n = len(signs)
            x = [np.arange(TREES) << 32 | signs[:, :, 0], signs[:, :, 1] << 31 | signs[:, :, 2] >> 1, signs[:, :, 3] << 31 | signs[:, :, 4] >> 1, signs[:, :, 5]]
            rows = pa.array(np.repeat(np.arange(n), TREES))
            yield pa.RecordBatch.from_arrays([*(pa.array(v.ravel()) for v in x), part.column(0).take(rows), part.column(1).take(rows)], schema=_LEAVES)


def _region_pairs(values: np.ndarray, least: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of candidates among sorted rows; values: tree and DEPTH values of each row; rank: an order of the rows.

    A larger region's row of the least rank is paired with all, so that it is the smaller end of each of these pairs.
    """
    n = len(values)
    same = np.cumprod(values[1:] == values[:-1], 1).sum(1) - 1 if n > 1 else np.zeros(0, np.int64)
    left, right = [], []
    rows = np.arange(n)
    for depth in range(least, DEPTH + 1):
        new = np.ones(len(rows), bool)
        if len(rows) > 1:
            together = rows[1:] - rows[:-1] == 1
            new[1:] = ~together | (same[rows[1:] - 1] < depth)
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(rows)))
        size = np.repeat(sizes, sizes)
        region = np.repeat(np.arange(len(first)), sizes)
        small = (size > 1) & (size <= SMALL)
        picked, of = rows[small], region[small]
        for step in range(1, SMALL):
            both = np.flatnonzero(of[step:] == of[:-step]) if len(of) > step else []
            if not len(both):
                break
            left.append(picked[both])
            right.append(picked[both + step])
        big = size > SMALL
        if not big.any():
            break
        by_rank = np.lexsort((rank[rows], region))
        leader = np.repeat(rows[by_rank[first]], sizes)
        left += [leader[big]]
        right += [rows[big]]
        for step in range(1, (BESIDE if depth == DEPTH else 1) + 1):
            both = np.flatnonzero(big[step:] & (region[step:] == region[:-step]))
            left.append(rows[both])
            right.append(rows[both + step])
        rows = rows[big]
    if not left:
        return rows[:0], rows[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    return a[a != b], b[a != b]


def _regions(values: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The first row and the end of each region of sorted rows as in _region_pairs."""
    starts = np.flatnonzero(np.append(True, (values[1:, : least + 1] != values[:-1, : least + 1]).any(1))).tolist()
    return list(zip(starts, [*starts[1:], len(values)], strict=True))


def _neighbours(least: int, similarity: tuple[int, int]):
    def pairs(rows: pa.Table, first: bool, last: bool) -> pa.RecordBatch | None:
        """Candidates and larger regions. first, last: the first and the last region may go on in another partition."""
        x = [rows.column(i).to_numpy() for i in range(4)]
        low = np.int64((1 << 31) - 1)
        values = np.stack([x[0] >> 32, x[0] & 0xFFFFFFFF, x[1] >> 31, x[1] & low, x[2] >> 31, x[2] & low, x[3]], 1)
        nodes = np.array(rows.column(4).to_pylist(), object)
        n = rows.column(5).to_numpy()
        once = np.ones(len(nodes), bool)
        once[1:] = (nodes[1:] != nodes[:-1]) | (values[1:, 0] != values[:-1, 0])
        values, nodes, n = values[once], nodes[once], n[once]
        rank = np.frombuffer(b"".join(nodes), ">u8")[::2]
        i, j = _region_pairs(values, least, rank)
        fits = similarity[1] * np.minimum(n[i], n[j]) >= similarity[0] * np.maximum(n[i], n[j])
        found = {(a, b, False) if a < b else (b, a, False) for a, b in zip(nodes[i[fits]], nodes[j[fits]], strict=True) if a != b}
        regions = _regions(values, least)
        for k, (start, end) in enumerate(regions):
            if end - start > SMALL or first and not k or last and k == len(regions) - 1:
                region = values[start, : least + 1].astype("<u4").tobytes()
                found.update((region, x, True) for x in nodes[start:end])
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _FOUND, strict=True)], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            table = pa.Table.from_batches(kept)
            start = table.column(0).to_numpy()
            cut = int(np.searchsorted(start, start[-1]))  # the last region may go on
            if cut:
                if (out := pairs(table.slice(0, cut), first, False)) is not None:
                    yield out
                kept, first = table.slice(cut).to_batches(), False
        if kept and (out := pairs(pa.Table.from_batches(kept), first, True)) is not None:
            yield out

    return run


def _confirmed(similarity: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(similarity[1] * shared >= similarity[0] * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=_PAIRS).filter(pa.array(keep, pa.bool_()))

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << COUNTED, np.int64)
    for batch in batches:
        for x in batch.column(0):
            total += np.bincount((np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(64 - COUNTED)).astype(np.int64), minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], schema=_COUNTS)


def _prefixes(similarity: tuple[int, int], sent):
    """The rarest shingles of each set, as many as it can't do without in a link; indexed: with a set no smaller."""
    p, q = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for batch in batches:
            for part in chunks(batch, 3, 1 << 20):
                columns: list[list[np.ndarray]] = [[] for _ in range(5)]
                rows = []
                for i, x in enumerate(part.column(3)):
                    own = np.frombuffer(x.as_buffer(), np.uint64)
                    n = len(own)
                    often = counts[(own >> np.uint64(64 - COUNTED)).astype(np.int64)]
                    order = np.lexsort((own, often))[: n + 1 + -p * n // q]
                    at = np.flatnonzero(often[order] > 1)  # what is counted once meets nothing
                    picked = order[at]
                    rows.append(np.full(len(at), i))
                    for column, value in zip(columns, (own[picked].view(np.int64), at, np.full(len(at), n), at < n + 1 + -2 * p * n // (p + q), 1 + often[picked] // BLOCK), strict=True):
                        column.append(value)
                if not rows:
                    continue
                made = [pa.array(np.concatenate(c), f.type, safe=False) for c, f in zip(columns, _POSTINGS, strict=False)]
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([*made, *(part.column(c).take(take) for c in range(3))], schema=_POSTINGS)

    return run


def _left_open(members: DataFrame, blobs: DataFrame, labels: DataFrame | None, similarity: tuple[int, int]) -> DataFrame | None:
    """a, b, ca and cb of all pairs of larger regions' nodes in different groups that can be links, by prefix filtering.

    Under one order of all shingles, linked sets share one of the first n - need + 1 of each, need being what they have
    to share; the order is by the count of the shingle's bucket, so that what a family has in common comes last. A
    region's nodes outside its largest group are stray: every pair that is asked for has a stray end, so that a large
    group's own pairs are never made.
    """
    p, q = similarity
    placed = members.withColumn("root", F.lit(None).cast("binary")) if labels is None else members.join(labels, "node", "left")
    placed = written(placed.select("region", "node", F.coalesce("root", "node").alias("component")), "placed")
    groups = placed.groupBy("region", "component").agg(F.count(F.lit(1)).alias("rows"))
    largest = groups.groupBy("region").agg(F.max(F.struct("rows", "component")).alias("top"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    largest = written(largest.select("region", F.col("top.component").alias("main")), "largest")
    nodes = placed.join(largest, "region").groupBy("node", "component").agg(F.max(F.col("component") != F.col("main")).alias("stray"))
    nodes = written(nodes, "open")
    if nodes.isEmpty():
        return None
    sets = written(nodes.join(blobs, "node").select("node", "component", "stray", "shingles"), "open-sets")
    sums = sets.select("shingles").mapInArrow(_counted, from_arrow_schema(_COUNTS)).groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << COUNTED, np.int64)
    counts[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
    sent = sets.sparkSession.sparkContext.broadcast(counts)
    postings = written(sets.mapInArrow(_prefixes(similarity, sent), from_arrow_schema(_POSTINGS)), "postings")
    # a common shingle's rows are dealt to blocks on one side of the join and go to each block on the other, stray one
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    meet = F.expr(
        "x.shingle = y.shingle AND x.block = y.block AND x.component != y.component AND (x.n < y.n OR x.n = y.n AND x.node < y.node)"
        f" AND {p + q}L * least(x.n - x.at, y.n - y.at) >= {p}L * (x.n + y.n)"
    )
    sides = [
        (postings.where("indexed AND stray").withColumn("block", every), postings.withColumn("block", own)),
        (postings.where("indexed AND NOT stray").withColumn("block", own), postings.where("stray").withColumn("block", every)),
    ]
    met = [
        x.alias("x").join(y.alias("y"), meet).select(
            F.least("x.node", "y.node").alias("a"),
            F.greatest("x.node", "y.node").alias("b"),
            F.expr("if(x.node < y.node, x.component, y.component)").alias("ca"),
            F.expr("if(x.node < y.node, y.component, x.component)").alias("cb"),
        )
        for x, y in sides
    ]
    return met[0].unionAll(met[1]).distinct()


def _linked(pairs: DataFrame, blobs: DataFrame, labels: DataFrame | None, similarity: tuple[int, int], name: str, known: bool = False) -> DataFrame | None:
    """labels (node, root) after the links among pairs a < b; None: no links yet. known: pairs have ca and cb, what a and b belong to.

    Each round but the last confirms one pair, that of the least a, for each b, or for each b and group of a.
    """
    for i in range(ROUNDS):
        last = i == ROUNDS - 1
        chosen = rest = pairs
        if not last:
            by = ["b", "ca"] if known else ["b"]
            # counted before rows meet: a node with very many pairs is a key of a join that Spark can split
            least = written(pairs.groupBy(*by).agg(F.min("a").alias("least")), f"{name}-least-{i}")
            joined = pairs.join(least, by)
            chosen, rest = joined.where("a = least").drop("least"), joined.where("a > least").drop("least")
        if not known:
            chosen, rest = (x.withColumns({"ca": F.col("a"), "cb": F.col("b")}) for x in (chosen, rest))
        sides = chosen.join(blobs.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(blobs.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        links = sides.select("ca", "cb", "x", "y").mapInArrow(_confirmed(similarity), from_arrow_schema(_PAIRS))
        if known:
            links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = written(links, f"{name}-links-{i}")
        new = None
        if not links.isEmpty():
            new = written(roots_of(links, f"{name}-roots-{i}", forest=not known), f"{name}-roots-{i}")
            labels = written(new if labels is None else moved(labels, "root", new).unionByName(new).distinct(), f"{name}-labels-{i}")
        if last:
            break
        if new is not None:
            rest = moved(moved(rest, "ca", new), "cb", new)
        known = True
        pairs = written(rest.where("ca != cb").select("a", "b", "ca", "cb"), f"{name}-pairs-{i}")
        if pairs.isEmpty():
            break
    return labels


def _grouped(df: DataFrame, key: str, text: str, size: int, similarity: tuple[int, int], least: int, partitions: int | None) -> DataFrame:
    """key, print (of the text), n, group (null: an empty set) and component, the group's least key, of every row of df."""
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = df.select(F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("key"), text_print(text).alias("print"))
    signed = written(_signed(source, size), "signed")
    leaves = signed.where("sign IS NOT NULL").select("node", "n", "sign").mapInArrow(_leaves, from_arrow_schema(_LEAVES))
    order = ["x0", "x1", "x2", "x3", "node"]
    near = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_neighbours(least, similarity), from_arrow_schema(_FOUND))
    found = written(near.distinct(), "found")
    members = found.where("big").select(F.col("a").alias("region"), F.col("b").alias("node"))
    pairs = found.where("NOT big").select("a", "b")

    asked = pairs.select(F.col("a").alias("node")).unionAll(found.select(F.col("b").alias("node"))).distinct()
    wanted = signed.where("n > 0").groupBy("node").agg(F.min(F.struct("key", "print")).alias("of")).join(asked, "node", "left_semi").select("of.key", "of.print").distinct()
    texts = source.join(wanted, source["key"].eqNullSafe(wanted["key"]) & (source["print"] == wanted["print"]), "left_semi")
    sets_of = pa.schema([("node", pa.binary()), ("shingles", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 0):
                own = [s for s in shingle_sets([x or b"" for x in part.column(0).cast(pa.binary()).to_pylist()], size) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array(map(_digest, own), pa.binary()), pa.array([s.tobytes() for s in own], pa.binary())], schema=sets_of)

    blobs = written(texts.select("text").mapInArrow(sets, from_arrow_schema(sets_of)), "sets")
    if not blobs.groupBy("node").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").isEmpty():  # rows equal in key and text
        blobs = written(blobs.dropDuplicates(["node"]), "sets")
    labels = _linked(pairs, blobs, None, similarity, "near")
    left = _left_open(members, blobs, labels, similarity)
    if left is not None:
        labels = _linked(written(left, "left"), blobs, labels, similarity, "left", True)
    if labels is None:
        labels = asked.select("node", F.col("node").alias("root")).limit(0)
    rows = written(signed.select("key", "print", "n", "node").join(labels, "node", "left").select("key", "print", "n", F.coalesce("root", "node").alias("group")), "rows", keep=True)
    groups = rows.where("n > 0").groupBy("group").agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("least")).where("rows > 1")
    groups = written(groups.select("group", "least", F.lit(True).alias("grouped")), "components", keep=True)
    return rows.join(groups, "group", "left").select("key", "print", "n", "group", F.when(F.col("grouped"), F.col("least")).otherwise(F.col("key")).alias("component"))


def near_groups(df: DataFrame, key: str, text: str, size: int = 5, similarity: tuple[int, int] = (75, 100), least: int = LEAST, partitions: int | None = None) -> DataFrame:
    """key, n_shingles, component_id and kept of every row of df.

    A-Z are lower-cased; words are runs of bytes other than [\\x20\\x09-\\x0D]; a row's set is its text's distinct
    shingles of `size` words, of a shorter text all its words as one. Rows whose sets have similarity[1] * shared >=
    similarity[0] * united are linked; component_id is the smallest key that links reach, and kept tells whether that is
    the row's own. A text without words, or null, has an empty set and is linked with nothing. Null keys are larger than
    any; a group of null keys only has a null id and stays. Equal sets are one node, however many rows have them.
    Links are found with a probability of at least 1 - (1 - s ** least) ** TREES for sets of similarity s, 0.999995 for
    0.75, in regions of up to SMALL rows by all their pairs, in larger ones by an exact join; each is confirmed exactly
    on sets of 64-bit digests. An empty table gives an empty result; other columns of df are neither read nor returned.
    A key that is named as a column of the result is a ValueError.
    """
    no_clash(key, "n_shingles", "component_id", "kept")
    with scratch():
        found = _grouped(df, key, text, size, similarity, least, partitions)
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("key").eqNullSafe(F.col("component")).alias("kept"))


def drop_near_duplicates(df: DataFrame, key: str, text: str, size: int = 5, similarity: tuple[int, int] = (75, 100), least: int = LEAST, partitions: int | None = None) -> DataFrame:
    """The rows of df that near_groups keeps, with all their columns: one of each group of linked rows.

    Rows are told apart by key and text, so that rows of one key with different texts, and rows without a key, are each
    judged by their own text. Of a group whose smallest key several rows share, or whose rows have none, the text with
    the least MD5 stays. Rows that are equal in key and text stay or go together.
    """
    with scratch():
        with scratch():
            found = _grouped(df, key, text, size, similarity, least, partitions)
        mine = found.where(F.col("key").eqNullSafe(F.col("component")))
        # an empty set has no group: it is linked with nothing
        first = mine.groupBy("key", F.coalesce("group", "print").alias("of")).agg(F.min("print").alias("print"))
        kept = written(first.select("key", "print"), "kept", keep=True)
    marked = df.withColumn("__print", text_print(text))
    same = marked[f"`{key}`"].eqNullSafe(kept["key"]) & (marked["__print"] == kept["print"])
    return marked.join(kept, same, "left_semi").drop("__print")
