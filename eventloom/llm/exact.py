"""Exact duplicates by deterministic block naming.

Normalised texts are cut into blocks of fixed size. Distinct blocks, sorted, get integers as names; then adjacent
names are paired, distinct pairs are sorted and named in turn, until one name is left of each document. Documents with
as many rounds and the same last name have equal texts: no hash decides, so that there are no collisions.

Copies are thinned before they move: a task that reads documents passes on each distinct block once, with a number of
its own; what is large travels once, and documents follow their blocks' names by these numbers. Every round's table is
written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from eventloom.llm.common import chunks, no_clash, scratch, text_print, written

#: Bytes of white space that texts may differ in.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
BLOCK_BYTES = 8192
#: Bytes of blocks that a task remembers to pass each on once.
REMEMBERED = 48 << 20


def _cut(source: DataFrame, block_bytes: int) -> DataFrame:
    """A row for each document (its own number, key, print, code points, digest and its blocks' numbers) and one for each
    distinct block that a task met (number, block)."""
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("key", source.schema["key"].dataType),
            T.StructField("print", T.BinaryType()),
            T.StructField("points", T.LongType()),
            T.StructField("sha", T.StringType()),
            T.StructField("blocks", T.ArrayType(T.LongType())),
            T.StructField("number", T.LongType()),
            T.StructField("block", T.BinaryType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        rows = numbers = size = 0
        met: dict[bytes, int] = {}
        for batch in batches:
            for part in chunks(batch, 1):
                points, shas, lists, fresh = [], [], [], []
                for value in part.column(1).to_pylist():
                    raw = (value or "").encode()
                    points.append(len(value or ""))
                    bare = raw.translate(None, BLANKS)
                    shas.append(hashlib.sha256(bare).hexdigest())
                    own = []
                    for at in range(0, len(bare), block_bytes) or [0]:
                        block = bare[at : at + block_bytes]
                        if (number := met.get(block)) is None:
                            met[block] = number = first + numbers
                            numbers, size = numbers + 1, size + len(block)
                            fresh.append((number, block))
                        own.append(number)
                    lists.append(own)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(first + rows, first + rows + n), pa.int64()),
                        part.column(0).cast(arrow.field(1).type),
                        part.column(2),
                        pa.array(points, pa.int64()),
                        pa.array(shas, pa.string()),
                        pa.array(lists, arrow.field(5).type),
                        pa.nulls(n, pa.int64()),
                        pa.nulls(n, pa.binary()),
                    ],
                    schema=arrow,
                )
                if fresh:
                    nothing = [pa.nulls(len(fresh), arrow.field(i).type) for i in range(6)]
                    columns = zip(*fresh, strict=True)
                    yield pa.RecordBatch.from_arrays([*nothing, pa.array(next(columns), pa.int64()), pa.array(next(columns), pa.binary())], schema=arrow)
                rows += n
                if size > REMEMBERED:
                    met, size = {}, 0

    return source.mapInArrow(run, schema)


def _named(df: DataFrame, of: list[str], keep: list[str]) -> DataFrame:
    """keep and name: an integer that stands for the values of the columns in `of`, rank and part in their sorted order.

    Rows are dealt out by these columns and sorted; equal ones are neighbours and share a name.
    """
    sorted_ = df.repartition(*of).sortWithinPartitions(*of).select(*of, *keep)
    schema = T.StructType([sorted_.schema[c] for c in keep] + [T.StructField("name", T.LongType())])
    arrow = to_arrow_schema(schema)
    n = len(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, before = (TaskContext.get().partitionId() << 40) - 1, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = None
            for i in range(n):
                column = batch.column(i)
                differs = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
                new = differs if new is None else pc.or_(new, differs)
            first = tuple(batch.column(i)[0].as_py() for i in range(n))
            steps = pc.cumulative_sum(pa.concat_arrays([pa.array([int(first != before)], pa.int64()), new.cast(pa.int64())]))
            names = pc.add(steps, name)
            name, before = names[-1].as_py(), tuple(batch.column(i)[batch.num_rows - 1].as_py() for i in range(n))
            yield pa.RecordBatch.from_arrays([*(batch.column(n + i).cast(arrow.field(i).type) for i in range(len(keep))), names], schema=arrow)

    return sorted_.mapInArrow(run, schema)


def _grouped(df: DataFrame, key: str, text: str, block_bytes: int) -> DataFrame:
    """key, print (of the text as it stands), keep, size, kept and sha of every row of df."""
    source = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), text_print(text).alias("print"))
    cut = written(_cut(source, block_bytes), "blocks")
    documents = cut.where(F.col("row").isNotNull())
    names = _named(cut.where(F.col("number").isNotNull()), ["block"], ["number"])
    parts = documents.select("row", F.size("blocks").alias("n"), F.posexplode("blocks").alias("i", "number"))
    level, current = 0, written(parts.join(names, "number").select("row", "n", "i", "name"), "names-0")
    ends = [current.where("n = 1").select("row", F.lit(0).alias("level"), "name")]
    most = current.agg(F.max("n")).first()[0] or 1
    while most > 1:
        side = F.col("i") % 2
        pairs = (
            current.where("n > 1")
            .groupBy("row", F.floor(F.col("i") / 2).cast("int").alias("i"))
            .agg(F.first("n").alias("n"), F.max(F.when(side == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(side == 1, F.col("name"))), F.lit(-1)).alias("b"))
            .withColumn("n", F.ceil(F.col("n") / 2).cast("int"))
        )
        named = _named(pairs.select("a", "b").distinct(), ["a", "b"], ["a", "b"])
        level, most = level + 1, -(-most // 2)
        current = written(pairs.join(named, ["a", "b"]).select("row", "n", "i", "name"), f"names-{level}")
        ends.append(current.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
    last = ends[0]
    for more in ends[1:]:
        last = last.unionAll(more)
    members = written(documents.select("row", "key", "print", "points", "sha").join(last, "row"), "members", keep=True)
    rank = F.struct((-F.col("points")).alias("fewer"), F.col("key").isNull().alias("lacks"), F.col("key"), F.col("row"))
    groups = members.groupBy("level", "name").agg(F.count(F.lit(1)).alias("size"), F.min(rank).alias("stays")).where("size > 1")
    groups = written(groups.select("level", "name", "size", F.col("stays.key").alias("keep"), F.col("stays.row").alias("keep_row")), "groups", keep=True)
    alone = F.col("size").isNull()
    return members.join(groups, ["level", "name"], "left").select(
        "key",
        "print",
        F.when(alone, F.col("key")).otherwise(F.col("keep")).alias("keep"),
        F.coalesce(F.col("size"), F.lit(1)).alias("size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "sha",
    )


def exact_groups(df: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key, keep_id, group_size, kept and text_sha256 of every row of df, rows that go included.

    Texts are equal when they are identical after the characters of [\\x20\\x09-\\x0D] are deleted; a null text is
    empty. Of equal texts, the row with the most code points stays, then the one with the smallest key (null last); of
    rows equal in both, any one. text_sha256: of the normalised text in UTF-8. An empty table gives an empty result.
    Columns of df other than key and text are neither read nor returned. A key that is named as a column of the result
    is a ValueError.
    """
    no_clash(key, "keep_id", "group_size", "kept", "text_sha256")
    with scratch():
        found = _grouped(df, key, text, block_bytes)
    return found.select(F.col("key").alias(key), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(df: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of df that exact_groups keeps, with all their columns: one of each group of equal normalised texts.

    Rows are told apart by key and text, null keys included, so that rows of one key with different texts are each
    judged by their own text. Of rows equal in key and text, whatever their other columns, one stays; such rows, and
    only they, move once more. Other columns may be of any type.
    """
    with scratch():
        with scratch():
            found = _grouped(df, key, text, block_bytes)
            found = written(found.select("key", "print", "kept"), "judged", keep=True)
        kept = written(found.where("kept").select("key", "print"), "kept", keep=True)
        again = found.groupBy("key", "print").agg(F.count(F.lit(1)).alias("rows"), F.max("kept").alias("kept")).where("kept AND rows > 1")
        again = written(again.select("key", "print"), "again", keep=True)
    marked = df.withColumn("__print", text_print(text))

    def chosen(rows: DataFrame, how: str = "left_semi") -> DataFrame:
        return marked.join(rows, marked[f"`{key}`"].eqNullSafe(rows["key"]) & (marked["__print"] == rows["print"]), how)

    if again.isEmpty():
        return chosen(kept).drop("__print")
    once = kept.join(again, kept["key"].eqNullSafe(again["key"]) & (kept["print"] == again["print"]), "left_anti")
    return chosen(once).unionByName(chosen(again).dropDuplicates([key, "__print"])).drop("__print")
