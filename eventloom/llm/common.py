"""What the training-data operators share: Arrow mapping over texts, dense numbering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from eventloom.plans.storage import scratch, shared_dir, written

__all__ = ["chunks", "dense_number", "key_byte", "no_clash", "scratch", "shared_dir", "text_print", "with_columns_from_text", "written"]

#: Text that one call of a mapped function gets at most, unless a single text is longer.
CHUNK_BYTES = 4 << 20


def no_clash(key: str, *made: str) -> None:
    """ValueError if the key column has the name of a column that is made."""
    if key.lower() in made:
        raise ValueError(f"the key column is called {key}, like a column of the result: rename it first")


def key_byte(key: str) -> Column:
    """The first byte of the MD5 of a key as text, 0 ... 255; a null key's is that of "null"."""
    digest = F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")).cast("binary"))
    return F.conv(F.substring(digest, 1, 2), 16, 10).cast("int")


def text_print(text: str) -> Column:
    """16 bytes that tell texts apart, in the JVM; a null text has those of an empty one."""
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))))


def chunks(batch: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most limit bytes in a string or binary column; a longer value stands alone.

    Columns of other types aren't sliced.
    """
    array = batch.column(column)
    if not batch.num_rows or array.nbytes <= limit or not (pa.types.is_string(array.type) or pa.types.is_binary(array.type)):
        yield batch
        return
    lengths = pc.fill_null(pc.binary_length(array), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    yield batch.slice(start)


def with_columns_from_text(
    df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable[[pa.Array], list]], keep: list[str] | None = None
) -> DataFrame:
    """df with columns computed in Python from one string or binary column.

    make() runs once in each task and returns a function from an Arrow array of values (with nulls) to a list of
    columns, one for each of fields. keep: the columns of df to carry along, all by default. A computed column
    replaces a column of the same name.
    """
    names = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    own = [F.col(f"`{c}`") for c in kept]
    source = df.select(*own) if text in kept else df.select(*own, F.col(f"`{text}`").alias("__value"))
    schema = T.StructType([source.schema[c] for c in kept] + fields)
    arrow = to_arrow_schema(schema)
    at, width = kept.index(text) if text in kept else len(kept), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for part in chunks(batch, at):
                made = apply(part.column(at))
                columns = [c if isinstance(c, pa.Array) else pa.array(c, type=arrow.field(width + i).type) for i, c in enumerate(made)]
                carried = [part.column(i).cast(arrow.field(i).type) for i in range(width)]
                yield pa.RecordBatch.from_arrays([*carried, *columns], schema=arrow)

    return source.mapInArrow(run, schema)


def dense_number(df: DataFrame, group: str, order: list[Column], into: str, spread: Column, buckets: int = 256) -> DataFrame:
    """Adds `into`: 0, 1, 2 ... without gaps in each value of group, in the order (bucket of spread, order).

    No task gets a whole group: rows are numbered within (group, bucket), and the counts of the buckets, buckets x
    groups rows, become offsets. These are written first, so that Spark knows their size before it joins: below its
    limit they are broadcast and the rows don't move again. df's group and spread are read twice: what is dear to
    compute should be written before. spread must be a deterministic integer expression.
    """
    cut = df.withColumn("__bucket", F.pmod(spread, F.lit(buckets)).cast("int"))
    counts = cut.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(group).alias("__group"), F.col("__bucket").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    offsets = written(offsets, "offsets")
    ranked = cut.withColumn("__rank", F.row_number().over(Window.partitionBy(group, "__bucket").orderBy(*order)).cast("long"))
    return (
        ranked.join(offsets, ranked[group].eqNullSafe(offsets["__group"]) & (ranked["__bucket"] == offsets["__of"]))
        .withColumn(into, F.col("__before") + F.col("__rank") - 1)
        .drop("__group", "__of", "__before", "__rank", "__bucket")
    )
