"""XES event logs: Spark's XML source splits a file into traces, whose attributes become columns."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Element names that are attributes; lists, ids and containers aren't.
TYPES = ("string", "date", "float", "boolean", "int")
CASE_PREFIX = "case:"
_EVENTS = T.StructType([T.StructField("trace", T.LongType()), T.StructField("at", T.LongType()), T.StructField("attributes", T.MapType(T.StringType(), T.StringType()))])


def local(tag: str) -> str:
    return tag.rpartition("}")[2].rpartition(":")[2]


def is_attribute(tag: str) -> bool:
    return local(tag) in TYPES


#: Prefixes of names, whose namespaces are declared outside a trace.
_PREFIX = re.compile(r"[<\s/]([A-Za-z_][\w.-]*):[A-Za-z_][\w.-]*[\s=/>]")


def parse_trace(text: str) -> list[dict[str, str]]:
    """The events of one <trace>, each with the case's attributes, which win over the event's own.

    A case's attributes are its direct children; an event's are all below it, at any depth, the later one winning.
    Prefixes need not be declared in the trace: elements go by their local names. A <trace> with a prefix, or one that
    a comment or CDATA with a </trace> cuts, is a ValueError.
    """
    if not re.match(r"<trace[\s>]", text):
        raise ValueError(f"not a <trace>: {text[:60]!r}; elements of XES with a prefix can't be read")
    declared = "".join(f' xmlns:{p}="{p}"' for p in sorted(set(_PREFIX.findall(text)) - {"xml", "xmlns"}))
    try:
        (trace,) = ET.fromstring(f"<log{declared}>{text}</log>")
    except (ET.ParseError, ValueError) as error:
        raise ValueError(f"a trace can't be read: {error}; it begins {text[:60]!r}") from error
    case = {CASE_PREFIX + x.get("key", ""): x.get("value", "") for x in trace if is_attribute(x.tag)}
    events = []
    for event in trace:
        if local(event.tag) == "event":
            events.append({x.get("key", ""): x.get("value", "") for x in event.iter() if x is not event and is_attribute(x.tag)} | case)
    return events


def _traces(spark: SparkSession, path: str) -> DataFrame:
    """The text of every <trace> of a file or folder, as it stands: (file, text)."""
    lines = spark.read.option("lineSep", "</trace>").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("trace"), F.concat("value", F.lit("</trace>")).alias("text"))


def xes_events(spark: SparkSession, path: str) -> DataFrame:
    """file, trace, at and attributes (a map of text) of every event, in the file's order by (trace, at).

    Records end with </trace>, so that a large file is read in splits and a trace is the unit of memory. Files may be
    gzipped. Values stay text.
    """
    begin = r"<(?:[\w.-]+:)?trace[\s>]"
    cut = _traces(spark, path).where(F.col("text").rlike(begin))
    cut = cut.withColumn("text", F.regexp_extract("text", f"(?s)({begin}.*)", 1))
    schema = T.StructType([T.StructField("file", T.StringType()), *_EVENTS])
    arrow = pa.schema([("file", pa.string()), ("trace", pa.int64()), ("at", pa.int64()), ("attributes", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, trace, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                events = parse_trace(text)
                n = len(events)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * n, pa.string()), pa.array([trace] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([list(e.items()) for e in events], arrow.field(3).type)], schema=arrow
                )

    return cut.mapInArrow(run, schema)


def read_xes(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A flat log: one row an event, one text column for each attribute key, and ordinal (trace, event), the file's order.

    columns: the keys to take, which saves the job that looks for all of them. Keys that differ in case only are told
    apart in the map of xes_events, not here.
    """
    events = xes_events(spark, path)
    if columns is None:
        columns = [r[0] for r in events.select(F.explode(F.map_keys("attributes")).alias("k")).distinct().orderBy("k").collect()]
    return events.select(*(F.col("attributes")[c].alias(c) for c in columns), F.struct("trace", "at").alias("ordinal"), "file")


def _escaped(c):
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def write_traces(df: DataFrame, path: str, case: str, order: list[str], attributes: list[str]) -> None:
    """Writes a flat log as <trace> elements, one a line, for read_xes: the case's id and each event's attributes as text."""
    def element(name: str, value):
        return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f'<string key="{name}" value="'), _escaped(value.cast("string")), F.lit('"/>')))

    event = F.concat(F.lit("<event>"), *(element(a, F.col(f"`{a}`")) for a in attributes), F.lit("</event>"))
    grouped = df.select(F.col(f"`{case}`").alias("case"), F.struct(*order, event.alias("xml")).alias("e")).groupBy("case").agg(F.array_sort(F.collect_list("e")).alias("es"))
    body = F.array_join(F.transform("es", lambda e: e["xml"]), "")
    grouped.select(F.concat(F.lit("<trace>"), element("concept:name", F.col("case")), body, F.lit("</trace>")).alias("value")).write.text(path)
